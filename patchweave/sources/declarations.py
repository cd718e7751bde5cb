"""Declarations and calls by what a file holds: each content is parsed once, whatever heads, paths and changes it occurs in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.sources.java import ROWS, parse_java
from patchweave.sources.scratch import stored

#: Part of every digest; raise it when the parser gives other rows.
PARSER_VERSION = "java-1"
#: Files of one content in a part.
BUSY = 10_000
_ROWS, _SEEN = f"digest string, {ROWS}, batch string", "digest string, batch string"


def digest(content: Column) -> Column:
    """What a content is kept by; a null one is an empty file, as the parser takes it."""
    return F.sha2(F.concat(F.lit(PARSER_VERSION + "\n"), F.coalesce(content, F.lit(""))), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def known(spark: SparkSession, path: str) -> DataFrame:
    """(digest, batch) of what the table at ``path`` holds: for each content the batch whose rows count."""
    return _read(spark, f"{path}/seen", _SEEN).groupBy("digest").agg(F.min("batch").alias("batch"))


def parse_new(contents: DataFrame, path: str) -> DataFrame:
    """Parses the contents that the table at ``path`` lacks, and returns (digest) of these; ``contents`` has digest and content.

    A batch is written to folders of its own, first its rows and then its digests. One that was cut off has no digests, and its rows are never
    read; of two that parsed the same content at once the one with the smaller name counts. Nothing is changed that others may be reading.
    What is lacking is told by digests alone, so contents that are held do not travel.
    """
    lacking = stored(contents.select("digest").distinct().join(known(contents.sparkSession, path), "digest", "left_anti"), "lacking")
    if not lacking.isEmpty():
        batch = uuid.uuid4().hex
        new = contents.join(lacking, "digest", "left_semi").groupBy("digest").agg(F.any_value("content").alias("content"))
        parse_java(new, ["digest"]).write.parquet(f"{path}/rows/batch={batch}")
        lacking.write.parquet(f"{path}/seen/batch={batch}")
    return lacking


def parse_kept(files: DataFrame, keys: list[str], path: str, content: str = "content") -> DataFrame:
    """What ``java.parse_java`` gives for the files, of which only contents that the table at ``path`` lacks are parsed.

    ``keys`` name the columns that identify a file; none may be called digest or batch, or as a column of the rows. Files meet kept rows by
    digest. Where very many files have one content (an empty file, a licence), they are dealt out and its rows are copied to each part.
    """
    spark = files.sparkSession
    digested = files.select(*keys, F.col(content).alias("content")).withColumn("digest", digest(F.col("content")))
    parse_new(digested.select("digest", "content"), path)
    asked = stored(digested.select(*keys, "digest"), "digests")
    counts = stored(asked.groupBy("digest").agg(F.count("*").alias("_shared")), "digest-counts")
    held = known(spark, path).join(counts, "digest")
    rows = _read(spark, f"{path}/rows", _ROWS).join(held, ["digest", "batch"]).drop("batch")
    parts = F.ceil(F.col("_shared") / BUSY).cast("int")
    copies = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_shared")
    dealt = asked.join(counts, "digest").withColumn("_part", F.pmod(F.xxhash64(*keys), parts).cast("int"))
    return dealt.join(copies, ["digest", "_part"]).select(*keys, *(c.split(" ")[0] for c in ROWS.split(", ")))
