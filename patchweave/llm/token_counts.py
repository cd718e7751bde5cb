"""Token counts from an exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.bpe import _definition, _encoder
from patchweave.llm.common import bounded_batches, materialize, table

#: Lengths of one block of the suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens) of each document; a null or empty text has 0, and repeated rows count each. Only the text column is read."""
    definition = _definition(docs.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder.encode(t.as_py() or "")) for t in batch["text"]], pa.int64())], names=["n_tokens"])
        encoder.known.clear()

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length L that occurs; no rows for an empty table.

    n_docs, n_tokens: documents of length L and their tokens. docs_at_most, docs_at_least, tokens_at_least: documents
    up to or from L. truncated_tokens: what all documents together keep if each is cut to L tokens.
    quantile: the share of documents of at most L tokens. Between two listed lengths every answer follows
    from the next longer one, see ``truncated_total``.

    Suffix sums go in two levels, within blocks of lengths and over the blocks. A task gets the lengths of a block, BLOCK at most, or
    one row for each block, so what it gets is bounded by the longest document and not by the number of documents.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = materialize(counts.select((F.col("n_tokens") / BLOCK).cast("long").alias("block"), "n_tokens", "n_docs", (F.col("n_docs") * F.col("n_tokens")).alias("tokens")), "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # one row for each block of lengths: a document of a million tokens makes 245
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    after = blocks.select("block", F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("a_docs"), F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("a_tokens"),
                          F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("all_tokens"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = counts.withColumn("s_docs", F.sum("n_docs").over(here)).withColumn("s_tokens", F.sum("tokens").over(here)).join(after, "block")
    at_least, tokens = F.col("s_docs") + F.col("a_docs"), F.col("s_tokens") + F.col("a_tokens")
    at_most = F.col("all_docs") - at_least + F.col("n_docs")
    kept = F.col("all_tokens") - tokens + at_least * F.col("n_tokens")
    return summed.select("n_tokens", "n_docs", F.col("tokens").alias("tokens"), at_most.alias("docs_at_most"), at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
                         kept.alias("truncated_tokens"), (at_most / F.col("all_docs")).alias("quantile"))


def truncated_total(histogram: DataFrame, limits: list[int] | DataFrame) -> DataFrame:
    """(context_limit, truncated_tokens, n_truncated) for any limits, one row for each different one.

    A limit reads the suffix sums at the next longer length that occurs: that many documents are cut, and each keeps as many tokens
    less than there. If no length is longer, nothing is cut; an empty histogram gives 0. ``limits`` may be a table with context_limit,
    of any size; null limits are left out. Limits and lengths are sorted together within blocks of lengths, and a limit beyond the
    last length of its block takes the first one of the next block, so a task gets a block or one row for each block.
    """
    spark = histogram.sparkSession
    asked = limits if isinstance(limits, DataFrame) else spark.createDataFrame([(int(n),) for n in limits], "context_limit long")
    asked = asked.where(F.col("context_limit").isNotNull()).select(F.col("context_limit").cast("long").alias("at")).distinct()
    block = F.floor(F.col("at") / BLOCK).alias("block")
    sums = F.struct(F.col("n_tokens").alias("n"), "docs_at_least", "truncated_tokens")
    lengths = histogram.select(F.col("n_tokens").alias("at"), sums.alias("sums")).select(block, "at", "sums")
    nothing = F.lit(None).cast(lengths.schema["sums"].dataType)
    # at equal numbers the limit comes first, as it asks for what is longer
    longer = Window.partitionBy("block").orderBy(F.desc("at"), F.col("sums").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = lengths.unionByName(asked.select(block, "at", nothing.alias("sums")))
    here = both.withColumn("next", F.last("sums", ignorenulls=True).over(longer)).where(F.col("sums").isNull())
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("block").agg(F.min("sums").alias("first"), F.max("sums").alias("last"))
    ends = ends.select("block", F.last("first", ignorenulls=True).over(later).alias("after"), F.max("last").over(Window.partitionBy()).alias("last"))
    met = here.join(ends, "block").withColumn("longer", F.coalesce("next", "after"))
    kept = F.coalesce(F.col("longer.truncated_tokens") - F.col("longer.docs_at_least") * (F.col("longer.n") - F.col("at")), "last.truncated_tokens", F.lit(0))
    return met.select(F.col("at").alias("context_limit"), kept.cast("long").alias("truncated_tokens"), F.coalesce("longer.docs_at_least", F.lit(0)).cast("long").alias("n_truncated"))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that at least ``share`` of the documents do not exceed; null if there are none."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
