"""Readers of what a build needs, with fixed schemas so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.functions.paths import category, change_type

REVISIONS = "pr_key string, repo string, pr_number int, merge_base string, head string"
PATCH_FILES = "pr_key string, path string, previous_path string, status string, patch string, additions int, deletions int"
CONTENTS = "repo string, sha string, path string, content string"
DELIVERIES = "delivery string, event string, signature string, payload string, received_at timestamp"


def revisions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Changes with a positive number."""
    return spark.read.format(kind).schema(REVISIONS).load(path).where("pr_number > 0")


def patch_files(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Changed files with their change type and category; the category looks at the path alone."""
    rows = spark.read.format(kind).schema(PATCH_FILES).load(path)
    return rows.withColumn("change_type", change_type(F.col("status"))).withColumn("category", category(F.col("path")))


def contents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).schema(CONTENTS).load(path)


def archives(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, sha, content) of the zip files in a folder, named by their sha."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.lit(repo).alias("repo"), F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("sha"), "content")


def deliveries(spark: SparkSession, path: str, most_files: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream of raw webhook deliveries, so many files a batch at most."""
    return spark.readStream.format(kind).schema(DELIVERIES).option("maxFilesPerTrigger", most_files).load(path)
