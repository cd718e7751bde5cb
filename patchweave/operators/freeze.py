"""Summaries, capabilities and frozen plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.functions.text import parent_dir


def no_patch() -> Column:
    return F.coalesce(F.length("patch"), F.lit(0)) == 0


def change_summary(files: DataFrame, checks: DataFrame) -> DataFrame:
    """(pr_key, n_files, additions, deletions, n_hunks, missing_patches, parse_failures, patch_state) of each change.

    ``files`` has the patch, or ``missing`` where there is none; patches do not travel.
    """
    missing = F.col("missing") if "missing" in files.columns else no_patch()
    met = files.select("pr_key", "path", "additions", "deletions", missing.alias("missing")).join(checks.select("pr_key", "path", "n_hunks", "error"), ["pr_key", "path"], "left")
    missing, failed = F.count_if("missing"), F.count_if(F.col("error").isNotNull())
    sums = met.groupBy("pr_key").agg(F.count("*").alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
                                     F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n_hunks"))), F.lit(0)).alias("n_hunks"), missing.alias("missing_patches"), failed.alias("parse_failures"))
    return sums.withColumn("patch_state", F.when((F.col("missing_patches") == 0) & (F.col("parse_failures") == 0), "COMPLETE").otherwise("PARTIAL"))


def coverage_state(attempted: Column, loaded: Column) -> Column:
    """COMPLETE if nothing was needed or all was loaded, PARTIAL if some was, MISSING if none."""
    return F.when((attempted == 0) | (loaded == attempted), "COMPLETE").when(loaded > 0, "PARTIAL").otherwise("MISSING")


def capability_report(sources: DataFrame) -> DataFrame:
    """(pr_key, ast_attempted, ast_failed, ast_coverage, base_attempted, base_loaded, base_state) from rows of needed files.

    ``sources`` has pr_key, side, loaded and failed: files to parse at HEAD, and files to load at MERGE_BASE. Coverage is 1 where
    nothing was to be parsed.
    """
    head, base = F.col("side") == "HEAD", F.col("side") == "MERGE_BASE"
    sums = sources.groupBy("pr_key").agg(F.count_if(head).alias("ast_attempted"), F.count_if(head & F.col("failed")).alias("ast_failed"), F.count_if(base).alias("base_attempted"), F.count_if(base & F.col("loaded")).alias("base_loaded"))
    share = F.when(F.col("ast_attempted") == 0, 1.0).otherwise((F.col("ast_attempted") - F.col("ast_failed")) / F.col("ast_attempted"))
    return sums.select("pr_key", "ast_attempted", "ast_failed", share.alias("ast_coverage"), "base_attempted", "base_loaded", coverage_state(F.col("base_attempted"), F.col("base_loaded")).alias("base_state"))


def themes(paths: DataFrame, key: list[str], path: str = "path") -> DataFrame:
    """(key, theme): the folder that the paths of each key have in common; null paths are none.

    What starts all strings starts the first and the last of them, so a key is reduced to three of its paths, before the shuffle.
    """
    parent = parent_dir(F.col(path))
    three = F.array(F.min(path), F.min_by(path, parent), F.max_by(path, parent))
    return paths.groupBy(*key).agg(common_prefix_dir(F.filter(three, lambda p: p.isNotNull())).alias("theme"))


def common_prefix_dir(paths: Column) -> Column:
    """What starts the folder of every path, cut back at slashes from the first path's folder: a prefix of strings, not of segments.

    ``multiple`` if nothing is left, ``root`` if the first path is at the root, ``misc`` for no paths.
    """
    parents = F.transform(paths, lambda p: F.regexp_replace(p, r"/?[^/]*$", ""))

    def fold(kept: Column, p: Column) -> Column:
        parts = F.split(kept, "/")
        cuts = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
        return F.coalesce(F.get(F.filter(cuts, lambda c: p.startswith(c)), F.lit(0)), F.lit(""))

    first = F.coalesce(F.get(parents, F.lit(0)), F.lit(""))
    whole = F.aggregate(parents, first, fold)
    return F.when(F.size(paths) == 0, "misc").when(first == "", "root").when(whole == "", "multiple").otherwise(whole)


def canonical_json(plan: Column) -> Column:
    """JSON without null fields; build maps with ``sorted_map`` so that equal plans have equal bytes."""
    return F.to_json(plan)


def sorted_map(entries: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def reuse(identified: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to build, to reuse) of the changes with a context_id: the second have a readable frozen plan."""
    readable = store.where(F.get_json_object("plan_json", "$.contextId").isNotNull()).dropDuplicates(["context_id"])
    return identified.join(readable, "context_id", "left_anti"), identified.join(readable.select("context_id", "plan_json"), "context_id")


def freeze(plans: DataFrame, path: str) -> None:
    """Appends the plans (context_id, plan_json) that the store does not have; running it twice changes nothing."""
    spark = plans.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    begun = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    known = spark.read.parquet(path).select("context_id") if begun else plans.limit(0).select("context_id")
    new = plans.dropDuplicates(["context_id"]).join(known, "context_id", "left_anti")
    new.withColumn("shard", F.substring("context_id", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)
