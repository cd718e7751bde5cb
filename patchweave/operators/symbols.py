"""Which methods a change touches: an interval semi-join of changed lines and method ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_lines(lines: DataFrame) -> DataFrame:
    """(pr_key, path, side, line): added and context lines by new number at HEAD, removed ones by old number at MERGE_BASE."""
    head = lines.where("line_type != 'REMOVED'").select("pr_key", "path", F.lit("HEAD").alias("side"), F.col("new_no").alias("line"))
    base = lines.where("line_type = 'REMOVED'").select("pr_key", "path", F.lit("MERGE_BASE").alias("side"), F.col("old_no").alias("line"))
    return head.union(base).distinct()


def touched_methods(methods: DataFrame, lines: DataFrame) -> DataFrame:
    """The methods (pr_key, path, side, start_line, end_line, ...) whose range holds a changed line of their file and side.

    A hash join on (pr_key, path, side) with the range as its residual condition. Lines are first reduced to distinct ones.
    """
    found = lines.select(F.col("pr_key").alias("l_pr"), F.col("path").alias("l_path"), F.col("side").alias("l_side"), "line").distinct()
    on = (F.col("pr_key") == F.col("l_pr")) & (F.col("path") == F.col("l_path")) & (F.col("side") == F.col("l_side")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return methods.join(found, on, "left_semi")


def locate_changed(methods: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """Changed methods of both sides.

    HEAD: source files in Java, methods with an added or context line. MERGE_BASE: methods with a removed line at the previous path,
    and all methods of a deleted file. ``files`` has pr_key, path, previous_path, change_type and category.
    """
    java = files.where("category = 'SOURCE' AND path LIKE '%.java'")
    old = F.coalesce("previous_path", "path")
    moved = lines.join(java.select("pr_key", "path", old.alias("old_path")), ["pr_key", "path"])
    head = touched_methods(methods.where("side = 'HEAD'"), changed_lines(moved).where("side = 'HEAD'"))
    removed = changed_lines(moved.withColumn("path", F.col("old_path"))).where("side = 'MERGE_BASE'")
    base = methods.where("side = 'MERGE_BASE'")
    deleted = java.where("change_type = 'DELETE'").select("pr_key", old.alias("path")).distinct()
    return head.unionByName(touched_methods(base, removed).unionByName(base.join(deleted, ["pr_key", "path"], "left_semi")).distinct())
