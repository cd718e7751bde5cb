"""Slices: changed paths that belong together, within a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.functions.text import parent_dir
from patchweave.sources.scratch import stored


#: Paths that a task's union-find holds at a time.
FOREST_PATHS = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as (pr_key, from_path, to_path) of each path and the smallest path that it is joined to within the partition.

    After FOREST_PATHS paths the trees are given out and new ones begun, so memory does not follow the partition.
    """
    parent: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def trees() -> pa.RecordBatch:
        rows = [(*x, root(x)[1]) for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["pr_key", "from_path", "to_path"])

    for batch in batches:
        for change, a, b in zip(*(batch[c].to_pylist() for c in ("pr_key", "from_path", "to_path")), strict=True):
            x, y = root((change, a)), root((change, b))
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST_PATHS:
            yield trees()
            parent.clear()
    yield trees()


def connected_paths(paths: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(pr_key, path, root): the smallest path that a path is connected to by edges with both ends among the changed paths.

    Edges are first contracted to trees where they lie, then by change. What is left spreads its labels to neighbours, and labels jump
    to their own label, until nothing moves: one round, unless a change is larger than a task's union-find.
    """
    nodes = paths.select("pr_key", "path").distinct()
    ends = nodes.select("pr_key", F.col("path").alias("from_path"))
    inside = edges.select("pr_key", "from_path", "to_path").where("from_path != to_path").join(ends, ["pr_key", "from_path"], "left_semi").join(ends.withColumnRenamed("from_path", "to_path"), ["pr_key", "to_path"], "left_semi")
    schema = "pr_key string, from_path string, to_path string"
    trees = stored(inside.mapInArrow(_forest, schema).repartition("pr_key").mapInArrow(_forest, schema), "trees")
    both = trees.select("pr_key", F.col("from_path").alias("path"), F.col("to_path").alias("near")).union(trees.select("pr_key", F.col("to_path"), F.col("from_path")))
    least = trees.groupBy("pr_key", F.col("from_path").alias("path")).agg(F.min("to_path").alias("near"))
    labels = stored(nodes.join(least, ["pr_key", "path"], "left").select("pr_key", "path", F.least("path", F.coalesce("near", "path")).alias("root")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select("pr_key", F.col("path").alias("near"), F.col("root").alias("heard")), ["pr_key", "near"]).groupBy("pr_key", "path").agg(F.min("heard").alias("heard"))
        spread = labels.join(heard, ["pr_key", "path"], "left").select("pr_key", "path", F.col("root").alias("was"), F.least("root", F.coalesce("heard", "root")).alias("root"))
        if spread.where("root != was").isEmpty():
            return labels
        jump = spread.select("pr_key", F.col("path").alias("root"), F.col("root").alias("jumped"))
        moved = spread.join(jump, ["pr_key", "root"], "left").select("pr_key", "path", F.least("root", F.coalesce("jumped", "root")).alias("root"))
        labels = stored(moved, "labels")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def slice_paths(required: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(pr_key, slice_no, path) from the required items (pr_key, path, tokens) and edges (pr_key, from_path, to_path).

    Connected paths make a slice; paths without a partner are grouped by folder; a group of several paths over the budget
    falls apart into one slice for each path. Slices are numbered from 1 in the order of their first paths.
    """
    tokens = required.groupBy("pr_key", "path").agg(F.sum("tokens").alias("tokens"))
    rooted = connected_paths(tokens, edges).join(tokens, ["pr_key", "path"])
    alone = F.count("*").over(Window.partitionBy("pr_key", "root")) == 1
    grouped = rooted.withColumn("group", F.when(alone, F.concat(F.lit("dir:"), parent_dir(F.col("path")))).otherwise(F.concat(F.lit("root:"), "root")))
    whole = Window.partitionBy("pr_key", "group")
    apart = (F.count("*").over(whole) > 1) & (F.sum("tokens").over(whole) > budget)
    final = grouped.withColumn("group", F.when(apart, F.concat(F.lit("path:"), "path")).otherwise(F.col("group")))
    firsts = final.groupBy("pr_key", "group").agg(F.min("path").alias("first"))
    numbered = firsts.withColumn("slice_no", F.row_number().over(Window.partitionBy("pr_key").orderBy("first")))
    return final.join(numbered, ["pr_key", "group"]).select("pr_key", "slice_no", "path")


def with_fallback(slices: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every change has a slice: number 1 without a path where nothing was assigned."""
    return revisions.select("pr_key").distinct().join(slices, "pr_key", "left").select("pr_key", F.coalesce("slice_no", F.lit(1)).alias("slice_no"), "path")
