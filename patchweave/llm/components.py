"""Connected components of links: union-find within partitions, then alternating star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import discard, materialize


#: Nodes that a task's union-find holds at a time, links of a node beyond which it is joined by broadcast, and such nodes at most.
FOREST_NODES, HOT_LINKS, HOT_NODES = 1 << 20, 1_000, 10_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as (node, root): as many as it has nodes, whatever the number of links.

    After FOREST_NODES nodes the trees are given out and new ones begun, so memory does not follow the partition.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def trees() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST_NODES:
            yield trees()
            parent.clear()
    yield trees()


def _with_least(both: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``both`` (a, b) with the least neighbour m of a.

    Nodes with so many links that one task would get too many of them are joined by a broadcast: HOT_NODES of them at most, since
    ``total`` links have two ends each.
    """
    bound = max(HOT_LINKS, -(-2 * total // HOT_NODES))
    hot = least.where(F.col("n") > bound).select("a", "m")
    if total <= bound or hot.isEmpty():
        return both.join(least.select("a", "m"), "a")
    hot = F.broadcast(hot)
    rest = both.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("n") <= bound).select("a", "m"), "a")
    return both.join(hot, "a").unionByName(rest)


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Large star: links each larger neighbour of a node to the node's smallest neighbour; small star: each smaller one.

    Both the least neighbours and the star are written. Each is named several times by what follows, so that the plan of a round
    that is not cut here has some sixty scans, which the driver plans anew after each of its stages.
    """
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
    moved = _with_least(both, least, total)
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialize(out.where("a != b").distinct(), "stars")
    discard(least)
    return out


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): every node of a link (a, b) with the smallest node that it is connected to.

    Links of a node with itself and repeated links count once or not at all; no links give no rows. Each star is
    written to the shared folder, and the one before it deleted; only a count and a checksum reach the driver.
    """
    links = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "forest")
    seen, total = None, links.count()
    for _ in range(rounds if total else 0):
        for large in (True, False):
            before, links = links, _star(links, large, total)
            discard(before)
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).cast("string")).first())
        if now == seen:
            break
        seen, total = now, now[0]
    else:
        if total:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
