"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys are inserted in ring order. A key goes to the first virtual node clockwise whose shard is not full. Since all keys
of a ring cell see the same nodes in the same order, the cells' loads alone decide how each cell is cut among
shards: that plan is made from at most ``cells`` numbers, and every row then finds its cut by its rank in its cell.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.common import materialize, table

CELLS, VNODES = 1 << 14, 64


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's nodes do not depend on the other shards."""
    def place(shard: int, k: int) -> int:
        return int.from_bytes(blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big") % cells

    return sorted((place(s, k), s) for s in range(shards) for k in range(vnodes))


def capacities(total: int, shards: int, epsilon: float) -> list[int]:
    """Room of each shard: (1 + epsilon) times its share; with epsilon 0 the shares sum to the total exactly."""
    if epsilon:
        return [-int(-total * (1 + epsilon) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def cuts(loads: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, from, to, shard): each cell's load dealt clockwise to the next shards with room."""
    room, at, out = list(room), [c for c, _ in nodes], []
    for cell in sorted(loads):
        left, done, k = loads[cell], 0, bisect_left(at, cell)
        for step in range(len(nodes)):
            shard = nodes[(k + step) % len(nodes)][1]
            if left and room[shard]:
                take = min(left, room[shard])
                out.append((cell, done, done + take, shard))
                room[shard] -= take
                done, left = done + take, left - take
    return out


def shard_documents(docs: DataFrame, shards: int = 8, law: str = "rows", epsilon: float = 0.0, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each input row.

    ``law`` is ``rows`` (a row's load is 1; with epsilon 0 counts are at most one apart) or ``bytes`` (its load is
    ``size``; a shard exceeds its room by less than one row). ``size`` is the text's UTF-8 bytes plus 1; a null text
    counts as empty. Slots are gapless from 0 within a shard. Ties and repeated rows are ordered by doc_id, checksum and size;
    equal rows are interchangeable. Rows with null doc_id are placed by their text. An empty table gives no
    rows; other columns are ignored. What reaches the driver is one number for each ring cell.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    spot = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("spot", spot).withColumn("cell", F.shiftrightunsigned("spot", 20).bitwiseAND(F.lit(cells - 1)).cast("int"))
    load = F.lit(1).cast("long") if law == "rows" else F.col("size")
    order = Window.partitionBy("cell").orderBy("spot", "doc_id", "text_crc32", "size")
    at = F.sum(load).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - load
    placed = materialize(rows.select("doc_id", "size", "text_crc32", "cell", at.alias("at"), F.row_number().over(order).cast("long").alias("nth")), "shards")
    found = placed.groupBy("cell").agg(F.sum(load).alias("load")).collect()
    loads = {r["cell"]: r["load"] for r in found}
    plan = cuts(loads, ring(shards, vnodes, cells), capacities(sum(loads.values()), shards, epsilon))
    pieces = spark.createDataFrame([(k, *p) for k, p in enumerate(plan)], "piece int, cell int, lo long, hi long, shard int")
    inside = (placed["cell"] == pieces["cell"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    # at most cells + shards pieces
    dealt = placed.join(F.broadcast(pieces), inside).select("doc_id", "size", "text_crc32", "shard", "piece", "nth")
    counted = {r["piece"]: (r["n"], r["first"]) for r in dealt.groupBy("piece").agg(F.count("*").alias("n"), F.min("nth").alias("first")).collect()}
    offsets, used = [], [0] * shards
    for k, (_, _, _, shard) in enumerate(plan):
        n, first = counted.get(k, (0, 1))
        offsets.append((k, used[shard] - first))
        used[shard] += n
    slots = spark.createDataFrame(offsets, "piece int, shift long")
    return dealt.join(F.broadcast(slots), "piece").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("nth") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
