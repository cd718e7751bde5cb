"""How much of the context that a reviewer needed was recalled: measures over labelled changes, with intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def support_hits(packed: DataFrame, gold: DataFrame) -> DataFrame:
    """(pr_key, item_id, rank, spent) of each labelled item: its best place among a slice's included items, and the tokens up to and with it.

    ``gold`` has pr_key and item_id; repeated rows count once and rows with a null in them not at all. ``packed`` is what packing gives. Both
    measures are null for an item that was not included; of several slices the one with the smaller rank counts, then the one with fewer tokens.
    """
    order = Window.partitionBy("pr_key", "slice_no").orderBy("pack_ord", "item_id")
    wanted = gold.select("pr_key", "item_id").dropna().distinct()
    shown = packed.where("status = 'included'").join(wanted.select("pr_key").distinct(), "pr_key", "left_semi")
    spent = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    placed = shown.select("pr_key", "item_id", F.row_number().over(order).alias("rank"), spent.alias("spent"))
    best = placed.groupBy("pr_key", "item_id").agg(F.min(F.struct("rank", "spent")).alias("best"))
    return wanted.join(best, ["pr_key", "item_id"], "left").select("pr_key", "item_id", "best.rank", "best.spent")


def recall_at(hits: DataFrame, limits: Sequence[tuple[int | None, int | None]]) -> DataFrame:
    """(pr_key, top, budget, n_gold, n_found, recall) of each labelled change and each limit, the greatest rank and tokens that count, None for any.

    Limits are settings, unfolded where the rows lie. Changes without labels have no recall and no row.
    """
    kind = "array<struct<top:int,budget:bigint>>"
    settings = F.array(*(F.struct(F.lit(top).cast("int").alias("top"), F.lit(budget).cast("bigint").alias("budget")) for top, budget in dict.fromkeys(limits))).cast(kind)
    each = hits.withColumn("limit", F.explode(settings)).select("pr_key", "rank", "spent", "limit.top", "limit.budget")
    within = F.col("rank").isNotNull() & F.coalesce(F.col("rank") <= F.col("top"), F.lit(True)) & F.coalesce(F.col("spent") <= F.col("budget"), F.lit(True))
    counted = each.groupBy("pr_key", "top", "budget").agg(F.count("*").alias("n_gold"), F.count_if(within).alias("n_found"))
    return counted.withColumn("recall", F.col("n_found") / F.col("n_gold"))


def _drawn(key: Column, replicate: Column, seed: int) -> Column:
    """How often a change is drawn in a replicate: Poisson with mean 1, told by a hash, so that it depends on no order and no partition."""
    share = F.pmod(F.xxhash64(key, replicate, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    bounds = accumulate(math.exp(-1) / math.factorial(k) for k in range(12))
    return sum((share >= b).cast("int") for b in bounds)


def recall_intervals(recalls: DataFrame, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(top, budget, n_changes, n_gold, n_found, recall, low, high) over all changes of ``recall_at``, for each limit.

    The interval is that of percentiles over ``replicates`` resamplings of whole changes, since items of one change are alike. A change's
    draws are summed where it lies, so replicates and limits meet in the shuffle and changes do not. A replicate that draws nothing is left out.
    """
    limit = ["top", "budget"]
    total = recalls.groupBy(*limit).agg(F.count("*").alias("n_changes"), F.sum("n_gold").alias("n_gold"), F.sum("n_found").alias("n_found"))
    again = recalls.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = again.withColumn("times", _drawn(F.col("pr_key"), F.col("replicate"), seed)).where("times > 0")
    each = drawn.groupBy(*limit, "replicate").agg((F.sum(F.col("times") * F.col("n_found")) / F.sum(F.col("times") * F.col("n_gold"))).alias("share"))
    edge = (1 - level) / 2
    spread = each.groupBy(F.col("top").alias("_top"), F.col("budget").alias("_budget")).agg(F.percentile("share", F.lit(edge)).alias("low"), F.percentile("share", F.lit(1 - edge)).alias("high"))
    met = total.join(spread, F.col("top").eqNullSafe(F.col("_top")) & F.col("budget").eqNullSafe(F.col("_budget")), "left")
    return met.select(*limit, "n_changes", "n_gold", "n_found", (F.col("n_found") / F.col("n_gold")).alias("recall"), "low", "high")
