"""Budgeted packing that does not pay twice for the same text: what is already shown lowers what an item is worth."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.operators import packing

#: Lines of a shingle.
WIDTH = 2


def pieces(content: Column, width: int = WIDTH) -> Column:
    """The distinct hashes of an item's shingles: ``width`` lines that follow each other, or all lines if there are fewer.

    Lines count without white space around them, and only if they hold a letter or a digit. Null and empty contents have no pieces.
    """
    lines = F.filter(F.transform(F.split(content, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " "))), lambda line: line.rlike(r"[\p{L}\p{N}]"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(lines) - (width - 1), F.lit(1)))
    shingles = F.transform(starts, lambda k: F.xxhash64(F.array_join(F.slice(lines, k, F.lit(width)), "\n")))
    return F.when(F.size(lines) > 0, F.array_distinct(shingles)).otherwise(F.array().cast("array<bigint>"))


def pack_slice(rows: list[dict], budget: int) -> tuple[list[str], list[str]]:
    """(included in order, dropped): rows as for ``packing.pack_slice``, with ``pieces``, the distinct parts of each item's text.

    An item is worth its value times the share of its pieces that nothing taken has; one without pieces is worth its value. What it requires
    comes with it, is paid for, and counts in order, so that pieces which two of them share count once. The best for its tokens is taken as
    long as it fits; ties go as in plain packing. An item is dropped if it and all it requires have been shown already. Values are not negative.

    What is shown only lowers gains, so an old figure is a bound: the best is worked out anew until it stays the best. Gains that rise, because
    something an item requires was taken, are renewed at once.
    """
    items, rank = packing.ranked(rows)
    taken: dict[str, None] = {}
    shown: set = set()
    used = 0

    def take(item: str) -> list[str]:
        nonlocal used
        new = sorted(packing.closure_of(item, items, taken), key=rank.__getitem__)
        taken.update(dict.fromkeys(new))
        for i in new:
            shown.update(items[i]["pieces"])
            used += items[i]["tokens"]
        return new

    for item in items:
        if items[item]["required"] and item not in taken:
            take(item)
    optional = [i for i in items if not items[i]["required"]]
    holds = {i: sorted(packing.closure_of(i, items, taken), key=rank.__getitem__) for i in optional if i not in taken}
    held_by: dict[str, list[str]] = {}
    for item, closure in holds.items():
        for member in closure:
            held_by.setdefault(member, []).append(item)

    def offer(item: str) -> tuple[float, int, int, str, int] | None:
        """(worth for a token, negative; rank; items taken when it was worked out; item; cost), or None if there is nothing new in it."""
        gain, new, own = 0.0, False, set()
        for member in holds[item]:
            parts = items[member]["pieces"]
            fresh = [p for p in parts if p not in shown and p not in own]
            own.update(fresh)
            new = new or bool(fresh) or not parts
            gain += items[member]["value"] * len(fresh) / len(parts) if parts else items[member]["value"]
        cost = sum(items[i]["tokens"] for i in holds[item]) or 1
        return (-gain / cost, rank[item], len(taken), item, cost) if new else None

    current = {item: offer(item) for item in holds}
    heap = [o for o in current.values() if o]
    heapq.heapify(heap)

    def renew(item: str) -> None:
        current[item] = offer(item)
        if current[item]:
            heapq.heappush(heap, current[item])

    while heap:
        best = heapq.heappop(heap)
        _, _, seen, item, cost = best
        if item in taken or best != current[item] or used + cost > budget:
            continue
        if seen < len(taken):
            renew(item)
            continue
        new = take(item)
        for other in {o for member in new for o in held_by.get(member, ()) if o not in taken}:
            holds[other] = [i for i in holds[other] if i not in taken]
            renew(other)
    return list(taken), [i for i in optional if i not in taken]


def pack_slices(candidates: DataFrame, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """What ``packing.pack_slices`` gives, for candidates with ``pieces``, of which null ones are none.

    An optional item that alone exceeds the budget is never included, so its pieces are left out before the shuffle; those that
    travel are bounded by the tokens of their item.
    """
    none = F.array().cast(candidates.schema["pieces"].dataType)
    useful = F.when(F.col("required") | (F.col("tokens") <= budget), F.coalesce("pieces", none)).otherwise(none)
    return packing.pack_slices(candidates.withColumn("pieces", useful), budget, by, pack_slice, ["pieces"])


def overlap(packed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pr_key, slice_no, n_pieces, n_repeated): the pieces of a slice's included items, and how many of them an item shown before has too.

    ``candidates`` has pr_key, slice_no, item_id and pieces; of rows with one id any counts, as their items are one.
    """
    kept = packed.where("status = 'included'").select("pr_key", "slice_no", "item_id")
    each = candidates.dropDuplicates(["pr_key", "slice_no", "item_id"]).join(kept, ["pr_key", "slice_no", "item_id"], "left_semi").select("pr_key", "slice_no", F.explode("pieces").alias("piece"))
    times = each.groupBy("pr_key", "slice_no", "piece").agg(F.count("*").alias("n"))
    return times.groupBy("pr_key", "slice_no").agg(F.sum("n").alias("n_pieces"), F.sum(F.col("n") - 1).alias("n_repeated"))
