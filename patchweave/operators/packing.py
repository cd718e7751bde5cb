"""Budgeted packing: required items first, then optional ones by value for their tokens."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Container, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "pr_key string, slice_no int, item_id string, status string, pack_ord int, tokens int"


def closure_of(item: str, items: dict, taken: Container[str]) -> list[str]:
    """The item and all that it requires, directly or not, of what is not yet taken; unknown ids are ignored."""
    found, queue = {}, [item]
    while queue:
        current = queue.pop()
        if current not in found and current not in taken:
            found[current] = None
            queue += [r for r in items[current]["requires"] if r in items]
    return list(found)


def ranked(rows: list[dict]) -> tuple[dict[str, dict], dict[str, int]]:
    """(the first row of each id, each id's place by path, start line (none first) and id), both in that order."""
    items: dict[str, dict] = {}
    for row in rows:
        items.setdefault(row["item_id"], row)
    by_rank = sorted(items, key=lambda i: (items[i]["path"], items[i]["start_line"] is not None, items[i]["start_line"] or 0, i))
    return {i: items[i] for i in by_rank}, {i: k for k, i in enumerate(by_rank)}


def pack_slice(rows: list[dict], budget: int) -> tuple[list[str], list[str]]:
    """(included in order, dropped): rows have item_id, path, start_line, tokens, required, requires and value.

    Ties go by path, start line (none first) and id; the first of rows with equal ids counts. Required items come whatever the budget.
    """
    items, rank = ranked(rows)
    taken: dict[str, None] = {}
    used = 0

    def take(item: str) -> int:
        new = sorted(closure_of(item, items, taken), key=rank.__getitem__)
        taken.update(dict.fromkeys(new))
        return sum(items[i]["tokens"] for i in new)

    for item in items:
        if items[item]["required"] and item not in taken:
            used += take(item)
    optional = [i for i in items if not items[i]["required"]]
    plain = not any(items[i]["requires"] for i in optional)

    def offer(item: str) -> tuple[float, int]:
        closure = closure_of(item, items, taken)
        cost = sum(items[i]["tokens"] for i in closure) or 1
        return sum(items[i]["value"] for i in closure) / cost, cost

    if plain:  # nothing an item offers depends on the others: one pass in the order of ratios
        for item, (_, cost) in sorted(((i, offer(i)) for i in optional if i not in taken), key=lambda x: (-x[1][0], rank[x[0]])):
            if used + cost <= budget:
                used += take(item)
    else:
        # An offer changes only when something that it holds is taken, and an item that is too dear stays so until then.
        holds = {i: set(closure_of(i, items, taken)) for i in optional if i not in taken}
        held_by: dict[str, list[str]] = {}
        for item, closure in holds.items():
            for member in closure:
                held_by.setdefault(member, []).append(item)

        def entry(item: str) -> tuple[float, int, str, int]:
            cost = sum(items[i]["tokens"] for i in holds[item]) or 1
            return -sum(items[i]["value"] for i in sorted(holds[item], key=rank.__getitem__)) / cost, rank[item], item, cost

        current = {item: entry(item) for item in holds}
        heap = list(current.values())
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            item, cost = best[2], best[3]
            if item in taken or best != current[item] or used + cost > budget:
                continue
            new = holds[item]
            used += take(item)
            for other in {o for member in new for o in held_by.get(member, ()) if o not in taken}:
                holds[other] = holds[other] - new
                current[other] = entry(other)
                heapq.heappush(heap, current[other])
    return list(taken), [i for i in optional if i not in taken]


def pack_slices(candidates: DataFrame, budget: int | str, by: Sequence[str] = (), choose: Callable[[list[dict], int], tuple[list[str], list[str]]] = pack_slice, more: Sequence[str] = ()) -> DataFrame:
    """(pr_key, slice_no, item_id, status, pack_ord, tokens) of candidate items, without their contents, below the columns of ``by``.

    ``candidates`` has pr_key, slice_no, item_id, path, start_line, tokens, required, requires and value. Each choice depends on those
    before, so a slice is one row of small structs, and Arrow batches carry many slices; contents are joined afterwards. ``budget`` is a
    number or the name of a column that is constant within a slice; ``by`` names string columns, and slices that differ in them are apart.
    ``choose`` packs one slice, of rows that have the columns of ``more`` too.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for *key, limit, rows in zip(*(batch[c].to_pylist() for c in (*by, "pr_key", "slice_no", "budget", "items")), strict=True):
                tokens = {r["item_id"]: r["tokens"] for r in reversed(rows)}
                for status, ids in zip(("included", "dropped"), choose(rows, limit), strict=True):
                    out += [(*key, i, status, k, tokens[i]) for k, i in enumerate(ids)]
            kinds = (*(pa.string() for _ in by), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[*by, "pr_key", "slice_no", "item_id", "status", "pack_ord", "tokens"])

    item = F.struct("path", "item_id", "start_line", "tokens", "required", "requires", "value", *more)
    limit = F.first(budget).alias("budget") if isinstance(budget, str) else F.lit(budget).alias("budget")
    slices = candidates.groupBy(*by, "pr_key", F.col("slice_no").cast("int").alias("slice_no")).agg(limit, F.sort_array(F.collect_list(item)).alias("items"))
    return slices.mapInArrow(pack, ", ".join([*(f"`{c}` string" for c in by), PACKED]))
