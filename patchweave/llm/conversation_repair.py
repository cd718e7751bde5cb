r"""Conversation structure repair: the cheapest edits that give turns a legal order, by iterative-deepening A*.

A legal order of roles is an optional system turn and then pairs of user and assistant turns, or nothing at all. A row is kept,
given another role or deleted, and an empty turn may be inserted anywhere. A depth-first search tries the edits in ASCII order of their
initials (Delete, Insert, Keep, Rerole) under a bound on the cost; the bound rises by one until a path is accepted. So the first path is a
cheapest one, and of those the one whose initials are least in ASCII order. A state is a row and what the roles so far end with; states
that failed are remembered with the budget that they failed with, over all bounds.

The heuristic cuts the rows into blocks of about the root of their number and lets the roles change freely between blocks: the cost of the
rest is never more than that of a block by itself and of each later block by itself. So the bound starts near the cost of the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.llm.common import bounded_batches, table

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What the roles so far end with: nothing, a system turn, a user turn, an assistant turn. Accepted are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: Where a role's initial leads; other initials are illegal and cannot be kept.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where an inserted turn or one of a new role leads: it can only be the role that comes next.
NEXT = (USER, USER, ASSISTANT, USER)
BLANKS = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = ("su", "ua", "au")

_OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


@dataclass(frozen=True, slots=True)
class Row:
    """What the search needs of a row: its role's initial, whether it must go, and what not deleting it adds."""

    initial: str
    gone: bool
    extra: int


def moves(rows: list[Row], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, next row, next state, cost) of the edits that a state allows, in ASCII order."""
    row = rows[at] if at < len(rows) else None
    if row:
        yield "D", at + 1, state, DELETE
    yield "I", at, NEXT[state], INSERT
    if row and not row.gone:
        kept = KEEP.get(row.initial, {}).get(state)
        if kept is not None:
            yield "K", at + 1, kept, row.extra
        yield "R", at + 1, NEXT[state], REROLE + row.extra


def lower_bounds(rows: list[Row]) -> list[list[float]]:
    """For each row and state a cost that the rest takes at least; exact if the rows make one block."""
    size = max(16, isqrt(len(rows)))
    after = [0 if s in ACCEPTED else inf for s in range(4)]
    bounds: list[list[float]] = []
    for at in range(len(rows), -1, -1):
        if at < len(rows):
            if (len(rows) - at - 1) % size == 0 and at + 1 < len(rows):  # another block begins behind this row
                after = [min(after)] * 4
            after = [min([inf, *(cost + after[s] for edit, to, s, cost in moves(rows, at, state) if to > at)]) for state in range(4)]
        one = [min(after[s], INSERT + after[NEXT[s]]) for s in range(4)]
        after = [min(one[s], INSERT + one[NEXT[s]]) for s in range(4)]
        bounds.append(after)
    return bounds[::-1]


def cheapest_edits(rows: list[Row]) -> tuple[int, str]:
    """(cost, initials) of the cheapest edits, the least in ASCII order among equals."""
    least = lower_bounds(rows)
    failed: dict[tuple[int, int], int] = {}
    bound = int(least[0][START])
    while (found := _within(rows, least, bound, failed)) is None:
        bound += 1
    return bound, found


def _within(rows: list[Row], least: list[list[float]], bound: int, failed: dict[tuple[int, int], int]) -> str | None:
    """The first accepted path of at most the bound, depth first."""
    path: list[str] = []
    stack = [(0, START, 0, moves(rows, 0, START))]
    if len(rows) == 0:
        return ""
    while stack:
        at, state, spent, left = stack[-1]
        for edit, to, following, cost in left:
            rest = bound - spent - cost
            if least[to][following] > rest or failed.get((to, following), -1) >= rest:
                continue
            path.append(edit)
            if to == len(rows) and following in ACCEPTED:
                return "".join(path)
            stack.append((to, following, spent + cost, moves(rows, to, following)))
            break
        else:
            failed[at, state] = max(failed.get((at, state), -1), bound - spent)
            stack.pop()
            if path:
                path.pop()
    return None


def apply_edits(turns: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The (role, text) turns after the edits."""
    out, at, state, names = [], 0, START, ("", "", "user", "assistant")
    for edit in edits:
        if edit == "K":
            state = KEEP[turns[at][0][:1]][state]
            out.append(turns[at])
        elif edit != "D":
            state = NEXT[state]
            out.append((names[state], "" if edit == "I" else turns[at][1]))
        at += edit != "I"
    return out


def _repaired(turns: list[tuple[int | None, str, str]]) -> tuple:
    said = [(role, text) for _, role, text in turns]
    seen: set[tuple[str, str]] = set()
    rows, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in said:
        shown = text.strip(BLANKS)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append(Row(role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))
    illegal = sum(a.initial + b.initial not in LEGAL_PAIRS for a, b in zip(rows, rows[1:], strict=False))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, edits = cheapest_edits(rows)
    return gaps, *counts.values(), illegal, cost, edits, [{"role": r, "text": t} for r, t in apply_edits(said, edits)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversations and turns as repaired conversations; one of them is held at a time."""
    fields = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = (*[pa.int64()] * 7, pa.string(), turn_type)
    key, turns, out, held = None, [], [], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(kinds)], names=list(fields))

    for batch in batches:
        for conv, *turn in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if conv != key and turns:
                out.append((key, *_repaired(turns)))
                held += sum(len(text) for _, _, text in turns)
                turns = []
                if held > 1 << 20:
                    yield given()
                    out, held = [], 0
            key = conv
            turns.append(tuple(turn))
    if turns:
        out.append((key, *_repaired(turns)))
    yield given()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text; other columns are ignored).

    blank, duplicate and truncated count the rows by their first fault: nothing but blanks, a role and text seen earlier, a last character
    that ends no sentence. illegal counts neighbours whose roles' initials are no legal pair, gaps the turn numbers that are missing. cost
    and audit are the cheapest edits, and ``repaired`` the (role, text) turns that they leave.

    Turns are ordered by number, nulls first, then role and text, so ties have a defined order and repeated rows are duplicates. A null
    role or text is one space. Roles count by their initial; an empty role has none and cannot be kept. Rows of null conv_id form one
    conversation. An empty table gives no rows. Conversations are dealt out by id and stream by in order: a task holds the texts of one.
    """
    said = lambda c: F.coalesce(c, F.lit(" "))
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(_conversations, _OUT)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    marked = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind != 0")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("nth")).drop("nth")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    digest = F.sha2(F.array_join(lines, "\n"), 256)
    fixed = repair_conversations(damage(given)).withColumn("repaired_sha256", digest).withColumnRenamed("conv_id", "id")
    asked = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = asked.join(fixed, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same by a recursion over rows from the last: for each state the least of cost and initials, and the turns that follow from them.
SQL = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [ascii(c) FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS codes FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM coded
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS nth
  FROM hashed WHERE kind != 0
), placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(role[1]) OVER w AS before FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), ends AS (
  SELECT conv_id, n, {'k': 0, 'e': '', 't': ''} AS v0, {'k': 100000, 'e': '', 't': ''} AS v1, {'k': 5, 'e': 'I', 't': chr(10) || 'assistant:'} AS v2, {'k': 0, 'e': '', 't': ''} AS v3
  FROM counted
), walk AS (
  SELECT conv_id, n AS pos, v0, {'k': 10, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v1, v2, v3 FROM ends
  UNION ALL
  SELECT conv_id, pos, CASE WHEN (b0.k, b0.e) <= (5 + c2.k, 'I' || c2.e) THEN b0 ELSE {'k': 5 + c2.k, 'e': 'I' || c2.e, 't': chr(10) || 'user:' || c2.t} END,
         CASE WHEN (b1.k, b1.e) <= (5 + c2.k, 'I' || c2.e) THEN b1 ELSE {'k': 5 + c2.k, 'e': 'I' || c2.e, 't': chr(10) || 'user:' || c2.t} END, c2,
         CASE WHEN (b3.k, b3.e) <= (5 + c2.k, 'I' || c2.e) THEN b3 ELSE {'k': 5 + c2.k, 'e': 'I' || c2.e, 't': chr(10) || 'user:' || c2.t} END
  FROM (
    SELECT *, CASE WHEN (b2.k, b2.e) <= (5 + b3.k, 'I' || b3.e) THEN b2 ELSE {'k': 5 + b3.k, 'e': 'I' || b3.e, 't': chr(10) || 'assistant:' || b3.t} END AS c2
    FROM (
      SELECT conv_id, pos, list_sort(list_filter([d0, {'k': extra + v1.k, 'e': 'K' || v1.e, 't': line || v1.t, 'ok': kept AND i = 's'}, {'k': extra + v2.k, 'e': 'K' || v2.e, 't': line || v2.t, 'ok': kept AND i = 'u'}, u], lambda x: x.ok))[1] AS b0,
             list_sort(list_filter([d1, {'k': extra + v2.k, 'e': 'K' || v2.e, 't': line || v2.t, 'ok': kept AND i = 'u'}, u], lambda x: x.ok))[1] AS b1,
             list_sort(list_filter([d2, {'k': extra + v3.k, 'e': 'K' || v3.e, 't': line || v3.t, 'ok': kept AND i = 'a'}, a], lambda x: x.ok))[1] AS b2,
             list_sort(list_filter([d3, {'k': extra + v2.k, 'e': 'K' || v2.e, 't': line || v2.t, 'ok': kept AND i = 'u'}, u], lambda x: x.ok))[1] AS b3
      FROM (
        SELECT w.conv_id, w.pos - 1 AS pos, v1, v2, v3, f.role[1] AS i, fault NOT IN ('blank', 'duplicate') AS kept, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
               chr(10) || role || ':' || text AS line, {'k': 2 + v0.k, 'e': 'D' || v0.e, 't': v0.t, 'ok': true} AS d0, {'k': 2 + v1.k, 'e': 'D' || v1.e, 't': v1.t, 'ok': true} AS d1,
               {'k': 2 + v2.k, 'e': 'D' || v2.e, 't': v2.t, 'ok': true} AS d2, {'k': 2 + v3.k, 'e': 'D' || v3.e, 't': v3.t, 'ok': true} AS d3,
               {'k': 1 + extra + v2.k, 'e': 'R' || v2.e, 't': chr(10) || 'user:' || text || v2.t, 'ok': kept} AS u,
               {'k': 1 + extra + v3.k, 'e': 'R' || v3.e, 't': chr(10) || 'assistant:' || text || v3.t, 'ok': kept} AS a
        FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.pos
      )
    )
  )
), answers AS (SELECT conv_id, v0 FROM walk WHERE pos = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v0.k, 0) AS BIGINT) AS cost, coalesce(v0.e, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
"""
