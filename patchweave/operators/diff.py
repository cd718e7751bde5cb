"""Unified diffs as rows: lines anchored to old and new line numbers, hunks, and rendered forms.

A file's patch is one row until it is exploded; the file rows are dealt out by (pr_key, path) before that, so the windows over
a file's lines need no further shuffle and the line rows never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*$"
FILE = ["pr_key", "path"]
STARTS = ("old_start", "old_count", "new_start", "new_count")


def _count(line: Column, group: int) -> Column:
    """A header's number; an absent count is 1, an overflow null."""
    found = F.regexp_extract(line, HEADER, group)
    return F.when(found == "", F.lit(1)).otherwise(found.try_cast("int"))


def parse_patches(files: DataFrame) -> DataFrame:
    """All lines of all patches: (pr_key, path, hunk_idx, line_idx, line_type, old_no, new_no, content, header columns, error).

    ``files`` has pr_key, path and patch; a null or empty patch has no lines. Lines before the first header are skipped, a
    marker line (backslash) is skipped and moves no cursor, an empty line is context. ``error`` is null, or says for every row of a
    file why the file's hunks are void: a bad header, a bad line prefix, or counts that differ from the header's.
    """
    dealt = files.select(*FILE, "patch").where(F.length("patch") > 0).repartition(*(F.col(c) for c in FILE))
    text = F.regexp_replace("patch", r"\n$", "")
    lines = dealt.select(*FILE, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select(*FILE, "pos", F.regexp_replace("raw", r"\r$", "").alias("raw"))
    order = Window.partitionBy(*FILE).orderBy("pos")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*FILE)
    is_header = F.col("raw").startswith("@@")
    numbered = lines.withColumn("hunk_idx", (F.sum(is_header.cast("int")).over(upto) - 1).cast("int")).where("hunk_idx >= 0")
    good = is_header & F.col("raw").rlike(HEADER)
    head = {n: F.when(good, _count(F.col("raw"), k)) for k, n in enumerate(("old_start", "old_count", "new_start", "new_count"), 1)}
    kind = (F.when(is_header, "HEADER").when(F.col("raw").startswith("\\"), "MARKER").when(F.col("raw").startswith("+"), "ADDED")
            .when(F.col("raw").startswith("-"), "REMOVED").when((F.col("raw") == "") | F.col("raw").startswith(" "), "CONTEXT").otherwise("BAD"))
    typed = numbered.select(*FILE, "pos", "raw", "hunk_idx", kind.alias("line_type"), *(v.alias(k) for k, v in head.items()))
    hunk = Window.partitionBy(*FILE, "hunk_idx").orderBy("pos")
    full = Window.partitionBy(*FILE, "hunk_idx")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    old, new = F.col("line_type").isin("CONTEXT", "REMOVED"), F.col("line_type").isin("CONTEXT", "ADDED")
    placed = typed.select(
        *FILE, "pos", "hunk_idx", "line_type", "raw", *(F.max(c).over(full).alias(c) for c in head),
        F.sum(old.cast("int")).over(full).alias("olds"), F.sum(new.cast("int")).over(full).alias("news"), F.sum((F.col("line_type") == "BAD").cast("int")).over(full).alias("bads"),
        F.coalesce(F.sum(old.cast("int")).over(before), F.lit(0)).alias("old_before"), F.coalesce(F.sum(new.cast("int")).over(before), F.lit(0)).alias("new_before"),
        F.sum(F.col("line_type").isin("CONTEXT", "ADDED", "REMOVED").cast("int")).over(before).alias("body_before"))
    wrong = (F.when((F.col("line_type") == "HEADER") & (F.col("old_start").isNull() | F.col("old_count").isNull() | F.col("new_start").isNull() | F.col("new_count").isNull()), "bad header")
             .when(F.col("line_type") == "BAD", "bad line").when((F.col("bads") == 0) & ((F.col("olds") != F.col("old_count")) | (F.col("news") != F.col("new_count"))), "count mismatch"))
    judged = placed.withColumn("error", F.min(F.when(wrong.isNotNull(), F.struct(F.col("pos"), wrong.alias("why")))).over(whole)["why"])
    body = judged.where(F.col("line_type").isin("CONTEXT", "ADDED", "REMOVED", "HEADER"))
    return body.select(
        *FILE, "hunk_idx", F.when(F.col("line_type") == "HEADER", F.lit(-1)).otherwise(F.coalesce("body_before", F.lit(0))).cast("int").alias("line_idx"), "line_type",
        F.when(F.col("line_type").isin("CONTEXT", "REMOVED"), F.col("old_start") + F.col("old_before")).cast("int").alias("old_no"),
        F.when(F.col("line_type").isin("CONTEXT", "ADDED"), F.col("new_start") + F.col("new_before")).cast("int").alias("new_no"),
        F.when(F.col("line_type") != "HEADER", F.substring("raw", 2, 1 << 30)).alias("content"), *head, "error")


def hunk_lines(parsed: DataFrame) -> DataFrame:
    """Lines of sound files; a new file's or deleted file's lines are all added or removed."""
    return parsed.where("error IS NULL AND line_type != 'HEADER'").select(*FILE, "hunk_idx", "line_idx", "line_type", "old_no", "new_no", "content")


def hunks(parsed: DataFrame) -> DataFrame:
    """(pr_key, path, hunk_idx, old_start, old_count, new_start, new_count) of sound files."""
    return parsed.where("error IS NULL AND line_type = 'HEADER'").select(*FILE, "hunk_idx", "old_start", "old_count", "new_start", "new_count")


def file_checks(parsed: DataFrame) -> DataFrame:
    """(pr_key, path, n_hunks, error): one row for each file with a hunk."""
    return parsed.where("line_type = 'HEADER'").groupBy(*FILE).agg(F.count("*").alias("n_hunks"), F.min("error").alias("error"))


def gather_hunks(parsed: DataFrame) -> DataFrame:
    """(pr_key, path, hunk_idx, starts and counts, error, lines): a row for each hunk; the lines of sound files in their order, without the header.

    Straight from ``parse_patches`` this needs no shuffle, and neither do lines and rendered forms that are taken from it.
    """
    line = F.when(F.col("error").isNull() & (F.col("line_type") != "HEADER"), F.struct("line_idx", "line_type", "old_no", "new_no", "content"))
    return parsed.groupBy(*FILE, "hunk_idx").agg(*(F.first(c).alias(c) for c in (*STARTS, "error")), F.sort_array(F.collect_list(line)).alias("lines"))


def gathered_lines(gathered: DataFrame) -> DataFrame:
    """What ``hunk_lines`` gives, of ``gather_hunks``."""
    return gathered.where("error IS NULL").select(*FILE, "hunk_idx", F.explode("lines").alias("l")).select(*FILE, "hunk_idx", "l.line_idx", "l.line_type", "l.old_no", "l.new_no", "l.content")


def render_gathered(gathered: DataFrame) -> DataFrame:
    """``gather_hunks`` of sound files with ``rendered``, as ``render_hunks`` gives it, instead of the lines."""
    shown = F.transform("lines", lambda l: F.concat(_mark(l["line_type"]), l["content"]))
    return gathered.where("error IS NULL").withColumn("rendered", F.array_join(F.concat(F.array(_header()), shown), "\n")).drop("lines", "error")


def _mark(kind: Column) -> Column:
    return F.when(kind == "ADDED", "+").when(kind == "REMOVED", "-").otherwise(" ")


def _header() -> Column:
    return F.format_string("@@ -%d,%d +%d,%d @@", *STARTS)


def render_hunks(parsed: DataFrame) -> DataFrame:
    """(pr_key, path, hunk_idx, ..., rendered): header with both counts, then the lines; a header's section text is gone."""
    line = F.when(F.col("line_type") == "HEADER", _header()).otherwise(F.concat(_mark(F.col("line_type")), "content"))
    sound = parsed.where("error IS NULL").select(*FILE, "hunk_idx", *STARTS, F.struct("line_idx", line.alias("line")).alias("l"))
    gathered = sound.groupBy(*FILE, "hunk_idx").agg(*(F.first(c).alias(c) for c in STARTS), F.sort_array(F.collect_list("l")).alias("ls"))
    return gathered.select(*FILE, "hunk_idx", *STARTS, F.array_join("ls.line", "\n").alias("rendered"))


def hunk_ref(change: Column) -> tuple[Column, Column, Column]:
    """(side, start, end): the old range at the merge base for a deletion, else the new range at the head."""
    gone = change == "DELETE"
    start = F.when(gone, F.col("old_start")).otherwise(F.col("new_start"))
    count = F.when(gone, F.col("old_count")).otherwise(F.col("new_count"))
    return F.when(gone, "MERGE_BASE").otherwise("HEAD"), start, F.greatest(start, start + count - 1)


def annotate(texts: DataFrame, key: list[str], text: str = "rendered") -> DataFrame:
    """(key, annotated): each line after a header with its new line number, in four places; removed lines without one."""
    dealt = texts.select(*key, text).repartition(*(F.col(c) for c in key))
    lines = dealt.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(*key).orderBy("pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_header, marker = F.col("line").startswith("@@"), F.col("line").startswith("\\")
    parted = lines.withColumn("part", F.sum(is_header.cast("int")).over(upto))
    start = F.max(F.when(is_header, F.regexp_extract("line", r"^[^+]*\+(\d+)", 1).try_cast("int"))).over(Window.partitionBy(*key, "part"))
    counts = (~is_header & ~marker & ~F.col("line").startswith("-")).cast("int")
    at = start + F.coalesce(F.sum(counts).over(before), F.lit(0))
    rest = F.substring("line", 2, 1 << 30)
    shown = (F.when(is_header | marker | start.isNull(), F.col("line")).when(F.col("line").startswith("-"), F.concat(F.lit("-      | "), rest))
             .when(F.col("line").startswith("+"), F.concat(F.format_string("+ %4d | ", at), rest)).otherwise(F.concat(F.format_string("  %4d | ", at), rest)))
    gathered = parted.select(*key, F.struct("pos", shown.alias("line")).alias("l")).groupBy(*key).agg(F.sort_array(F.collect_list("l")).alias("ls"))
    return gathered.select(*key, F.array_join("ls.line", "\n").alias("annotated"))
