"""Findings as comments: anchored to shown lines, or listed in the body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchor(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings with ``anchored``: whether a range (pr_key, path, start_line, end_line) holds their line.

    Findings are keyed by (pr_key, path, line), reduced to distinct lines, met with the ranges by a hash join and marked.
    """
    asked = findings.select("pr_key", "path", "line").distinct()
    spans = ranges.where("start_line IS NOT NULL AND end_line IS NOT NULL").select(F.col("pr_key").alias("r_pr"), F.col("path").alias("r_path"), "start_line", "end_line").distinct()
    on = (F.col("pr_key") == F.col("r_pr")) & (F.col("path") == F.col("r_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    held = asked.join(spans, on, "left_semi").withColumn("held", F.lit(True))
    return findings.join(held, ["pr_key", "path", "line"], "left").withColumn("anchored", F.coalesce("held", F.lit(False))).drop("held")


def inline_comment() -> Column:
    suggestion = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("\n\nSuggestion: "), "suggestion")).otherwise("")
    cited = F.when(F.size("cited") > 0, F.concat(F.lit("\n\n_Cited context: "), F.array_join("cited", ", "), F.lit("_"))).otherwise("")
    return F.concat(F.lit("**["), "severity", F.lit("] "), "title", F.lit("**\n\n"), "message", suggestion, cited)


def body_line() -> Column:
    return F.concat(F.lit("- `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("` ["), "severity", F.lit("] **"), "title", F.lit("** — "), "message", F.lit("\n"))


def comments(anchored: DataFrame, heading: str) -> tuple[DataFrame, DataFrame]:
    """(inline comments, one body for each change that lists its unanchored findings in order)."""
    inline = anchored.where("anchored").select("pr_key", "path", "line", inline_comment().alias("comment"))
    rest = anchored.where("NOT anchored").groupBy("pr_key").agg(F.sort_array(F.collect_list(F.struct("slice_no", "pos", body_line().alias("text")))).alias("ls"))
    return inline, rest.select("pr_key", F.concat(F.lit(f"\n\n**{heading}:**\n"), F.array_join("ls.text", "")).alias("body"))


def fallback(inline: DataFrame, bodies: DataFrame, failed: DataFrame, heading: str) -> DataFrame:
    """(pr_key, comment) for changes whose inline comments could not be created: the inline findings as a list, then the body."""
    lost = inline.join(failed.select("pr_key").distinct(), "pr_key", "left_semi").groupBy("pr_key").agg(F.sort_array(F.collect_list(F.struct("path", "line", "comment"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda c: F.concat(F.lit("- `"), c["path"], F.lit(":"), c["line"].cast("string"), F.lit("` "), c["comment"], F.lit("\n"))), "")
    return lost.join(bodies, "pr_key", "left").select("pr_key", F.concat(F.lit(f"\n\n**{heading}:**\n"), text, F.coalesce("body", F.lit(""))).alias("comment"))


def severity_counts(findings: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("pr_key").agg(F.count("*").alias("n_findings"), count("CRITICAL").alias("critical"), count("WARNING").alias("warning"), count("SUGGESTION").alias("suggestion"))


def review_comment(comments: DataFrame, totals: DataFrame, counts: DataFrame) -> DataFrame:
    """(pr_key, comment): plan comments with what the review found below them.

    ``totals`` comes from ``review_totals`` and ``counts`` from ``severity_counts``; a change without totals was not reviewed.
    """
    # The texts of the comment.
    met = comments.join(totals.select("pr_key", "available", "model", "prompt_tokens", "completion_tokens", "dropped"), "pr_key", "left").join(counts, "pr_key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    found = F.when(F.coalesce("n_findings", F.lit(0)) == 0, "No issues found.\n").otherwise(
        F.concat(F.lit("**"), number("n_findings"), F.lit("** findings (critical="), number("critical"), F.lit(", warning="), number("warning"), F.lit(", suggestion="), number("suggestion"), F.lit(")\n")))
    dropped = F.when(F.col("dropped") > 0, F.concat(F.lit(" · dropped malformed findings: "), number("dropped"))).otherwise("")
    reviewed = F.concat(F.lit("Model `"), F.coalesce("model", F.lit("")), F.lit("` · tokens: prompt="), number("prompt_tokens"), F.lit(", completion="), number("completion_tokens"), dropped, F.lit("\n"), found)
    lost = F.lit("LLM review unavailable (service down or not configured); context summary only.\n")
    return met.select("pr_key", F.concat("comment", F.lit("\n### LLM Review\n"), F.when(F.coalesce("available", F.lit(False)), reviewed).otherwise(lost)).alias("comment"))


def method_list(symbols: DataFrame, most: int = 10) -> DataFrame:
    """(pr_key, methods): distinct ids in order, the first ``most`` and a mark if there are more. Only so many ids are gathered."""
    rank = F.row_number().over(Window.partitionBy("pr_key").orderBy("symbol_id"))
    first = symbols.select("pr_key", "symbol_id").where("symbol_id IS NOT NULL").distinct().withColumn("rank", rank).where(F.col("rank") <= most + 1)
    ids = first.groupBy("pr_key").agg(F.array_sort(F.collect_list("symbol_id")).alias("ids"))
    listed = symbols.select("pr_key").distinct().join(ids, "pr_key", "left").select("pr_key", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return listed.select("pr_key", F.when(F.size("ids") > most, F.concat(F.slice("ids", 1, most), F.array(F.lit("…")))).otherwise(F.col("ids")).alias("methods"))
