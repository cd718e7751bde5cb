"""Co-change recall: files that were changed together with a changed file, in commits before the change.

Rules are worked out for the changed files alone, so no pairs of all files of a commit are formed. What was committed at or after a
change's time is never read for it, so a replay of an old change sees what its author could have seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.sources.scratch import stored

#: Commits of more files say nothing about pairs of them and are left out, of support and of counts.
WIDEST = 50
#: Least support and confidence of a rule, and commits that a repository must have before a change.
SUPPORT, CONFIDENCE, MIN_COMMITS = 3, 0.3, 200


def narrow_commits(history: DataFrame, widest: int = WIDEST) -> DataFrame:
    """(repo, commit, commit_ts, path) of the commits of at most ``widest`` files, each file once.

    Copies are told and files counted in one sort of a commit's rows, so the history is dealt out once, and not at all if it comes by commit.
    """
    named = history.where("path IS NOT NULL AND repo IS NOT NULL AND commit IS NOT NULL").select("repo", "commit", "commit_ts", "path")
    whole = Window.partitionBy("repo", "commit")
    order = whole.orderBy("commit_ts", "path")
    copy = F.col("path").eqNullSafe(F.lag("path").over(order)) & F.col("commit_ts").eqNullSafe(F.lag("commit_ts").over(order))
    told = named.withColumn("copy", copy).withColumn("files", F.count_if(~F.col("copy")).over(whole))
    return told.where(~F.col("copy") & (F.col("files") <= widest)).select("repo", "commit", "commit_ts", "path")


def history_before(history: DataFrame, revisions: DataFrame) -> DataFrame:
    """(pr_key, commits): how many commits a repository has before each change (pr_key, repo, pr_ts); null times have none.

    Commits are counted by day; a running sum over the days of a repository meets the changes as of their day, and only the commits of
    that same day are compared one by one.
    """
    commits = history.select("repo", "commit", "commit_ts").distinct().withColumn("day", F.to_date("commit_ts"))
    daily = commits.groupBy("repo", "day").agg(F.count("*").alias("n"))
    asked = revisions.where("pr_ts IS NOT NULL").select("pr_key", "repo", "pr_ts", F.to_date("pr_ts").alias("day"))
    both = daily.select("repo", "day", "n", F.lit(None).cast("string").alias("pr_key")).unionByName(asked.select("repo", "day", F.lit(0).cast("long").alias("n"), "pr_key"))
    earlier = Window.partitionBy("repo").orderBy(F.col("day").cast("timestamp").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    past = both.withColumn("past", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("pr_key IS NOT NULL").select("pr_key", "past")
    same = asked.join(commits, ["repo", "day"]).where("commit_ts < pr_ts").groupBy("pr_key").agg(F.count("*").alias("today"))
    met = revisions.select("pr_key").distinct().join(past, "pr_key", "left").join(same, "pr_key", "left")
    return met.select("pr_key", (F.coalesce("past", F.lit(0)) + F.coalesce("today", F.lit(0))).alias("commits"))


def channel_states(history: DataFrame, revisions: DataFrame, least: int = MIN_COMMITS) -> DataFrame:
    """(pr_key, co_change): ENABLED where the repository has ``least`` commits before the change, else UNAVAILABLE_NO_HISTORY."""
    enough = F.col("commits") >= least
    return history_before(history, revisions).select("pr_key", F.when(enough, "ENABLED").otherwise("UNAVAILABLE_NO_HISTORY").alias("co_change"))


def _pairs_by_time(asked: DataFrame, history: DataFrame) -> DataFrame:
    """(repo, to_path, path, at, n): how many commits of a time have both files; where the files are the same, how many have this one.

    Only pairs with a file of ``asked`` (repo, to_path, pr_ts) are formed, of commits before the last time that it is asked at.
    """
    wanted = stored(asked.groupBy("repo", F.col("to_path").alias("path")).agg(F.max("pr_ts").alias("last")), "wanted")
    marked = history.join(wanted, ["repo", "path"], "left").withColumn("asked", F.coalesce(F.col("commit_ts") < F.col("last"), F.lit(False)))
    files = marked.groupBy("repo", "commit").agg(F.collect_list(F.struct("commit_ts", "path", "asked")).alias("files"))
    one = files.select("repo", "files", F.explode(F.filter("files", lambda f: f["asked"])).alias("a"))
    two = one.select("repo", "a", F.explode("files").alias("b")).where("b.path != a.path OR b.commit_ts = a.commit_ts")
    return two.groupBy("repo", F.col("a.path").alias("to_path"), F.col("b.path").alias("path"), F.col("a.commit_ts").alias("at")).agg(F.count("*").alias("n"))


def co_change_rules(changed: DataFrame, revisions: DataFrame, history: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pr_key, to_path, path, support, commits, confidence): rules changed file -> other file, as of each change.

    ``changed`` has pr_key and path; ``revisions`` pr_key, repo and pr_ts, a row for each change; ``history`` comes from ``narrow_commits``.
    support counts the commits before the change with both files, commits those with the changed one. Files that the change itself
    touches are no partners. Commits are counted by time, and a running sum meets the times that are asked for, so no commit is met by
    all the changes after it.
    """
    own = changed.select("pr_key", "path").distinct()
    asked = stored(own.join(revisions.where("pr_ts IS NOT NULL").select("pr_key", "repo", "pr_ts"), "pr_key").withColumnRenamed("path", "to_path"), "asked")
    counted = stored(_pairs_by_time(asked, history), "pairs")
    pair = ["repo", "to_path", "path"]
    partners = counted.groupBy(*pair).agg(F.sum("n").alias("n")).where(F.col("n") >= support).drop("n")
    times = asked.select("repo", "to_path", F.col("pr_ts").alias("at")).distinct()
    both = counted.select(*pair, "at", "n").join(partners, pair, "left_semi").unionByName(times.join(partners, ["repo", "to_path"]).select(*pair, "at", F.lit(0).cast("long").alias("n")))
    # a time asked for comes before the commits of that time
    before = Window.partitionBy(*pair).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.withColumn("support", F.sum("n").over(before)).where("n = 0").withColumnRenamed("at", "pr_ts")
    whole = Window.partitionBy("repo", "to_path", "pr_ts")
    met = sums.withColumn("commits", F.max(F.when(F.col("path") == F.col("to_path"), F.col("support"))).over(whole)).where((F.col("path") != F.col("to_path")) & (F.col("support") >= support))
    rules = met.withColumn("confidence", F.col("support") / F.col("commits")).where(F.col("confidence") >= confidence)
    return rules.join(asked, ["repo", "to_path", "pr_ts"]).join(own, ["pr_key", "path"], "left_anti").select("pr_key", "to_path", "path", "support", "commits", "confidence")


def co_change_edges(rules: DataFrame) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return rules.select("pr_key", F.lit("CO_CHANGED").alias("edge_type"), F.col("path").alias("from_path"), none("int").alias("from_line"), none("string").alias("from_symbol"), F.lit("HEAD").alias("to_side"), "to_path",
                        none("int").alias("to_line"), none("string").alias("to_symbol"), "confidence", F.lit("CO_CHANGE").alias("source"))
