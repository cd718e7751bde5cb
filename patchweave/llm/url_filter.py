"""URL allow and block rules: a trie over reversed host labels, then path segments; the longest rule wins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchweave.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A trie is broadcast up to this many rules; a longer list is joined instead.
MAX_BROADCAST_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


class _Node:
    """``ends`` holds the rules that end inside the next path segment: (start of that segment, rule)."""

    __slots__ = ("ends", "hosts", "segments")

    def __init__(self) -> None:
        self.hosts: dict[str, _Node] = {}
        self.segments: dict[str, _Node] = {}
        self.ends: list[tuple[str, Rule]] = []


class UrlTrie:
    """A rule fits its host and all subdomains, if the url's path starts with the rule's path."""

    def __init__(self, rules: list[Rule]) -> None:
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.hosts.setdefault(label, _Node())
            *whole, part = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            node.ends.append((part, rule))

    def match(self, host: str, path: str) -> Rule | None:
        """The rule with most host labels, then with the longest path; the later one of two equal rules."""
        segments, best, node = path.split("/"), None, self.root
        # the first step stays at the root; a later empty label, as of a trailing dot, is one like any other
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.hosts.get(label)
                if node is None:
                    break
            best = self._longest(node, segments) or best
        return best

    @staticmethod
    def _longest(node: _Node, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            fit = [(len(part), k) for k, (part, _) in enumerate(node.ends) if segment.startswith(part)]
            if fit:
                best = node.ends[max(fit)[1]][1]
            node = node.segments.get(segment)
            if node is None:
                break
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(urls: DataFrame, rules: list[Rule], id_col: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges every url: (id, host, path, rule, verdict), one row for each input row, repeated rows included.

    ``rule`` is null and ``verdict`` is ``default`` where no rule fits. A null url, and one without
    ``://``, has an empty host and path, which only a rule without host and path would fit. Null ids are kept.
    Other columns are ignored. No shuffle: the trie is broadcast if the list is at most
    MAX_BROADCAST_RULES long; longer lists are hash-joined on host suffixes.
    """
    host, path = url_parts(F.col(url_col))
    parts = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if len(rules) > MAX_BROADCAST_RULES:
        return _joined(parts, rules, id_col, default)
    spark = urls.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(list(rules)))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = trie.value
        for hosts, paths in batches:
            found = [known.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r.name if r else None for r in found], "verdict": [r.verdict if r else default for r in found]})

    return parts.withColumn("_judged", judge("host", "path")).select(id_col, "host", "path", "_judged.rule", "_judged.verdict")


def _joined(parts: DataFrame, rules: list[Rule], id_col: str, default: str) -> DataFrame:
    """The same verdicts by a join on host suffixes, once for each distinct (host, path)."""
    spark = parts.sparkSession
    listed = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "ord int, r_verdict string, r_host string, r_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels) + 1), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    best = F.max(F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.col("ord"), F.col("r_host"), F.col("r_path"), F.col("r_verdict")))
    asked = parts.select("host", "path").distinct().withColumn("suffix", F.explode(F.array_distinct(suffixes)))
    found = asked.join(listed, (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path"))).groupBy("host", "path").agg(best.alias("best"))
    rule = F.concat("best.r_host", "best.r_path")
    return parts.join(found, ["host", "path"], "left").select(id_col, "host", "path", rule.alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), list(RULES), "page_id")


SQL = r"""
WITH rest AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
