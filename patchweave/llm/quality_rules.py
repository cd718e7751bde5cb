"""Learned decision lists: sequential covering grows and prunes threshold conjunctions from labelled statistics.

The list is learned on the driver from a bounded sample of labelled rows and becomes an ordered Spark conditional
expression over the statistics of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.llm.common import bounded_batches, fresh, table

#: Characters that count as symbols, words of a window, and the base rules' limits.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 5, 10, 20
#: At most so many labelled rows are learned from, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_upper", "n_exclaim", "n_digits")
#: Interpretable statistics: a count, and what it is a share of.
FEATURES = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "unique_share": ("n_unique_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_per_word": ("n_exclaim", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_STAT_TYPE = "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of five which the text has twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    key, base = ids[:n], len(number)
    for k in range(1, WINDOW):
        if k == 3 or (k == 4 and base > 1000) or base > 2_000_000:  # ranks keep the numbers below 2**63 whatever the text's length
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[k : n + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The STATS of a whole text; a null text has no words and no lines."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    return (len(words), chars, sum(raw.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), len(set(words)), len(raw) - len(raw.translate(None, _UPPER)), raw.count(b"!"), len(raw) - len(raw.translate(None, _DIGITS)))


def _stats_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="int64")


def stats_of(text: str) -> Column:
    """A struct of the STATS of a text column."""
    return F.pandas_udf(_stats_batches, _STAT_TYPE)(F.col(text))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: pd.DataFrame) -> np.ndarray:
        v = values[self.feature].to_numpy()
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, stats: str) -> Column:
        count, whole = FEATURES[self.feature]
        value = F.col(stats)[count].cast("double")
        value = value / F.greatest(F.col(stats)[whole], F.lit(1)) if whole else value
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def features(stats: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({f: stats[n].astype(float) / np.maximum(stats[w], 1) if w else stats[n].astype(float) for f, (n, w) in FEATURES.items()})


def _covered(rule: Rule, values: pd.DataFrame) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(values) for c in rule), np.ones(len(values), bool))


def _best_condition(values: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Condition | None]:
    """The condition of most information gain: bad rows kept, times the bits of purity gained."""
    best, found, purity = 0.0, None, np.log2(bad.mean()) if bad.any() else 0.0
    for name in FEATURES:
        v = values[name].to_numpy()
        order = np.argsort(v, kind="stable")
        ranked, hits = v[order], np.concatenate(([0], np.cumsum(bad[order])))
        for above in (True, False):
            at = np.searchsorted(ranked, cuts[name], side="left" if above else "right")
            p = hits[-1] - hits[at] if above else hits[at]
            n = len(v) - at if above else at
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - purity), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, above, float(cuts[name][k]))
    return best, found


def learn_rules(stats: pd.DataFrame, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_rows: int = 3) -> list[Rule]:
    """An ordered list of conjunctions that cover bad rows.

    Two thirds of the rows grow a rule, condition by condition; the others prune its last conditions as long as precision does
    not fall. A rule stays if over all remaining rows it covers ``min_rows`` or more at ``min_precision``; then the
    rows it covers are set aside. No bad rows, or bad rows only, give no rules.
    """
    values, rules, left = features(stats), [], np.ones(len(stats), bool)
    if not bad.any() or bad.all():
        return []
    cuts = {f: np.unique(np.quantile(np.concatenate((values[f][bad], values[f][~bad])), np.linspace(0, 1, 101)).tolist() + np.quantile(values[f][bad], np.linspace(0, 1, 41)).tolist()) for f in FEATURES}
    grows = np.arange(len(stats)) % 3 != 2
    while len(rules) < max_rules and (bad & left).sum() >= min_rows:
        rule: Rule = ()
        inside = left & grows
        while len(rule) < max_conditions and (inside & ~bad).any() and (inside & bad).any():
            _, condition = _best_condition(values[inside], bad[inside], cuts)
            if condition is None or condition in rule:
                break
            rule += (condition,)
            inside &= condition.holds(values)

        def worth(r: Rule, on: np.ndarray) -> float:
            hit = _covered(r, values) & on
            return (1.0 + (hit & bad).sum()) / (2.0 + hit.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, left & ~grows), default=())
        hit = _covered(rule, values) & left if rule else np.zeros(len(stats), bool)
        if hit.sum() < min_rows or (hit & bad).sum() < min_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def first_rule(rules: list[Rule], stats: str) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    fired = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(reduce(lambda a, b: a & b, (c.column(stats) for c in rule)), F.lit(k)).otherwise(fired)
    return fired


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the labelled documents that pass the base rules; label 0 is bad.

    Null ids and labels are left out; of several labels of an id the lowest counts, of several texts the one with the lowest stats.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows rows at most
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", stats_of("text").alias("stats"))
    once = texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("stats").alias("stats")).where(~base_failed("stats"))
    rows = once.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "stats.*").toPandas()
    return learn_rules(rows[list(STATS)], (rows["label"] == 0).to_numpy(dtype=bool))


def judge_documents(docs: DataFrame, rules: list[Rule], stats_col: str = "stats", rule_col: str = "rule", kept_col: str = "kept") -> DataFrame:
    """All columns of ``docs``, the statistics, the rule that fired and the verdict, one row for each input row.

    A null or empty text has no words and fails the base rules. Clashing names get leading underscores.
    """
    stats, rule, kept = fresh(docs.columns, stats_col, rule_col, kept_col)
    out = docs.withColumn(stats, stats_of("text"))
    out = out.withColumn(rule, F.when(base_failed(stats), F.lit(0)).otherwise(first_rule(rules, stats)))
    return out.withColumn(kept, F.col(rule).isNull())


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, with their columns.

    A null or empty text fails the base rules and goes. Repeated rows stay or go together; rows of null doc_id are judged by their text.
    Without labels only the base rules judge. An empty table stays empty.
    """
    stats, rule, kept = fresh(docs.columns, "stats", "rule", "kept")
    return judge_documents(docs, fit_rules(docs, labels)).where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_documents(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(F.col("stats")[s].alias(s) for s in STATS[:5]), (F.col("rule") == 0).alias("fb"), "kept", "rule").select(
        "doc_id", *STATS[:5], F.coalesce("fb", F.lit(False)).alias("base_failed"), "kept", "rule")
