import re
from collections import Counter

import numpy as np
import pandas as pd

from patchweave.llm import quality_rules as q


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


TEXTS = [
    None, "", " \n\t\v\f\r ", "one", "a b c d e a b c d e", "a a a a a a", "x y\nx y\n x y\nx y\n\n\n", "é ü | ## $5 <b> & * %", "\u00a0 \x1c \x85 \u2003 a", "a b c d e f " * 3, "A b c d e a b c d e",
    "\r\nline one here\r\nline one here", " ".join(str(k % 1500) for k in range(9000)), "w " * 40_000, "long" * 60_000, " ".join(f"u{k}" for k in range(3000)) + " u1 u2 u3 u4 u5",
]


def test_stats_against_brute_force():
    for text in TEXTS:
        assert q.text_stats(text)[:5] == brute_stats(text), repr((text or "")[:40])


def labelled(n=600):
    rng = np.random.default_rng(0)
    good = [" ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(20, 80))) for _ in range(n)]
    junk = [" ".join(f"w{x}%%%" for x in rng.integers(0, 5000, rng.integers(20, 80))) for _ in range(n // 4)]
    shout = [" ".join(f"W{x}!!" for x in rng.integers(0, 5000, rng.integers(20, 80))) for _ in range(n // 4)]
    return [(t, 1) for t in good] + [(t, 0) for t in junk + shout]


def test_learned_rules_separate_and_keep_clean_rows():
    rows = labelled()
    stats = pd.DataFrame([q.text_stats(t) for t, _ in rows], columns=list(q.STATS))
    rules = q.learn_rules(stats, np.array([y == 0 for _, y in rows]))
    values, hit = q.features(stats), np.zeros(len(rows), bool)
    for rule in rules:
        hit |= q._covered(rule, values)
    y = np.array([y for _, y in rows])
    assert 1 <= len(rules) <= 4 and hit[y == 0].mean() > 0.98 and hit[y == 1].mean() == 0
    assert all(len(rule) <= 3 for rule in rules)


def test_noise_gives_no_rules():
    rng = np.random.default_rng(3)
    stats = pd.DataFrame(rng.integers(0, 100, (900, len(q.STATS))), columns=list(q.STATS))
    assert q.learn_rules(stats, rng.random(900) < 0.1) == []
    assert q.learn_rules(stats, np.zeros(900, bool)) == [] and q.learn_rules(stats, np.ones(900, bool)) == []


def test_spark_expression_agrees_with_the_rules(spark, docs_of):
    rows = labelled(200)
    docs = docs_of([(k, t) for k, (t, _) in enumerate(rows)] + [(None, "x " * 30), (9999, None), (5, rows[5][0])])
    labels = spark.createDataFrame([(k, y, 0) for k, (_, y) in enumerate(rows)] + [(None, 0, 0), (1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rules = q.fit_rules(docs, labels)
    judged = q.judge_documents(docs, rules, kept_col="verdict").collect()
    for r in judged:
        stats = q.text_stats(r.text)
        base = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        values = q.features(pd.DataFrame([stats], columns=list(q.STATS)))
        fired = next((k for k, rule in enumerate(rules, 1) if q._covered(rule, values)[0]), None)
        assert r["_rule"] == (0 if base else fired) and r.verdict == (not base and fired is None)
    kept = q.filter_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.verdict for r in judged)
    assert {r.doc_id for r in kept.collect()} >= {k for k, (t, y) in enumerate(rows) if y == 1}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.filter_quality(docs_of([]), none).count() == 0
    assert [r.doc_id for r in q.filter_quality(docs_of([(1, "a b c d e f g h i j k"), (2, "short")]), none).collect()] == [1]
