import datetime
import json
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from patchweave.config import SENSITIVE_PATTERNS, ReviewConfig
from patchweave.functions.paths import category
from patchweave.operators import history, lexical
from patchweave.plans.pipeline import Tables, build_plans


def words(text):
    out, last = [], ""
    for c in text or "":
        if c.isascii() and c.isupper() and last.isascii() and (last.islower() or last.isdigit()):
            out.append(" ")
        out.append(c.lower() if c.isascii() and c.isalnum() else " ")
        last = c
    return [w for w in "".join(out).split() if len(w) > 1]


def ranked(queries, own, files, top):
    """Every file against every query."""
    bags = {p: Counter(words(t)) for p, t in files.items() if not p.endswith(".pem")}
    bags = {p: b for p, b in bags.items() if b}
    total, df = sum(b.total() for b in bags.values()), Counter(w for b in bags.values() for w in b)
    out = set()
    for q, asked in queries.items():
        weight = {w: math.floor(1000 * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))) for w in asked if df[w]}
        scores = {}
        for p, b in bags.items():
            length = 1200 * (250 + 750 * b.total() * len(bags) // total) // 1000
            score = sum(k * (2200 * 1000 * b[w] // (1000 * b[w] + length)) for w, k in weight.items() if b[w])
            if score > 0 and (q[0], p) not in own:
                scores[p] = score
        out |= {(*q, p, s, sum(weight.values()) * 2200, k + 1) for k, (s, p) in enumerate(sorted((-s, p) for p, s in scores.items())[:top]) for s in [-s]}
    return out


def test_lexical_ranks_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 150}"
    files = {f"a/F{k}.java": " ".join(word() for _ in range(rng.choice([0, 3, 40, 400]))) for k in range(120)}
    files |= {"k/server.pem": "w1 w2 secret", "c/Camel.java": "fooBar HTTPServer x9Y é_zz", "c/null.java": None, "t/A.java": "w7 w8", "t/B.java": "w7 w8"}
    queries = {("p1", f"q{k}"): {word() for _ in range(rng.choice([1, 8, 60]))} for k in range(12)} | {("p2", "q"): {"foo", "bar", "zz", "nowhere"}, ("p2", "r"): {"nowhere"}, ("p1", "tie"): {"w7", "w8"}}
    own = {("p1", "a/F1.java"), ("p1", "a/F2.java"), ("p1", "t/A.java")}
    snapshot = spark.createDataFrame([("r", "h", p, t) for p, t in files.items()] + [("r", "other", "z/Z.java", "w1 w2 w3 foo")], "repo string, sha string, path string, content string")
    asked = spark.createDataFrame([(*q, w) for q, ws in queries.items() for w in ws], "pr_key string, to_path string, word string")
    heads = spark.createDataFrame([("p1", "r", "h"), ("p2", "r", "h")], "pr_key string, repo string, sha string")
    index = lexical.index_files(snapshot, SENSITIVE_PATTERNS, 256)
    got = lexical.related_files(asked, spark.createDataFrame(sorted(own), "pr_key string, path string"), index, heads, 4)
    assert {tuple(r) for r in got.collect()} == ranked(queries, own, files, 4)


DAY = datetime.datetime(2024, 1, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def test_rules_see_nothing_later(spark):
    rng = random.Random(8)
    commits = [("r", f"c{k}", at(k), f"f{f}") for k in range(300) for f in {int(rng.paretovariate(0.9)) % 9 for _ in range(rng.randint(1, 5))}]
    wide = [("r", "wide", at(5), f"f{k}") for k in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "repo string, commit string, commit_ts timestamp, path string")
    times = {"p0": 0, "p1": 40, "p2": 40.5, "p3": 10_000}
    revisions = spark.createDataFrame([*((p, "r", at(h)) for p, h in times.items()), ("p4", "s", at(50)), ("p5", "r", None)], "pr_key string, repo string, pr_ts timestamp")
    changed = spark.createDataFrame([(p, f) for p in [*times, "p4", "p5"] for f in ("f1", "f2")], "pr_key string, path string")
    by_commit = defaultdict(set)
    for _, c, ts, f in commits:
        by_commit[ts, c].add(f)
    want = set()
    for p, h in times.items():
        past = [fs for (ts, _), fs in by_commit.items() if ts < at(h)]
        for a in ("f1", "f2"):
            n = sum(a in fs for fs in past)
            both = Counter(b for fs in past if a in fs for b in fs - {"f1", "f2"})
            want |= {(p, a, b, k, n, k / n) for b, k in both.items() if k >= 3 and k / n >= 0.1}
    past = frame([*commits, *commits[:50], *wide])
    got = history.co_change_rules(changed, revisions, history.narrow_commits(past), confidence=0.1)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 6
    # what is committed from a change's time on leaves its rules and its gate as they were
    later = frame([("r", f"later{k}", at(40 + k), f) for k in range(500) for f in ("f1", "f8")])
    again = history.co_change_rules(changed, revisions, history.narrow_commits(past.union(later)), confidence=0.1).where("pr_key IN ('p0', 'p1')")
    assert {tuple(r) for r in again.collect()} == {w for w in want if w[0] in ("p0", "p1")}
    counts = {r.pr_key: r.commits for r in history.history_before(past.union(later), revisions).collect()}
    assert counts == {"p0": 0, "p1": 41, "p2": 43, "p3": 801, "p4": 0, "p5": 0}


def written(spark, run):
    """What ``run`` returns, and the bytes that were shuffled meanwhile."""
    def so_far():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = so_far()
    return run(), so_far() - before


def test_lexical_ranks_in_parts_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Small limits give the same ranks, and with wide ones what is shuffled does not grow with files times queries."""
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 300}"
    files = {f"a/F{k}.java": " ".join(word() for _ in range(40)) for k in range(1500)}
    queries = {(f"p{k % 3}", f"q{k}"): {word() for _ in range(30)} for k in range(40)}
    own = {(f"p{k % 3}", f"a/F{k}.java") for k in range(0, 1500, 7)}
    snapshot = spark.createDataFrame([("r", "h", p, t) for p, t in files.items()], "repo string, sha string, path string, content string")
    asked = spark.createDataFrame([(*q, w) for q, ws in queries.items() for w in ws], "pr_key string, to_path string, word string")
    heads, changed = spark.createDataFrame([(f"p{k}", "r", "h") for k in range(3)], "pr_key string, repo string, sha string"), spark.createDataFrame(sorted(own), "pr_key string, path string")
    run = lambda: {tuple(r) for r in lexical.related_files(asked, changed, lexical.index_files(snapshot, SENSITIVE_PATTERNS, 256), heads).collect()}
    got, size = written(spark, run)
    assert got == ranked(queries, own, files, 5)
    assert size < 300_000
    monkeypatch.setattr(lexical, "QUERY_WORDS", 300, raising=False)
    monkeypatch.setattr(lexical, "CELLS", 100, raising=False)
    assert run() == got


def test_rules_do_not_grow_with_changes_times_commits(spark):
    n = 1000
    past = spark.range(n).selectExpr("'r' AS repo", "id AS commit", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS commit_ts", "explode(array('f1', 'f2')) AS path")
    revisions = spark.range(n).selectExpr("concat('p', id) AS pr_key", "'r' AS repo", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS pr_ts")
    changed = revisions.selectExpr("pr_key", "'f1' AS path")
    width = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, size = written(spark, lambda: history.co_change_rules(changed, revisions, history.narrow_commits(past)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", width)
    assert {tuple(r) for r in got} == {(f"p{k}", "f1", "f2", k, k, 1.0) for k in range(3, n)}
    assert size < 1_000_000  # a million pairs of a change and a commit before it took more


def test_channels_in_a_build(spark):
    a, b, c, d = (f"src/main/java/x/{n}.java" for n in ("Invoice", "Ledger", "Other", "Printer"))
    revisions = spark.createDataFrame([("r#1", "r", 1, "b", "h", at(100)), ("s#1", "s", 1, "b", "h", at(100))], "pr_key string, repo string, pr_number int, merge_base string, head string, pr_ts timestamp")
    patch = "@@ -1,1 +1,2 @@\n class Invoice {}\n+// reconcile ledgerBalance with quarterly totals"
    files = spark.createDataFrame([(p, a, None, "MODIFY", patch, 1, 0) for p in ("r#1", "s#1")], "pr_key string, path string, previous_path string, change_type string, patch string, additions int, deletions int").withColumn("category", category(F.col("path")))
    texts = {a: "class Invoice {}\n// reconcile ledgerBalance with quarterly totals\n", b: "class Ledger { int ledgerBalance; void reconcile() {} }\n", c: "class Other { int x; }\n", d: "class Printer {}\n", "conf/secrets.txt": "reconcile ledgerBalance quarterly"}
    schema = "repo string, sha string, path string, content string"
    snapshot = spark.createDataFrame([(r, "h", p, t) for r in "rs" for p, t in texts.items()], schema)
    past = spark.createDataFrame([("r", f"c{k}", at(k), f) for k in range(90) for f in ((a, d) if k < 4 else (c,))] + [("s", "c", at(1), a)], "repo string, commit string, commit_ts timestamp, path string")
    built = build_plans(Tables(revisions, files, snapshot, spark.createDataFrame([("r", "b", a, "class Invoice {}\n")], schema), past), ReviewConfig(bm25=True, co_change=True))
    states = {r.pr_key: json.loads(r.plan_json)["capabilities"] for r in built["plans"].collect()}
    assert {k: (s["lexicalRecall"], s["coChange"]) for k, s in states.items()} == {"r#1": ("ENABLED", "UNAVAILABLE_NO_HISTORY"), "s#1": ("ENABLED", "UNAVAILABLE_NO_HISTORY")}
    edges = {(r.pr_key, r.source, r.from_path, r.to_path) for r in built["edges"].collect()}
    assert edges == {(p, "LEXICAL_BM25", b, a) for p in ("r#1", "s#1")}
    items = {(r.pr_key, r.item_id, r.content) for r in built["items"].where("kind = 'RELATED_FILE'").collect()}
    assert items == {(p, f"RELATED_FILE#{b}#file", texts[b]) for p in ("r#1", "s#1")}
    rules = history.co_change_rules(files, revisions, history.narrow_commits(past))
    assert {(r.pr_key, r.from_path, r.source) for r in history.co_change_edges(rules).collect()} == {("r#1", d, "CO_CHANGE")}
