import itertools
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from patchweave.config import ReviewConfig
from patchweave.operators import freeze, items, packing, slicing


def _slices(spark, required, edges, budget):
    r = spark.createDataFrame([("p", *x) for x in required], "pr_key string, path string, tokens int")
    e = spark.createDataFrame([("p", *x) for x in edges], "pr_key string, from_path string, to_path string")
    got = {}
    for row in slicing.slice_paths(r, e, budget).collect():
        got.setdefault(row.slice_no, set()).add(row.path)
    return [got[k] for k in sorted(got)]


def brute_slices(required, edges, budget):
    """Slices by the rules: search from each path, folders for single paths, and groups over the budget path by path."""
    tokens = Counter()
    for path, n in required:
        tokens[path] += n
    near = {p: {b for a, b in edges if a == p} | {a for a, b in edges if b == p} for p in tokens}
    groups, seen = {}, set()
    for path in sorted(tokens):
        if path in seen:
            continue
        found, queue = set(), [path]
        while queue:
            at = queue.pop()
            if at not in found and at in tokens:
                found.add(at)
                queue += near[at]
        seen |= found
        key = ("root", path) if len(found) > 1 else ("dir", path.rpartition("/")[0])
        groups.setdefault(key, set()).update(found)
    apart = [g for g in groups.values() if len(g) > 1 and sum(tokens[p] for p in g) > budget]
    return sorted([g for g in groups.values() if g not in apart] + [{p} for g in apart for p in g], key=min)


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_slices_against_brute_force(spark, monkeypatch, held):
    """Random graphs, several changes at a time; with a small union-find the trees of a task have to be joined by the rounds."""
    monkeypatch.setattr(slicing, "FOREST_PATHS", held)
    rng, want, required, edges = random.Random(7), {}, [], []
    for k in range(12):
        names = [f"{rng.choice('abc')}/{rng.choice('xyz')}{j}" for j in range(rng.randint(1, 30))]
        own = [(rng.choice(names), rng.randint(1, 30)) for _ in range(2 * len(names))]
        links = [(rng.choice(names), rng.choice([*names, "gone/1"])) for _ in range(rng.randint(0, len(names)))]
        want[f"c{k}"] = brute_slices(own, links, 200)
        required += [(f"c{k}", *r) for r in own]
        edges += [(f"c{k}", *e) for e in links]
    r = spark.createDataFrame(required, "pr_key string, path string, tokens int")
    e = spark.createDataFrame(edges, "pr_key string, from_path string, to_path string").repartition(3)
    got = defaultdict(lambda: defaultdict(set))
    for row in slicing.slice_paths(r, e, 200).collect():
        got[row.pr_key][row.slice_no].add(row.path)
    assert {c: [g[n] for n in sorted(g)] for c, g in got.items()} == want
    assert {len(w) for w in want.values()} != {1}


def test_slices_of_chains_and_nothing(spark):
    assert _slices(spark, [], [], 9) == []
    chain = [(f"n{k:02}/f", 1) for k in range(40)]
    assert _slices(spark, chain, [(a[0], b[0]) for a, b in itertools.pairwise(chain)], 99) == [{c[0] for c in chain}]


def test_every_change_has_a_slice(spark):
    none = spark.createDataFrame([], "pr_key string, slice_no int, path string")
    assert slicing.with_fallback(none, spark.createDataFrame([("p",)], "pr_key string")).collect()[0].slice_no == 1


def _row(i, path, tokens, value, required=False, requires=(), line=None):
    return {"item_id": i, "path": path, "start_line": line, "tokens": tokens, "required": required, "requires": list(requires), "value": value}


def test_pack_cases():
    assert packing.pack_slice([_row("R", "a", 100, 1, True)], 10) == (["R"], [])
    assert packing.pack_slice([_row("M", "a", 10, 5, requires=["C"]), _row("C", "a", 10, 0.1)], 20) == (["C", "M"], [])
    assert packing.pack_slice([_row("R", "a", 80, 1, True), _row("big", "b", 50, 10)], 100) == (["R"], ["big"])
    assert packing.pack_slice([_row("low", "a/A", 10, 5), _row("high", "a/B", 10, 9)], 10) == (["high"], ["low"])
    rows = [_row("R", "a", 20, 1, True), *(_row(x, x, 10, 5) for x in "xyz")]
    assert {tuple(packing.pack_slice(list(p), 40)[0]) for p in itertools.permutations(rows)} == {("R", "x", "y")}
    cycle = [_row("A", "a", 5, 1, requires=["B"]), _row("B", "b", 5, 1, requires=["A", "none"])]
    assert packing.pack_slice(cycle, 10) == (["A", "B"], [])
    assert packing.pack_slice([], 10) == ([], [])


def test_greedy_agrees_with_the_general_walk():
    random.seed(3)
    for _ in range(200):
        rows = [_row(f"i{k}", f"p{random.randint(0, 3)}", random.randint(0, 9), random.random(), random.random() < 0.2) for k in range(8)]
        plain = packing.pack_slice(rows, 20)
        # an item that requires an unknown id is packed alike, but by the general walk
        general = packing.pack_slice([r | {"requires": ["unknown"]} for r in rows], 20)
        assert plain == general


def test_general_walk_against_brute_force():
    """Each time the best offer of all that fit, worked out anew, as the rule says."""
    def brute(rows, budget):
        items = {}
        for r in rows:
            items.setdefault(r["item_id"], r)
        rank = {i: k for k, i in enumerate(sorted(items, key=lambda i: (items[i]["path"], i)))}
        taken, used = [], 0

        def closure(i, found):
            if i in items and i not in found and i not in taken:
                found.add(i)
                for r in items[i]["requires"]:
                    closure(r, found)
            return found

        def take(i):
            new = sorted(closure(i, set()), key=rank.get)
            taken.extend(new)
            return sum(items[j]["tokens"] for j in new)

        for i in sorted(items, key=rank.get):
            if items[i]["required"] and i not in taken:
                used += take(i)
        while True:
            offers = []
            for i in sorted(items, key=rank.get):
                if not items[i]["required"] and i not in taken:
                    parts = sorted(closure(i, set()), key=rank.get)
                    cost = sum(items[j]["tokens"] for j in parts) or 1
                    if used + cost <= budget:
                        offers.append((-sum(items[j]["value"] for j in parts) / cost, rank[i], i))
            if not offers:
                return taken, [i for i in sorted(items, key=rank.get) if not items[i]["required"] and i not in taken]
            used += take(min(offers)[2])

    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 12)
        rows = [_row(f"i{k}", f"p{rng.randint(0, 3)}", rng.randint(0, 9), rng.choice((0.25, 0.5, 1.0, 2.0)), rng.random() < 0.15, [f"i{rng.randint(0, n)}" for _ in range(rng.choice((0, 0, 1, 2)))]) for k in range(n)]
        budget = rng.randint(0, 40)
        assert packing.pack_slice(rows, budget) == brute(rows, budget)
    many = [_row(f"i{k}", "p", 3, k % 17, False, [f"i{k - k % 10}"]) for k in range(20_000)]
    assert len(packing.pack_slice(many, 30_000)[0]) == 10_000


def test_pack_frame(spark):
    rows = [("p", 1, "a", "f", None, 5, False, [], 1.0), ("p", 1, "b", "f", 3, 5, False, [], 2.0), ("q", 1, "c", "f", 3, 5, True, [], 0.0)]
    df = spark.createDataFrame(rows, "pr_key string, slice_no int, item_id string, path string, start_line int, tokens int, required boolean, requires array<string>, value double")
    got = {(r.pr_key, r.item_id): (r.status, r.pack_ord) for r in packing.pack_slices(df, 5).collect()}
    assert got == {("p", "b"): ("included", 0), ("p", "a"): ("dropped", 0), ("q", "c"): ("included", 0)}


def test_items(spark):
    config = ReviewConfig()
    symbols = spark.createDataFrame([("p", 0, "HEAD", "src/Foo.java", "com.x.Foo", "save", "save()", 0, 4, 5), ("p", 1, "MERGE_BASE", "src/Foo.java", "com.x.Foo", "save", "save()", 0, 2, 2), ("p", 2, "HEAD", "src/CredentialsService.java", "com.x.C", "m", "m()", 0, 1, 1)],
                                    "pr_key string, sym_ord int, side string, path string, class_fqn string, method_name string, signature string, arity int, start_line int, end_line int")
    contents = spark.createDataFrame([("p", "HEAD", "src/Foo.java", "package com.x;\n\nclass Foo {\n  void save() {\n  }\n}"), ("p", "MERGE_BASE", "src/Foo.java", "x\nold body\n"), ("p", "HEAD", "src/CredentialsService.java", "secret")], "pr_key string, side string, path string, content string")
    got = {r.item_id: r for r in items.symbol_items(symbols, contents, config).collect()}
    assert set(got) == {"METHOD#com.x.Foo#save()", "CLASS#com.x.Foo"}
    assert got["METHOD#com.x.Foo#save()"].content == "old body" and got["METHOD#com.x.Foo#save()"].requires == ["CLASS#com.x.Foo"]
    assert got["CLASS#com.x.Foo"].content == "package com.x;\nclass Foo {" and not got["CLASS#com.x.Foo"].required
    assert items.symbol_items(symbols, contents, ReviewConfig(emit_sensitive_methods=True)).count() == 4


def test_related_items(spark):
    edges = spark.createDataFrame([("p", 0, "CALLS", "src/Caller.java", 2, 4, "c#m", 0.7, "src/Foo.java"), ("p", 1, "CALLS", "src/Caller.java", 2, 4, "c#n", 0.85, "src/Bar.java"), ("p", 2, "CALLS", "src/Foo.java", 1, 1, "x", 0.9, "src/Bar.java"), ("p", 3, "CALLS", "config/.env", None, None, None, 0.9, "src/Foo.java"), ("p", 4, "TESTED_BY", "gone", None, None, None, 0.9, "src/Foo.java")],
                                  "pr_key string, edge_ord int, edge_type string, from_path string, from_line int, from_end int, from_symbol string, confidence double, to_path string")
    changed = spark.createDataFrame([("p", "src/Foo.java")], "pr_key string, path string")
    snapshot = spark.createDataFrame([("p", "src/Caller.java", "1\n2\n3\n4\n5"), ("p", "config/.env", "x")], "pr_key string, path string, content string")
    got = items.related_items(edges, changed, snapshot, ReviewConfig()).collect()
    assert [(r.item_id, r.content, r.confidence, r.owner_path) for r in got] == [("CALLER#src/Caller.java#2", "2\n3\n4", 0.85, "src/Foo.java")]


def test_prefixes(spark):
    cases = [("multiple", ["a/x", "b/y"]), ("multiple", ["a/x", "y"]), ("root", ["x", "y"]), ("root", ["x", "a/y"]), ("a/b", ["a/b/x", "a/bc/y"]), ("misc", []), ("a", ["a/b/x", "a/c/y"]), ("a/b", ["a/b/x"])]
    df = spark.createDataFrame(cases, "want string, paths array<string>")
    assert [r for r in df.withColumn("got", freeze.common_prefix_dir(F.col("paths"))).collect() if r.got != r.want] == []


def test_freeze_is_idempotent(spark, tmp_path):
    plans = spark.createDataFrame([("aa1", json.dumps({"contextId": "aa1"})), ("bb2", "broken{")], "context_id string, plan_json string")
    store = str(tmp_path / "store")
    freeze.freeze(plans, store)
    freeze.freeze(plans, store)
    kept = spark.read.parquet(store)
    assert kept.count() == 2
    build, known = freeze.reuse(plans.select("context_id", F.lit("p").alias("pr_key")), kept)
    assert [r.context_id for r in build.collect()] == ["bb2"] and [r.context_id for r in known.collect()] == ["aa1"]


def test_summary_states(spark):
    files = spark.createDataFrame([("p", "a", "x", 3, 1), ("p", "b", None, 0, 0), ("q", "c", "y", 1, 1)], "pr_key string, path string, patch string, additions int, deletions int")
    checks = spark.createDataFrame([("p", "a", 2, None), ("q", "c", 1, None)], "pr_key string, path string, n_hunks long, error string")
    got = {r.pr_key: (r.n_files, r.additions, r.n_hunks, r.missing_patches, r.patch_state) for r in freeze.change_summary(files, checks).collect()}
    assert got == {"p": (2, 3, 2, 1, "PARTIAL"), "q": (1, 1, 1, 0, "COMPLETE")}
