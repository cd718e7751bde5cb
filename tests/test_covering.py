import random
import time

import pytest
from pyspark.sql import functions as F

from patchweave.operators import covering, packing

SCHEMA = "pr_key string, slice_no int, item_id string, path string, start_line int, tokens int, required boolean, requires array<string>, value double, pieces array<bigint>"


def row(item, tokens=10, value=1.0, pieces=(), required=False, requires=(), path="a", start=None):
    return {"item_id": item, "path": path, "start_line": start, "tokens": tokens, "required": required, "requires": list(requires), "value": value, "pieces": list(pieces)}


def brute(rows, budget):
    """Every open item is valued anew before each choice."""
    items, rank = packing.ranked(rows)
    taken, used = [], 0

    def needs(item):
        found, queue = set(), [item]
        while queue:
            i = queue.pop()
            if i not in found and i not in taken:
                found.add(i)
                queue += [r for r in items[i]["requires"] if r in items]
        return sorted(found, key=rank.get)

    for i in items:
        if items[i]["required"]:
            new = needs(i)
            used += sum(items[n]["tokens"] for n in new)
            taken += new
    while True:
        offers = []
        for i in items:
            new = needs(i)
            cost = sum(items[n]["tokens"] for n in new) or 1
            if i in taken or used + cost > budget:
                continue
            shown = {p for t in taken for p in items[t]["pieces"]}
            gain, fresh_ones = 0.0, 0
            for n in new:
                parts = items[n]["pieces"]
                fresh = set(parts) - shown
                shown |= fresh
                fresh_ones += len(fresh) + (not parts)
                gain += items[n]["value"] * len(fresh) / len(parts) if parts else items[n]["value"]
            if fresh_ones:
                offers.append((-gain / cost, rank[i], i, new))
        if not offers:
            return taken, [i for i in items if not items[i]["required"] and i not in taken]
        new = min(offers)[3]
        used += sum(items[n]["tokens"] for n in new)
        taken += new


def test_a_copy_is_not_paid_for_twice():
    a, copy, other = row("a", pieces=[1, 2], value=0.9), row("b", pieces=[1, 2], value=0.8), row("c", pieces=[3], value=0.1)
    assert covering.pack_slice([a, copy, other], 20) == (["a", "c"], ["b"])
    assert packing.pack_slice([a, copy, other], 20) == (["a", "b"], ["c"])
    assert covering.pack_slice([copy, a | {"required": True}], 99) == (["a"], ["b"])
    # half of it is new, which still beats the poorer one
    assert covering.pack_slice([a, copy | {"pieces": [2, 3]}, row("d", pieces=[9], value=0.3)], 20) == (["a", "b"], ["d"])


def test_items_without_pieces_and_no_items():
    plain = [row("x", value=2.0), row("y"), row("x", value=9.0)]
    assert covering.pack_slice(plain, 20) == packing.pack_slice(plain, 20) == (["x", "y"], [])
    assert covering.pack_slice([], 5) == ([], [])
    assert covering.pack_slice([row("r", 9, required=True), row("s", 0, 0.0, [1])], 1) == (["r"], ["s"])
    assert covering.pack_slice([row("s", 0, 0.0, [1])], 1) == (["s"], [])


def test_what_a_closure_shares_counts_once():
    shared = [row("m", 5, 1.0, [1, 2], requires=["h"]), row("h", 5, 0.5, [1, 2]), row("n", 10, 1.2, [7])]
    assert covering.pack_slice(shared, 10) == (["n"], ["h", "m"])


@pytest.mark.parametrize("seed", range(300))
def test_equals_valuing_everything_anew(seed):
    rng = random.Random(seed)
    ids = [f"i{k}" for k in range(rng.randrange(1, 11))]
    rows = [row(i, rng.randrange(0, 9), rng.choice([0.0, 0.5, 0.8, 0.9]), rng.sample(range(8), rng.randrange(0, 5)), rng.random() < 0.1, rng.sample([*ids, "unknown"], rng.choice([0, 0, 0, 1])), rng.choice("ab"), rng.choice([None, 1])) for i in ids]
    budget = rng.randrange(0, 40)
    want = brute(rows, budget)
    rng.shuffle(rows)
    assert covering.pack_slice(rows, budget) == want


def test_many_items_take_seconds():
    rng = random.Random(1)
    rows = [row(f"i{k}", rng.randrange(5, 40), rng.random(), rng.sample(range(60_000), 20), requires=[f"i{k // 10}"] if k % 10 == 3 else ()) for k in range(20_000)]
    began = time.time()
    included, dropped = covering.pack_slice(rows, 100_000)
    assert len(included) + len(dropped) == 20_000 and len(included) > 4_000 and time.time() - began < 30


def test_pieces(spark):
    texts = [("a", "x  = 1;\n\n  }\n y()"), ("b", "  x = 1;\ny();"), ("c", "one"), ("d", None), ("e", ""), ("f", "}\n{"), ("g", "p\nq\np\nq\r")]
    df = spark.createDataFrame(texts, "k string, t string")
    got = {r.k: r.p for r in df.select("k", covering.pieces(F.col("t")).alias("p")).collect()}
    assert {k: len(p) for k, p in got.items()} == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 0, "f": 0, "g": 2}
    single = {r.k: r.p for r in df.select("k", covering.pieces(F.col("t"), 1).alias("p")).collect()}
    assert len(set(single["a"]) & set(single["b"])) == 1


def test_frames_as_slices_alone(spark):
    rng, rows = random.Random(2), []
    for change in "abc":
        for k in range(15):
            rows.append((change, 1, f"i{k}", "f", k, rng.randrange(1, 50), rng.random() < 0.1, [], rng.random(), rng.choice([None, [], rng.sample(range(12), 4)])))
    df = spark.createDataFrame(rows, SCHEMA)
    packed = covering.pack_slices(df, 40)
    got, kept = {}, {}
    for r in packed.collect():
        got.setdefault(r.pr_key, {}).setdefault(r.status, []).append((r.pack_ord, r.item_id))
    for change, found in got.items():
        alone = [r.asDict() | {"pieces": r.pieces or []} for r in df.where(F.col("pr_key") == change).collect()]
        want = covering.pack_slice(alone, 40)
        assert ([i for _, i in sorted(found.get("included", []))], [i for _, i in sorted(found.get("dropped", []))]) == want
        pieces = [p for r in alone if r["item_id"] in want[0] for p in r["pieces"]]
        kept[change] = (len(pieces), len(pieces) - len(set(pieces)))
    assert {r.pr_key: (r.n_pieces, r.n_repeated) for r in covering.overlap(packed, df).collect()} == {k: v for k, v in kept.items() if v[0]}
    assert covering.pack_slices(df.limit(0), 40).count() == 0
