import random
import statistics

from patchweave.operators import evaluation

PACKED = "pr_key string, slice_no int, item_id string, status string, pack_ord int, tokens int"
LIMITS = [(1, None), (2, None), (None, 25), (2, 15), (None, None), (1, None)]


def test_places_and_recall(spark):
    packed = spark.createDataFrame([("p", 1, "a", "included", 0, 10), ("p", 1, "b", "included", 1, 10), ("p", 1, "c", "included", 2, 10), ("p", 1, "d", "dropped", 0, 5), ("p", 2, "c", "included", 0, 9), ("q", 1, "a", "included", 0, 99), ("z", 1, "a", "included", 0, 1)], PACKED)
    gold = spark.createDataFrame([("p", "b"), ("p", "b"), ("p", "c"), ("p", "d"), ("p", None), (None, "a"), ("q", "a"), ("r", "a")], "pr_key string, item_id string")
    hits = evaluation.support_hits(packed, gold)
    assert {tuple(r) for r in hits.collect()} == {("p", "b", 2, 20), ("p", "c", 1, 9), ("p", "d", None, None), ("q", "a", 1, 99), ("r", "a", None, None)}
    rows = evaluation.recall_at(hits, LIMITS)
    got = {(r.pr_key, r.top, r.budget): (r.n_found, r.n_gold) for r in rows.collect()}
    assert got == {("p", 1, None): (1, 3), ("p", 2, None): (2, 3), ("p", None, 25): (2, 3), ("p", 2, 15): (1, 3), ("p", None, None): (2, 3), **{("q", t, b): (int(b is None), 1) for t, b in LIMITS}, **{("r", t, b): (0, 1) for t, b in LIMITS}}
    totals = {(r.top, r.budget): r for r in evaluation.recall_intervals(rows, 50).collect()}
    assert len(totals) == 5 and totals[None, None].n_found == 3 and totals[None, None].n_gold == 5 and totals[None, None].n_changes == 3
    assert evaluation.recall_at(hits, []).count() == 0
    assert evaluation.recall_intervals(evaluation.recall_at(evaluation.support_hits(packed, gold.limit(0)), LIMITS)).count() == 0


def test_interval_as_by_resampling_outside(spark):
    rng = random.Random(3)
    rows = [(f"c{k}", None, None, n, sum(rng.random() < 0.7 for _ in range(n))) for k in range(120) for n in [rng.randrange(1, 8)]]
    df = spark.createDataFrame(rows, "pr_key string, top int, budget long, n_gold long, n_found long")
    got = evaluation.recall_intervals(df).first()
    shares = []
    for _ in range(1000):
        sample = rng.choices(rows, k=len(rows))
        shares.append(sum(r[4] for r in sample) / sum(r[3] for r in sample))
    cuts = statistics.quantiles(shares, n=40)
    assert got.low < got.recall < got.high and abs(got.low - cuts[0]) < 0.015 and abs(got.high - cuts[-1]) < 0.015
    assert evaluation.recall_intervals(df.repartition(7)).first() == got
    assert evaluation.recall_intervals(df, seed=1).first() != got
