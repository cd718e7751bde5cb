import random

import pytest
from pyspark.sql import functions as F

from patchweave.functions.scoring import KIND_WEIGHTS
from patchweave.operators import packing, replay

SCHEMA = "pr_key string, slice_no int, item_id string, path string, start_line int, tokens int, required boolean, requires array<string>, kind string, confidence double, extra string"
POLICIES = [replay.Policy("wide", 60), replay.Policy("narrow", 25), replay.Policy("tests", 40, {"TEST": 1.0, "CALLER": 0.1}, 0.9), replay.Policy("blind", 40, {})]


def candidates(spark):
    rng, rows = random.Random(5), []
    for change in "abc":
        for number in (1, 2):
            ids = [f"i{k}" for k in range(12)]
            for i in ids:
                rows.append((change, number, i, f"f{rng.randrange(3)}", rng.choice([None, 1, 2]), rng.randrange(1, 12), rng.random() < 0.15, rng.sample(ids, rng.choice([0, 0, 1, 2])),
                             rng.choice(["CALLER", "TEST", "OVERRIDE", "OTHER", None]), rng.choice([None, 0.3, 0.7, 1.0]), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def value(policy, row):
    return policy.weights.get(row.kind, 0.0) * (policy.default_confidence if row.confidence is None else row.confidence)


def test_each_policy_packs_as_if_alone(spark):
    found = candidates(spark)
    got = {}
    for r in replay.replay(found, POLICIES).collect():
        got.setdefault((r.policy, r.pr_key, r.slice_no), {}).setdefault(r.status, []).append((r.pack_ord, r.item_id))
    slices = {}
    for row in found.collect():
        slices.setdefault((row.pr_key, row.slice_no), []).append(row)
    assert len(got) == len(slices) * len(POLICIES)
    for policy in POLICIES:
        for key, rows in slices.items():
            included, dropped = packing.pack_slice([r.asDict() | {"value": value(policy, r)} for r in rows], policy.budget)
            mine = got[policy.name, *key]
            assert [i for _, i in sorted(mine.get("included", []))] == included and [i for _, i in sorted(mine.get("dropped", []))] == dropped


def test_default_weights_are_those_of_a_build(spark):
    from patchweave.functions.scoring import heuristic_score

    known = candidates(spark).where(F.col("kind").isin(*KIND_WEIGHTS))
    scored = replay.score_policies(known, POLICIES[:1]).withColumn("want", heuristic_score(F.col("kind"), F.col("confidence")))
    assert scored.count() > 0 and scored.where("NOT value <=> want").count() == 0


def test_comparison_by_change_and_in_all(spark):
    rows = replay.replay(candidates(spark), POLICIES)
    took = {}
    for r in rows.collect():
        took.setdefault(r.policy, {})[r.pr_key, r.slice_no, r.item_id] = (r.status == "included", r.tokens)
    got = {(r.policy, r.pr_key): tuple(r)[2:] for r in replay.compare(rows, len(POLICIES)).collect()}
    assert len(got) == len(POLICIES) * 4
    for (policy, change), measures in got.items():
        own = {k: v for k, v in took[policy].items() if change in (None, k[0])}
        kept = [k for k, (yes, _) in own.items() if yes]
        takers = [sum(took[p.name][k][0] for p in POLICIES) for k in kept]
        assert measures == (len(kept), len(own) - len(kept), sum(own[k][1] for k in kept), takers.count(len(POLICIES)), takers.count(1))


def test_edges(spark):
    found = candidates(spark)
    assert replay.replay(found, []).count() == 0
    assert replay.replay(found.limit(0), POLICIES).count() == 0
    assert replay.compare(replay.replay(found.limit(0), POLICIES), 4).count() == 0
    with pytest.raises(ValueError, match="different names"):
        replay.replay(found, [POLICIES[0], POLICIES[0]])
