import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from patchweave.config import ReviewConfig
from patchweave.plans import pipeline
from patchweave.streaming import newest

START = datetime.datetime(2024, 1, 1)
QUIET, LATE = 10, 60


def batches(seed):
    """Deliveries out of order by less than what counts as late, in small batches; some come twice."""
    rng, out, clock = random.Random(seed), [], 0
    for n in range(14):
        clock += rng.choice([10, 40, 70])
        rows = [(f"{n}-{k}", rng.randrange(12), clock - rng.randrange(0, 30)) for k in range(rng.randint(1, 6))]
        out.append(rows + (rng.sample(out[-1], 1) if out else []))
    return out


def modelled(given):
    """The events given out, batch by batch: inputs first, then the timers that the watermark of the batches before has passed."""
    held, out, seen = {}, [], -(10**9)
    for rows in [*given, []]:
        watermark = seen - LATE
        for name, change, minute in rows:
            if change not in held or (minute, name) > held[change]:
                held[change] = (minute, name)
        for change in [c for c, (minute, _) in held.items() if minute + QUIET <= watermark]:
            out.append((change, held.pop(change)[1]))
        seen = max([seen, *(m for _, _, m in rows)])
    return sorted(out), held


def written(folder, given):
    for n, rows in given:
        lines = [json.dumps({"delivery": d, "received_at": (START + datetime.timedelta(minutes=m)).isoformat(), "payload": json.dumps({"action": "opened", "installation": {"id": 1}, "repository": {"name": "a", "owner": {"login": "o"}}, "pull_request": {"number": c + 1}})}) for d, c, m in rows]
        (folder / f"{n:04d}.json").write_text("\n".join(lines))


def test_newest_wins_across_batches_and_restarts(spark, tmp_path):
    given = batches(3)
    source, got = tmp_path / "in", []
    source.mkdir()

    def run():
        raw = spark.readStream.schema("delivery string, received_at timestamp, payload string").option("maxFilesPerTrigger", 1).json(str(source))
        newest.start(raw, lambda due, epoch: got.extend((r.number - 1, r.delivery) for r in due.collect()), str(tmp_path / "checkpoint"), QUIET * 60_000, f"{LATE} minutes").awaitTermination()

    written(source, list(enumerate(given))[:7])
    run()
    assert sorted(got) == modelled(given[:7])[0]
    written(source, list(enumerate(given))[7:])
    run()
    # the state of the first run is still there, and nothing is given out twice
    assert sorted(got) == modelled(given)[0] and len(got) > 6


@pytest.fixture
def changes(spark):
    revisions = spark.createDataFrame([(f"r#{k}", "r", k, "b", "h") for k in range(9)], "pr_key string, repo string, pr_number int, merge_base string, head string")
    files = spark.createDataFrame([(f"r#{k}", f"p{k}") for k in range(9)] + [("r#lost", "p")], "pr_key string, path string")
    return pipeline.Tables(revisions, files, files, files)


def build(bad):
    def parsed(t, config, note="built"):
        def check(rows):
            for batch in rows:
                for key in batch["pr_key"].to_pylist():
                    if key in bad:
                        raise ValueError(f"no patch: {key}")
                yield batch

        plans = t.files.select("pr_key").distinct().mapInArrow(check, "pr_key string")
        plans = plans.sparkSession.createDataFrame(plans.collect(), "pr_key string")
        return {"plans": plans, "results": plans.select("pr_key", F.lit("READY").alias("status"), F.lit(note).alias("reason"))}

    return parsed


def test_an_exception_stays_with_its_change(changes):
    out = pipeline.build_isolated(changes, ReviewConfig(), build({"r#3", "r#7"}), note="n")
    got = {r.pr_key: (r.status, r.reason) for r in out["results"].collect()}
    assert got == {**{f"r#{k}": ("READY", "n") for k in range(9) if k not in (3, 7)}, "r#lost": ("READY", "n"), **{f"r#{k}": ("SKIPPED", f"context build failed: no patch: r#{k}") for k in (3, 7)}}
    assert out["plans"].count() == 8
    with pytest.raises(Exception, match="no patch"):
        pipeline.build_isolated(changes, ReviewConfig(), build({f"r#{k}" for k in range(9)} | {"r#lost"}))
