import hashlib
import random
from functools import lru_cache

import duckdb

from patchweave.llm import conversation_repair as repair


def exhaustive(rows):
    """(cost, initials) of the best of all edits, with up to three turns inserted in a row."""
    @lru_cache(None)
    def best(at, state, inserted):
        found = [(0, "")] if at == len(rows) and state in repair.ACCEPTED else []
        for edit, to, following, cost in repair.moves(rows, at, state):
            if edit != "I" or inserted < 3:
                rest = best(to, following, inserted + 1 if edit == "I" else 0)
                found += [(cost + rest[0], edit + rest[1])] if rest else []
        return min(found, default=None)

    return best(0, repair.START, 0)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(11)
    for _ in range(1500):
        rows = [repair.Row(rng.choice("suauat "), rng.random() < 0.15, 5 * (rng.random() < 0.2)) for _ in range(rng.randint(0, 40))]
        cost, edits = repair.cheapest_edits(rows)
        assert (cost, edits) == exhaustive(rows)
        assert all(b <= cost for b in repair.lower_bounds(rows)[0][:1])


def test_long_conversations():
    rng = random.Random(12)
    rows = [repair.Row("ua"[k % 2] if rng.random() > 0.1 else rng.choice("sua"), rng.random() < 0.05, 5 * (rng.random() < 0.1)) for k in range(2000)]
    cost, edits = repair.cheapest_edits(rows)
    assert len(edits.replace("I", "")) == len(rows) and cost >= edits.count("D") * repair.DELETE + edits.count("I") * repair.INSERT


SCHEMA = "conv_id long, turn long, role string, text string, audit string, repaired int, kind int, nth int"


def hostile():
    rng = random.Random(13)
    texts = ["", " \t\r\n", "a.", "a", "b!", "\u00a0", "\u0085", "\x1c", "c? \n", "é。", "d.\u00a0", None, "x" * 20_000 + ".", "q:\nuser: r."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "User", "", None]
    rows = [(rng.choice([*range(60), None]), rng.choice([*range(8), None]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += rows[:40]
    rows += [(1000 + k, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"turn {t}.") for k in range(100) for t in range(k % 7)]
    return [(*r, "x", 1, 2, 3) for r in rows]


def test_frame_equals_the_sql(spark, tmp_path):
    spark.createDataFrame(hostile(), SCHEMA).repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(repair.SQL).fetchall()}
    found = repair.op11_conversation_repair(spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and sorted(set(got) - want, key=repr) == sorted(want - set(got), key=repr)


def test_repaired_turns(spark):
    rows = [(1, 2, "user", "Again?"), (1, 0, "user", "Hi."), (1, 1, "user", "Hello!"), (2, None, None, None), (3, 0, "system", "Be kind."), (1, 3, "assistant", "No")]
    found = {r.conv_id: r for r in repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[1].cost, found[1].audit, found[1].truncated, found[1].illegal) == (5, "DKRD", 1, 2)
    assert [tuple(t) for t in found[1].repaired] == [("user", "Hello!"), ("assistant", "Again?")]
    assert (found[2].blank, found[2].audit, found[2].repaired, found[2].gaps) == (1, "D", [], 0)
    assert (found[3].audit, found[3].cost, found[3].repaired) == ("D", 2, [])


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op11_conversation_repair(spark, str(tmp_path)).count() == 0
    # a conversation whose rows are all dropped
    dropped = next(k for k in range(1000) if __import__("zlib").crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 0, 0, 0)], SCHEMA).write.parquet(str(tmp_path / "one" / "conversations.parquet"))
    assert [tuple(r) for r in repair.op11_conversation_repair(spark, str(tmp_path / "one")).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
