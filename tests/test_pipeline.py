import io
import json
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patchweave.config import ReviewConfig
from patchweave.functions.paths import category
from patchweave.operators import freeze
from patchweave.plans.pipeline import Tables, build_plans, head_snapshot, plan_comment
from patchweave.sources import scratch
from tests.test_channels import written

A_OLD = "package com.x;\n\npublic class A {\n  void m() {\n    one();\n  }\n}\n"
A_NEW = "package com.x;\n\npublic class A {\n  void m() {\n    one();\n    two();\n  }\n}\n"
CALLER = "package com.y;\n\nimport com.x.A;\n\nclass Caller {\n  A a;\n  void run() {\n    a.m();\n  }\n}\n"
PATCH = "@@ -3,4 +3,5 @@\n public class A {\n   void m() {\n     one();\n+    two();\n   }"


@pytest.fixture(scope="module")
def tables(spark):
    revisions = spark.createDataFrame([("o/r#42", "o/r", 42, "merge00", "head999"), ("o/r#43", "o/r", 43, "merge00", "head999")], "pr_key string, repo string, pr_number int, merge_base string, head string")
    rows = [("o/r#42", "src/main/java/com/x/A.java", None, "MODIFY", PATCH, 1, 0), ("o/r#42", "conf/.env", None, "MODIFY", "@@ -1 +1 @@\n-PASSWORD=hunter1\n+PASSWORD=hunter2", 1, 1), ("o/r#43", "logo.png", None, "ADD", None, 0, 0)]
    files = spark.createDataFrame(rows, "pr_key string, path string, previous_path string, change_type string, patch string, additions int, deletions int").withColumn("category", category(F.col("path")))
    snapshot = spark.createDataFrame([("o/r", "head999", "src/main/java/com/x/A.java", A_NEW), ("o/r", "head999", "src/main/java/com/y/Caller.java", CALLER), ("o/r", "head999", "src/test/java/com/x/ATest.java", "package com.x;\nclass ATest {}\n")], "repo string, sha string, path string, content string")
    base = spark.createDataFrame([("o/r", "merge00", "src/main/java/com/x/A.java", A_OLD)], "repo string, sha string, path string, content string")
    return Tables(revisions, files, snapshot, base)


def test_end_to_end(tables, tmp_path):
    out = build_plans(tables, ReviewConfig(), whole_snapshot=True)
    kept = {(r.pr_key, r.item_id) for r in out["packed"].where("status = 'included'").collect()}
    path = "src/main/java/com/x/A.java"
    assert kept == {("o/r#42", f"DIFF#{path}#0"), ("o/r#42", "METHOD#com.x.A#m()"), ("o/r#42", "CLASS#com.x.A"), ("o/r#42", "CALLER#src/main/java/com/y/Caller.java#8"), ("o/r#42", "TEST#src/test/java/com/x/ATest.java#file"), ("o/r#42", "FILE#conf/.env"), ("o/r#43", "FILE#logo.png")}
    plans = {r.pr_key: r for r in out["plans"].collect()}
    assert all(len(r.context_id) == 64 and json.loads(r.plan_json)["contextId"] == r.context_id for r in plans.values())
    assert "hunter" not in " ".join(r.content for r in out["items"].collect())
    text = {r.pr_key: r.comment for r in plan_comment(out["plans"]).collect()}
    assert "- `com.x.A#m()`" in text["o/r#42"] and "**1** callers" in text["o/r#42"] and "(+2 / -1)" in text["o/r#42"]
    freeze.freeze(out["plans"].drop("pr_key"), str(tmp_path / "store"))
    store = tables.revisions.sparkSession.read.parquet(str(tmp_path / "store"))
    again = build_plans(tables, ReviewConfig(), whole_snapshot=True, store=store.where(F.col("context_id") == plans["o/r#42"].context_id))
    assert {(r.pr_key, r.status) for r in again["results"].collect()} == {("o/r#42", "REUSED"), ("o/r#43", "READY")}
    assert {r.pr_key for r in again["items"].collect()} == {"o/r#43"}
    assert {r.pr_key: r.plan_json for r in again["plans"].collect()} == {k: r.plan_json for k, r in plans.items()}
    plan, other = (json.loads(plans[k].plan_json) for k in ("o/r#42", "o/r#43"))
    assert plan["capabilities"] == {"patch": "COMPLETE", "headSnapshot": "COMPLETE", "mergeBaseFiles": "COMPLETE", "astCoverage": 1.0, "symbolRecall": "ENABLED", "lexicalRecall": "DISABLED_BY_CONFIG", "coChange": "DISABLED_BY_CONFIG"}
    assert other["capabilities"]["patch"] == "PARTIAL" and other["slices"] == [{"slice_no": 1, "theme": "root", "tokens": 3, "budget": 9000}]
    assert plan["summary"]["themes"] == ["conf", "src/main/java/com/x"] and json.loads(plans["o/r#42"].diagnostics) == {"missingPatches": 0, "parseFailures": 0, "sensitiveSkipped": 1, "edgeCount": 2}
    prompts = {(r.pr_key, r.slice_no): r.prompt for r in out["requests"].collect()}
    assert "+    6 |     two();" in prompts["o/r#42", 2] and "hunter" not in "".join(prompts.values()) and "CALLER#src/main/java/com/y/Caller.java#8" in prompts["o/r#42", 2]
    assert text["o/r#42"].endswith("\nCapabilities: patch=COMPLETE, snapshot=COMPLETE, mergeBase=COMPLETE, astCoverage=100%\n")


def test_a_fault_stays_with_its_change(tables):
    """A change without a revision is skipped, one without files has an empty slice, and the others are built."""
    spark = tables.revisions.sparkSession
    lost = tables.files.limit(1).withColumn("pr_key", F.lit("o/r#99"))
    bare = spark.createDataFrame([("o/r#50", "o/r", 50, "m", "none"), ("o/r#51", "o/r", 51, "m", None)], tables.revisions.schema)
    out = build_plans(Tables(tables.revisions.union(bare), tables.files.union(lost), tables.snapshot, tables.base))
    assert {(r.pr_key, r.status) for r in out["results"].collect()} == {("o/r#42", "READY"), ("o/r#43", "READY"), ("o/r#50", "READY"), ("o/r#51", "SKIPPED"), ("o/r#99", "SKIPPED")}
    plan = json.loads(out["plans"].where("pr_key = 'o/r#50'").first().plan_json)
    assert "slices: **1**\n\nChanged files: **0** (+0 / -0)\n\nRelated context: **0** callers" in plan_comment(out["plans"].where("pr_key = 'o/r#50'"), "Review").first().comment
    assert plan["slices"] == [{"slice_no": 1, "theme": "misc", "tokens": 0, "budget": 9000}] and plan["capabilities"]["headSnapshot"] == "MISSING" and plan["capabilities"]["astCoverage"] == 1.0


def test_counterparts_of_the_own_head(spark):
    """Two changes of one repository: what only the other's head has makes no edge."""
    foo, test, qux = "src/main/java/a/Foo.java", "src/test/java/a/FooTest.java", "src/main/java/a/Qux.java"
    revisions = spark.createDataFrame([("r#1", "r", 1, "b", "h1"), ("r#2", "r", 2, "b", "h2")], "pr_key string, repo string, pr_number int, merge_base string, head string")
    rows = [("r#1", foo, None, "DELETE", None, 0, 1), ("r#1", test, None, "DELETE", None, 0, 1), ("r#1", qux, None, "MODIFY", None, 1, 0), ("r#2", foo, None, "MODIFY", None, 1, 0)]
    files = spark.createDataFrame(rows, "pr_key string, path string, previous_path string, change_type string, patch string, additions int, deletions int").withColumn("category", category(F.col("path")))
    texts = [("r", "h1", qux, "package a;\nclass Qux {}\n"), *(("r", "h2", p, f"package a;\nclass {p[16:-5]} {{}}\n") for p in (foo, test, qux))]
    schema = "repo string, sha string, path string, content string"
    out = build_plans(Tables(revisions, files, spark.createDataFrame(texts, schema), spark.createDataFrame([("r", "b", p, "class X { void m() {} }") for p in (foo, test)], schema)))
    assert [(r.pr_key, r.from_path, r.to_path) for r in out["edges"].collect()] == [("r#2", test, foo)]
    assert {r.pr_key: json.loads(r.diagnostics)["edgeCount"] for r in out["plans"].collect()} == {"r#1": 0, "r#2": 1}
    # merge-base files of r#1 were loaded, Qux has none, and r#2 asks for one that is there
    assert {r.pr_key: json.loads(r.plan_json)["capabilities"]["mergeBaseFiles"] for r in out["plans"].collect()} == {"r#1": "PARTIAL", "r#2": "COMPLETE"}


def test_snapshots_from_archives(tables):
    """A sound archive is the head; a broken one, or none, leaves the files that were read one by one, and the plan says so."""
    spark = tables.revisions.sparkSession
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for r in tables.snapshot.collect():
            archive.writestr(f"r-head999/{r.path}", r.content)
    zips = lambda content: spark.createDataFrame([("o/r", "head999", content)], "repo string, sha string, content binary")
    whole = head_snapshot(tables.revisions, zips(buffer.getvalue()), tables.snapshot)
    assert {(r.path, r.content, r.kind) for r in whole.collect()} == {(r.path, r.content, "ARCHIVE") for r in tables.snapshot.collect()}
    lazy = head_snapshot(tables.revisions, zips(b"no zip"), tables.snapshot.where("path LIKE '%A.java'"))
    assert [(r.path, r.kind) for r in lazy.collect()] == [("src/main/java/com/x/A.java", "CONTENTS_LAZY")]
    out = build_plans(Tables(tables.revisions, tables.files, lazy, tables.base))
    assert {json.loads(r.plan_json)["capabilities"]["headSnapshot"] for r in out["plans"].collect()} == {"PARTIAL"}


def test_plans_do_not_depend_on_row_order(tables):
    shuffled = Tables(*(t.repartition(3).orderBy(F.rand(5)) for t in (tables.revisions, tables.files, tables.snapshot, tables.base)))
    plan = lambda t: sorted(r.plan_json for r in build_plans(t)["plans"].collect())
    assert plan(tables) == plan(shuffled)


def test_channels_can_be_off(tables):
    out = build_plans(tables, ReviewConfig(symbol_graph=False, conventions=False), whole_snapshot=True)
    assert {r.kind for r in out["items"].select("kind").distinct().collect()} == {"DIFF_HUNK", "METADATA", "CHANGED_METHOD"}


def test_covering_and_kept_declarations(tables, tmp_path):
    """The same edges from kept declarations; a caller whose text is a copy of another is left out, and the fingerprint says so."""
    from patchweave.sources import declarations

    twin = tables.snapshot.where("path LIKE '%Caller.java'").withColumn("path", F.lit("src/main/java/com/y/Caller2.java"))
    kept, config = str(tmp_path / "kept"), ReviewConfig(covering=True)
    more = Tables(tables.revisions, tables.files, tables.snapshot.unionByName(twin), tables.base)
    out = build_plans(more, config, whole_snapshot=True, declarations=kept)
    status = {r.item_id: r.status for r in out["packed"].collect()}
    assert sorted(v for k, v in status.items() if k.startswith("CALLER#")) == ["dropped", "included"]
    seen = declarations.known(tables.snapshot.sparkSession, kept).count()
    assert seen == 4  # three files of the head, of which the twin is one, and the old A
    assert config.fingerprint() != ReviewConfig().fingerprint()
    edited = more.snapshot.withColumn("content", F.when(F.col("path").endswith("ATest.java"), F.concat("content", F.lit("// edited\n"))).otherwise(F.col("content")))
    again = build_plans(Tables(tables.revisions, tables.files, edited, tables.base), config, whole_snapshot=True, declarations=kept)
    assert {r.item_id for r in again["packed"].collect()} == set(status)
    assert declarations.known(tables.snapshot.sparkSession, kept).count() == seen + 1


def test_texts_move_a_few_times(spark, tmp_path):
    """Many changes of one head: what a build shuffles and stores is a few times its patches and contents, not times the changes."""
    rng, changes = random.Random(11), 12
    text = lambda: "\n".join(f"{rng.getrandbits(240):x}" for _ in range(60))
    paths = [(f"r#{k % changes}", f"src/main/java/x/F{k}.java" if k % 4 == 0 else f"docs/f{k}.md", text()) for k in range(900)]
    patch = lambda t: f"@@ -1,0 +1,{t.count(chr(10)) + 1} @@\n" + "\n".join(f"+{line}" for line in t.split("\n"))
    rows = [(p, f, "old.kt" if f.endswith("/F0.java") else None, "MODIFY", patch(t), 60, 0, "SOURCE" if f.endswith(".java") else "DOCUMENTATION") for p, f, t in paths]
    tables = {
        "revisions": spark.createDataFrame([(f"r#{k}", "r", k, "b", "h") for k in range(changes)], "pr_key string, repo string, pr_number int, merge_base string, head string"),
        "files": spark.createDataFrame(rows, "pr_key string, path string, previous_path string, change_type string, patch string, additions int, deletions int, category string"),
        "snapshot": spark.createDataFrame([("r", "h", f, t) for _, f, t in paths], "repo string, sha string, path string, content string"),
        "base": spark.createDataFrame([("r", "b", "old.kt" if f.endswith("/F0.java") else f, t) for _, f, t in paths], "repo string, sha string, path string, content string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    read = Tables(*(spark.read.parquet(str(tmp_path / name)) for name in tables))
    folder = Path(scratch._folder(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    width = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "48k")
    try:
        before = held()
        out, moved = written(spark, lambda: build_plans(read))
        stored = held() - before
        plans = [json.loads(r.plan_json) for r in out["plans"].collect()]
        hunks = {(r.pr_key, r.ref_path): r.content for r in out["items"].where("kind = 'DIFF_HUNK'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", width)
    assert [p["capabilities"]["mergeBaseFiles"] for p in plans] == ["COMPLETE"] * changes
    assert hunks == {(p, f): patch(t) for p, f, t in paths}
    size = sum(len(t) for _, _, t in paths)
    assert moved + stored < 6 * size
