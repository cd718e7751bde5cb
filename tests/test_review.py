import hashlib
import hmac
import io
import json
import zipfile

from pyspark.sql import functions as F

from patchweave.operators import publish, review
from patchweave.sources import archives, tables
from patchweave.streaming import events

GOOD = {"path": "a.java", "line": 3, "severity": "critical", "title": "t", "message": "m", "suggestion": "s", "citedItemIds": ["x"]}


def _parse(spark, *raws):
    found, counts = review.parse_answers(spark.createDataFrame([("p", k, r) for k, r in enumerate(raws)], "pr_key string, slice_no int, raw string"))
    return found.orderBy("slice_no", "pos").collect(), {r.slice_no: (r.n_findings, r.n_dropped) for r in counts.collect()}


def test_answers(spark):
    junk = [GOOD | {"severity": "fatal"}, "no", GOOD | {"line": True}, GOOD | {"title": "  "}]
    raws = [json.dumps({"findings": [GOOD]}), "```json\n" + json.dumps({"findings": [GOOD]}) + "\n```", "no problem", json.dumps({"findings": junk}), json.dumps({"findings": "x"}), "[1]", None, "{}", json.dumps({"findings": [GOOD | {"line": 2.5, "suggestion": 5}, GOOD | {"suggestion": 5}]})]
    found, counts = _parse(spark, *raws)
    assert counts == {0: (1, 0), 1: (1, 0), 2: (0, 1), 3: (1, 3), 4: (0, 0), 5: (0, 1), 6: (0, 1), 7: (0, 0), 8: (1, 1)}
    assert found[0].cited == ["x"] and found[0].suggestion == "s" and found[2].severity == "warning" and found[3].suggestion is None


def test_merge(spark):
    rows = [("p", 1, 0, "a", 1, "critical", "t", "first"), ("p", 2, 0, "a", 1, "WARNING ", "t", "again"), ("p", 2, 1, "a", None, "x", "t", "m"), ("p", 2, 2, " ", 1, "x", "t", "m"), ("p", 2, 3, "b", 1, "odd", "t", "m")]
    got = review.merge_findings(spark.createDataFrame(rows, "pr_key string, slice_no int, pos int, path string, line int, severity string, title string, message string"))
    assert sorted((r.path, r.message, r.severity) for r in got.collect()) == [("a", "first", "CRITICAL"), ("b", "m", "WARNING")]


def test_totals(spark):
    rows = [("p", 1, True, "m1", 20, 10, 1, 2), ("p", 2, False, "m2", 5, 5, 5, 5), ("p", 3, True, " ", None, 1, 0, 0), ("q", 1, False, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "pr_key string, slice_no int, ok boolean, model string, prompt_tokens int, completion_tokens int, dropped int, invalid int")
    got = {r.pr_key: tuple(r)[1:] for r in review.review_totals(df).collect()}
    assert got == {"p": (True, "m1", 20, 11, 3, 1), "q": (False, None, 0, 0, 0, 1)}


def test_anchors_and_comments(spark):
    finding = "pr_key string, slice_no int, pos int, path string, line int, severity string, title string, message string, suggestion string, cited array<string>"
    rows = [("p", 1, 0, "A", 3, "CRITICAL", "t", "m", "do", ["x", "y"]), ("p", 1, 1, "B", 9, "WARNING", "u", "n", None, [])]
    ranges = spark.createDataFrame([("p", "A", 1, 5), ("p", "A", 2, 4), ("p", "B", None, None)], "pr_key string, path string, start_line int, end_line int")
    found = publish.anchor(spark.createDataFrame(rows, finding), ranges)
    inline, bodies = publish.comments(found, "Others")
    assert [r.comment for r in inline.collect()] == ["**[CRITICAL] t**\n\nm\n\nSuggestion: do\n\n_Cited context: x, y_"]
    assert [r.body for r in bodies.collect()] == ["\n\n**Others:**\n- `B:9` [WARNING] **u** — n\n"]
    plain = publish.fallback(inline, bodies, spark.createDataFrame([("p",)], "pr_key string"), "All").first().comment
    assert "A:3" in plain and "B:9" in plain


def test_prompt(spark):
    rows = [("p", 1, "o/r", 4, "c", 1, "B", "TEST", None, None, None, None, False, "two"), ("p", 1, "o/r", 4, "c", 0, "A", "DIFF_HUNK", "f.java", "s", 1, 2, True, "one")]
    df = spark.createDataFrame(rows, "pr_key string, slice_no int, repo string, pr_number int, context_id string, pack_ord int, item_id string, kind string, path string, symbol_id string, start_line int, end_line int, required boolean, content string")
    text = review.render_prompts(df).first().prompt
    assert text.endswith("### ITEM A kind=DIFF_HUNK path=f.java symbol=s lines=1-2 required\n<<<BEGIN A>>>\none\n<<<END A>>>\n\n### ITEM B kind=TEST\n<<<BEGIN B>>>\ntwo\n<<<END B>>>\n")


def test_reviewer_failures_stay_with_their_slice(spark):
    def reviewer(prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return {"raw": json.dumps({"findings": [GOOD]}), "model": "m", "prompt_tokens": len(prompt)}

    prompts = spark.createDataFrame([("p", 1, "good"), ("p", 2, "bad"), ("q", 1, "bad")], "pr_key string, slice_no int, prompt string")
    answers = review.call_reviewer(prompts, reviewer).cache()
    assert sorted((r.pr_key, r.slice_no, r.ok, r.error) for r in answers.collect()) == [("p", 1, True, None), ("p", 2, False, "RuntimeError: no answer"), ("q", 1, False, "RuntimeError: no answer")]
    assert review.parse_answers(answers.where("ok"))[0].count() == 1
    totals = review.review_totals(answers.withColumn("dropped", F.lit(0)).withColumn("invalid", F.lit(0)))
    assert {r.pr_key: r.available for r in totals.collect()} == {"p": True, "q": False}


def test_readers(spark, tmp_path):
    rows = [("o/r#1", "A.java", None, "added", "@@ -0,0 +1 @@\n+x", 1, 0)]
    spark.createDataFrame(rows, tables.PATCH_FILES).write.json(str(tmp_path / "patches"))
    got = tables.patch_files(spark, str(tmp_path / "patches"), "json").first()
    assert (got.path, got.change_type, got.category) == ("A.java", "ADD", "SOURCE")
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "head.zip").write_bytes(_zip([("r/a.txt", "x")]))
    assert [(r.repo, r.sha) for r in tables.archives(spark, str(tmp_path / "zips"), "o/r").collect()] == [("o/r", "head")]


def _zip(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files:
            z.writestr(name, text)
    return data.getvalue()


def test_archives(spark):
    good = _zip([("repo-1/", ""), ("repo-1/a/B.java", "class B {}"), ("repo-1/README.md", "hi")])
    rows = [("r", "good", good), ("r", "slip", _zip([("repo/x", "1"), ("repo/../../evil.txt", "2")])), ("r", "large", _zip([("repo/x", "1" * 2000)])), ("r", "bad", b"no zip"), ("r", "total", _zip([("repo/a", "1" * 900), ("repo/b", "1" * 900)]))]
    df = spark.createDataFrame(rows, "repo string, sha string, content binary")
    assert sorted((r.sha, r.path) for r in archives.snapshot_files(df, 1000, 1500).collect()) == [("good", "README.md"), ("good", "a/B.java")]
    assert sorted(r.sha for r in archives.archive_errors(df, 1000, 1500).collect()) == ["bad", "large", "slip", "total"]
    wanted = spark.createDataFrame([("r", "good", "README.md"), ("r", "good", "x"), ("r", "good", "y")], "repo string, sha string, path string")
    lazy = spark.createDataFrame([("r", "good", "x", "lazy")], "repo string, sha string, path string, content string")
    got = archives.with_fallback(wanted, archives.snapshot_files(df, 1000, 1500), lazy)
    assert sorted((r.path, r.kind or "") for r in got.collect()) == [("README.md", "ARCHIVE"), ("x", "CONTENTS_LAZY"), ("y", "")]


def _payload(number, action="opened"):
    return json.dumps({"action": action, "installation": {"id": 7}, "repository": {"owner": {"login": "o"}, "name": "r"}, "pull_request": {"number": number}})


def test_http_status(spark):
    sign = lambda p: "sha256=" + hmac.new(b"k", p.encode(), hashlib.sha256).hexdigest()
    rows = [("ping", sign("{}"), "{}"), ("pull_request", "sha256=00", "{}"), ("pull_request", None, "{}"), ("pull_request", sign(_payload(1)), _payload(1)), ("pull_request", sign("{bad"), "{bad"), ("push", sign("{}"), "{}")]
    df = spark.createDataFrame(rows, "event string, signature string, payload string")
    assert [r.http_status for r in events.http_status(df, "k").collect()] == [200, 401, 401, 202, 400, 200]
    assert events.http_status(df, None).first().http_status == 503


def test_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    rows = [("d1", _payload(1), "2024-01-01 00:00:00"), ("d2", _payload(1, "synchronize"), "2024-01-01 00:01:00"), ("d1", _payload(1), "2024-01-01 00:00:00"), ("d3", _payload(2, "closed"), "2024-01-01 00:00:00"), ("d4", _payload(3), "2024-01-01 00:00:00"), ("d5", '{"action":"opened"}', "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "delivery string, payload string, at string").select("delivery", "payload", F.to_timestamp("at").alias("received_at")).write.parquet(source)
    raw = spark.readStream.schema("delivery string, payload string, received_at timestamp").parquet(source)
    events.start_stream(raw, lambda batch, _: seen.extend((r.pr_key, r.action) for r in batch.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [("o/r#1", "synchronize"), ("o/r#3", "opened")]


def test_messages_and_the_built_in_hmac(spark):
    prompts = spark.createDataFrame([("p", 1, "ask")], "pr_key string, slice_no int, prompt string")
    assert [tuple(m) for m in review.chat_messages(prompts).first().messages] == [("system", review.SYSTEM), ("user", "ask")]
    payloads = ["", "x", "é😀", "y" * 5000, None]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    for secret in ("k", "ü" * 32, "long" * 17, "s" * 64):
        want = [None if p is None else hmac.new(secret.encode(), p.encode(), hashlib.sha256).hexdigest() for p in payloads]
        assert [r[0] for r in df.select(events.hmac_sha256(F.col("payload"), secret)).collect()] == want
