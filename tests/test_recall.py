import pytest
from pyspark.sql import functions as F

from patchweave.operators import recall, symbols
from patchweave.sources.java import parse_java, scan_source

MAIN, TEST = "src/main/java/com/example/", "src/test/java/com/example/"
SOURCES = {
    MAIN + "model/User.java": "package com.example.model;\n\npublic class User {\n    private String name;\n\n    public String getName() {\n        return name;\n    }\n}\n",
    MAIN + "service/FooService.java": "package com.example.service;\n\nimport com.example.model.User;\n\npublic class FooService {\n\n    public void save(User user) {\n        validate(user);\n    }\n\n    public void save(User user, boolean force) {\n        validate(user);\n    }\n\n    private void validate(User user) {\n    }\n}\n",
    MAIN + "service/FooCaller.java": "package com.example.service;\n\nimport com.example.model.User;\n\npublic class FooCaller {\n\n    private final FooService fooService = null;\n\n    public void handle(User user) {\n        fooService.save(user);\n    }\n}\n",
    MAIN + "order/OrderCaller.java": "package com.example.order;\n\nimport com.example.model.User;\nimport com.example.service.FooService;\n\npublic class OrderCaller {\n\n    private FooService service;\n\n    public void place(User user) {\n        service.save(user);\n    }\n}\n",
    MAIN + "policy/RetryPolicy.java": "package com.example.policy;\n\npublic interface RetryPolicy {\n    boolean retry(int attempt);\n}\n",
    MAIN + "policy/DefaultRetryPolicy.java": "package com.example.policy;\n\npublic class DefaultRetryPolicy implements RetryPolicy {\n\n    @Override\n    public boolean retry(int attempt) {\n        return attempt < 3; }\n}\n",
    TEST + "service/FooServiceTest.java": "package com.example.service;\n\nimport com.example.model.User;\n\nclass FooServiceTest {\n\n    private final FooService fooService = new FooService();\n\n    void saves() {\n        fooService.save(new User());\n    }\n}\n",
    MAIN + "repo/RepoCaller.java": "package com.example.repo;\n\npublic class RepoCaller {\n    private UserRepository userRepository;\n\n    public void handle(Object user) {\n        userRepository.save(user);\n    }\n}\n",
}


@pytest.fixture(scope="module")
def code(spark):
    rows = spark.createDataFrame([("p", side, path, text) for side in ("HEAD", "MERGE_BASE") for path, text in SOURCES.items()], "pr_key string, side string, path string, content string")
    parsed = parse_java(rows, ["pr_key", "side", "path"]).cache()
    types = parsed.where("row = 'type'").withColumnRenamed("ord", "decl_ord")
    methods = parsed.where("row = 'method'")
    calls = parsed.where("row = 'call' AND side = 'HEAD'").select("pr_key", "path", F.col("start_line").alias("line"), "receiver", F.col("fqn").alias("enclosing_type"), "enclosing_method", F.col("name").alias("method_name"), "arity", F.format_string("%s %05d", "path", "ord").alias("site_ord"))
    return types, methods, calls


def _symbol(methods, fqn, signature, side="HEAD"):
    found = methods.where((F.col("fqn") == fqn) & (F.col("signature") == signature) & (F.col("side") == side))
    return found.select("pr_key", F.lit(0).alias("sym_ord"), "side", "path", F.col("fqn").alias("class_fqn"), F.col("name").alias("method_name"), "arity", "start_line", "end_line", "signature")


def test_scanner_finds_declarations(code):
    types, methods, _ = code
    got = {(r.fqn, r.signature): (r.start_line, r.end_line) for r in methods.where("side = 'HEAD'").collect()}
    assert got["com.example.service.FooService", "save(User)"] == (7, 9) and got["com.example.service.FooService", "save(User,boolean)"] == (11, 13)
    assert got["com.example.policy.RetryPolicy", "retry(int)"] == (4, 4) and got["com.example.policy.DefaultRetryPolicy", "retry(int)"] == (5, 7)
    assert types.where("simple_name = 'DefaultRetryPolicy'").first().interfaces == ["com.example.policy.RetryPolicy"]


def test_callers(code):
    types, methods, calls = code
    edges = recall.call_edges(_symbol(methods, "com.example.service.FooService", "save(User)"), calls, types).collect()
    assert {(r.edge_type, r.from_path.rsplit("/", 1)[1], r.confidence) for r in edges} == {("CALLS", "FooCaller.java", 0.85), ("CALLS", "OrderCaller.java", 0.7), ("TESTED_BY", "FooServiceTest.java", 0.85)}


def test_removed_code_has_a_floor(code):
    types, methods, calls = code
    edges = recall.call_edges(_symbol(methods, "com.example.service.FooService", "save(User)", "MERGE_BASE"), calls, types).where("edge_type = 'CALLS'").collect()
    assert {(r.to_side, r.confidence) for r in edges} == {("MERGE_BASE", 0.9)}


def test_overrides_both_ways(code):
    types, methods, _ = code
    down = recall.override_edges(_symbol(methods, "com.example.policy.RetryPolicy", "retry(int)"), types, methods).collect()
    up = recall.override_edges(_symbol(methods, "com.example.policy.DefaultRetryPolicy", "retry(int)"), types, methods).collect()
    assert [(r.from_symbol, r.confidence) for r in down] == [("com.example.policy.DefaultRetryPolicy#retry(int)", 0.85)]
    assert [(r.from_symbol, r.confidence) for r in up] == [("com.example.policy.RetryPolicy#retry(int)", 0.9)]


def test_conventions(spark):
    foo, test, user = MAIN + "service/FooService.java", TEST + "service/FooServiceTest.java", MAIN + "model/User.java"
    files = spark.createDataFrame([("p", "r", foo, "SOURCE"), ("p", "r", test, "TEST"), ("p", "r", user, "SOURCE"), ("p", "r", "a/App.test.ts", "TEST")], "pr_key string, repo string, path string, category string")
    heads = spark.createDataFrame([("p", "r", "h1"), ("q", "r", "h2")], "pr_key string, repo string, sha string")
    snapshot = files.select("repo", F.lit("h1").alias("sha"), "path")
    edges = recall.convention_edges(files, heads, snapshot).collect()
    assert [(r.from_path, r.to_path, r.confidence) for r in edges] == [(test, foo, 0.95)]
    # what only another change's head has is no counterpart, and repositories of one sha are told apart
    assert recall.convention_edges(files, heads, snapshot.withColumn("sha", F.lit("h2"))).count() == 0
    assert recall.convention_edges(files, heads, snapshot.withColumn("repo", F.lit("s"))).count() == 0


def test_locator(spark, code):
    _, methods, _ = code
    path = MAIN + "service/FooService.java"
    files = spark.createDataFrame([("p", path, None, "MODIFY", "SOURCE"), ("p", "README.md", None, "MODIFY", "DOCUMENTATION")], "pr_key string, path string, previous_path string, change_type string, category string")
    lines = spark.createDataFrame([("p", path, "ADDED", None, 8), ("p", path, "REMOVED", 12, None), ("p", "README.md", "ADDED", None, 1)], "pr_key string, path string, line_type string, old_no int, new_no int")
    got = {(r.side, r.signature) for r in symbols.locate_changed(methods, lines, files).collect()}
    assert got == {("HEAD", "save(User)"), ("MERGE_BASE", "save(User,boolean)")}
    gone = files.limit(1).withColumn("change_type", F.lit("DELETE"))
    assert symbols.locate_changed(methods, lines.limit(0), gone).count() == 3


def test_scanner_details():
    rows = scan_source('class A { A() { this(1); } enum E { X(f(1)) { void z() {} } } void m(Map<String, Integer> a, String... b) { new B(1); a.b().c(x, g(1, 2)); run(() -> { h("(,"); }); } }')
    assert {(r["name"], r["receiver"], r["arity"]) for r in rows if r["row"] == "call"} == {("f", "", 1), ("b", "a", 0), ("c", "a.b()", 2), ("g", "", 2), ("run", "", 1), ("h", "", 1)}
    assert [r["signature"] for r in rows if r["row"] == "method"] == ["m(Map<String,Integer>,String...)"]
    nested = scan_source("package com.example; class Outer { class Inner { void run() {} } }")
    assert [r["fqn"] for r in nested if r["row"] == "type"] == ["com.example.Outer", "com.example.Outer.Inner"]
    assert [r["row"] for r in scan_source("public class {")] == ["failure"]
    assert scan_source("") == [] and scan_source(None) == []
