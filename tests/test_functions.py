import hashlib

from pyspark.sql import functions as F

from patchweave.config import ReviewConfig
from patchweave.functions import ids, paths, scoring, text
from patchweave.operators import items

LISTS = {
    "BINARY": paths.BINARY_EXTENSIONS, "DOCUMENTATION": paths.DOC_EXTENSIONS, "CONFIG": paths.CONFIG_EXTENSIONS, "SOURCE": paths.SOURCE_EXTENSIONS,
}


def shapes():
    """Paths made from each rule, each with a near miss: (path, category)."""
    for want, extensions in LISTS.items():
        for k, ext in enumerate(extensions):
            yield f"unit{k}/part.{ext}", want
            yield f"Unit{k}/PART.{ext.upper()}", want
            yield f"unit{k}/.{ext}", "OTHER"
            yield f"unit{k}.{ext}/part", "OTHER"
            yield f"unit{k}/part.{ext}q", "OTHER"
    for name in paths.LOCK_FILES:
        yield f"deep/er/{name}", "GENERATED"
        yield f"deep/er/x{name}", {"json": "CONFIG", "yaml": "CONFIG"}.get(name.rsplit(".", 1)[1], "OTHER")
    for name in paths.CONFIG_NAMES:
        yield f"deep/{name}", "CONFIG"
        yield f"deep/{name}/inside", "OTHER"
    for end in paths.GENERATED_SUFFIXES:
        yield f"out/thing{end}", "GENERATED"
    for folder in (*paths.GENERATED_FOLDERS, *paths.TEST_FOLDERS):
        want = "GENERATED" if folder in paths.GENERATED_FOLDERS else "TEST"
        yield f"k{'' if folder[0] == '/' else '/'}{folder}thing.rs", want
        yield f"k/x{folder.strip('/').replace('/', '')}x/thing.rs", "SOURCE"
    for end in paths.TEST_SUFFIXES:
        yield f"lib/thing{end}", "TEST"
    for part in paths.TEST_INFIXES:
        yield f"lib/thing{part}mjs", "TEST"
        yield f"lib{part}d/thing.mjs", "SOURCE"
    yield from (("lib/test_thing", "TEST"), ("lib/atest_thing", "OTHER"), ("", "OTHER"), (None, "OTHER"), ("a\nb.png", "BINARY"), ("b.png\n", "OTHER"))


def test_categories(spark):
    df = spark.createDataFrame(list(shapes()), "path string, want string")
    assert df.count() > 200
    assert [r for r in df.withColumn("got", paths.category(F.col("path"))).collect() if r.got != r.want] == []


def test_generated_marker_in_sample_but_binary_first(spark):
    df = spark.createDataFrame([("a.go", "// Code generated by protoc. DO NOT EDIT."), ("a.png", "generated by x"), ("a.go", None)], "path string, sample string")
    assert [r[0] for r in df.select(paths.category(F.col("path"), F.col("sample"))).collect()] == ["GENERATED", "BINARY", "SOURCE"]


def test_sensitive(spark):
    """Each pattern with its star filled in several ways, in any case and folder, and names that differ by one sign."""
    rows = []
    for pattern in ReviewConfig().sensitive_patterns:
        for fill in ("", "x", ".prod", "-2.txt") if pattern.endswith("*") else ("k", "a.b", ".hidden"):
            name = pattern.replace("*", fill)
            rows += [(name, True), (f"deep/er/{name.upper()}", True), (f"deep\\er\\{name}", True), (f"{name}/plain.go", False)]
            rows.append((f"_{name}", False) if pattern.endswith("*") else (f"{name}_", False))
    rows += [("", False), (" ", False), (None, False)]
    df = spark.createDataFrame(rows, "path string, want boolean")
    assert [r for r in df.withColumn("got", paths.is_sensitive(F.col("path"))).collect() if r.got != r.want] == []


def test_own_patterns_hide_every_kind_of_content(spark):
    config = ReviewConfig(sensitive_patterns=("*.vault", "plan?.txt"))
    files = spark.createDataFrame([("p", "a/x.vault", "MODIFY", 1, 0), ("p", "plan7.txt", "MODIFY", 1, 0), ("p", "plan77.txt", "MODIFY", 1, 0), ("p", ".env", "MODIFY", 1, 0)], "pr_key string, path string, change_type string, additions int, deletions int")
    hunk = files.selectExpr("pr_key", "path", "0 AS hunk_idx", "1 AS old_start", "1 AS old_count", "1 AS new_start", "1 AS new_count", "'text' AS rendered")
    assert {r.ref_path for r in items.diff_items(hunk, files, config).collect()} == {"plan77.txt", ".env"}
    assert {r.content for r in items.metadata_items(files, hunk, config).collect()} == {"a/x.vault (sensitive file, content withheld)", "plan7.txt (sensitive file, content withheld)"}
    assert {r.ref_path for r in items.diff_items(hunk, files).collect()} == {"a/x.vault", "plan7.txt", "plan77.txt"}


def test_status(spark):
    df = spark.createDataFrame([("added",), ("removed",), ("renamed",), ("modified",), ("copied",), (None,)], "s string")
    assert [r[0] for r in df.select(paths.change_type(F.col("s"))).collect()] == ["ADD", "DELETE", "RENAME", "MODIFY", "MODIFY", "MODIFY"]


def test_tokens(spark):
    df = spark.createDataFrame([("",), (None,), ("abcd",), ("abcde",), ("😀😀😀",)], "t string")
    assert [r[0] for r in df.select(text.estimate_tokens(F.col("t"))).collect()] == [0, 0, 1, 2, 2]


def test_lines_and_headers(spark):
    source = "package a;\n\nimport b.C;\n\n/** x */\n@Y\npublic class Foo extends C {\n  int f;\n}\n\n"
    df = spark.createDataFrame([(source,)], "t string")
    row = df.select(text.extract_lines(F.col("t"), F.lit(7), F.lit(99)).alias("a"), text.extract_lines(F.col("t"), F.lit(30), F.lit(31)).alias("b"), text.extract_lines(F.col("t"), F.lit(3), F.lit(1)).alias("c"),
                    text.class_header(F.col("t"), F.lit("Foo")).alias("d"), text.bounded(F.lit("x" * 1500), 1).alias("e")).first()
    assert (row.a, row.b, row.c) == ("public class Foo extends C {\n  int f;\n}", "", "import b.C;")
    assert row.d == "package a;\nimport b.C;\npublic class Foo extends C {"
    assert row.e == "x" * 1024 + "\n… (truncated)"


def test_bounded_counts_utf16_units(spark):
    """As a string of 16-bit units would be cut: a pair counts twice, and half a pair is no character."""
    texts = ["a" * 1024, "a" * 1025, "\U0001f600" * 512, "\U0001f600" * 513, "a" + "\U0001f600" * 600, "é" * 2000, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def want(t):
        units = (t or "").encode("utf-16-be")
        if t is None or len(units) <= 2048:
            return t
        return units[:2048].decode("utf-16-be", "ignore") + ("?" if 0xD8 <= units[2046] <= 0xDB else "") + "\n… (truncated)"

    assert [r[0] for r in df.select(text.bounded(F.col("t"), 1)).collect()] == [want(t) for t in texts]


def test_names(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(text.parent_dir(F.lit("a/b.java"))) == "a" and f(text.parent_dir(F.lit("b.java"))) == ""
    assert f(text.package_of(F.lit("a.b.C"))) == "a.b" and f(text.package_of(F.lit("C"))) == ""
    assert f(text.decapitalize(F.lit("FooService"))) == "fooService" and f(text.simple_name(F.lit("a.B"))) == "B"
    assert f(text.extension(F.lit(".env"))) == "" and f(text.extension(F.lit("a.tar.gz"))) == "gz"


def test_scores(spark):
    df = spark.createDataFrame([("OVERRIDE", 0.9), ("CALLER", 0.85), ("TEST", 1.0), ("CALLER", None)], "k string, c double")
    assert [round(r[0], 4) for r in df.select(scoring.heuristic_score(F.col("k"), F.col("c"))).collect()] == [0.81, 0.68, 0.85, 0.4]


def test_identities(spark):
    schema = "pr_key string, path string, previous_path string, change_type string, patch string"
    a = ("p", "lib/one.kt", None, "ADD", "@@ -0,0 +1,2 @@\n+val x = 1\n+val y = 2\n")
    b = ("p", "lib/two.kt", "lib/zwei.kt", "RENAME", None)
    sha = lambda rows: ids.patch_sha(spark.createDataFrame(rows, schema)).first().patch_sha
    assert sha([a, b]) == sha([b, a]) != sha([(*a[:4], a[4] + " "), b])
    whole = "".join(f"{r[1]}\0{r[2] or ''}\0{r[3]}\0{r[4] or ''}\0" for r in (a, b))
    assert sha([b, a]) == hashlib.sha256(whole.encode()).hexdigest()
    many = [(f"q{k % 7}", f"f{k:04}", None, "ADD", "x" * (k % 50)) for k in range(700)]
    got = {r.pr_key: r.patch_sha for r in ids.patch_sha(spark.createDataFrame(many, schema).repartition(5)).collect()}
    assert got == {f"q{k}": hashlib.sha256("".join(f"{r[1]}\0\0ADD\0{r[4]}\0" for r in many if r[0] == f"q{k}").encode()).hexdigest() for k in range(7)}
    assert ids.patch_sha(spark.createDataFrame([], schema)).count() == 0
    one = lambda config: spark.range(1).select(ids.context_id(F.lit("c"), config)).first()[0]
    assert one(ReviewConfig()) == one(ReviewConfig()) != one(ReviewConfig(max_file_kb=1))
    assert ReviewConfig().context_budget == 9000
