import pytest
from pyspark.sql import functions as F

from patchweave.sources import declarations
from patchweave.sources.java import parse_java

TEXTS = {"A": "package a;\nclass A { void m() { n(); } }\n", "B": "interface B { int k(int x); }", "broken": "class C { void m( {", "empty": "", "null": None}


def files(spark, texts):
    return spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(texts)], "n int, path string, content string")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def batches(spark, path):
    return [r.n for r in spark.read.schema("digest string, batch string").parquet(f"{path}/seen").groupBy("batch").agg(F.count("*").alias("n")).collect()]


def test_as_parsed_each_time_but_each_content_once(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = files(spark, [*TEXTS.items(), ("A again", TEXTS["A"])])
    assert rows(declarations.parse_kept(first, ["n", "path"], path)) == rows(parse_java(first, ["n", "path"]))
    assert batches(spark, path) == [4]  # null is an empty file, and the copy is one
    assert rows(declarations.parse_kept(first, ["n", "path"], path)) == rows(parse_java(first, ["n", "path"]))
    assert batches(spark, path) == [4]
    changed = files(spark, [*TEXTS.items(), ("A again", TEXTS["A"].replace("n()", "o()"))])
    assert rows(declarations.parse_kept(changed, ["n", "path"], path)) == rows(parse_java(changed, ["n", "path"]))
    assert sorted(batches(spark, path)) == [1, 4]


def test_batches_that_were_cut_off_or_written_twice(spark, tmp_path):
    path = str(tmp_path / "kept")
    df = files(spark, TEXTS.items())
    want = rows(parse_java(df, ["n", "path"]))
    digested = df.select(declarations.digest(F.col("content")).alias("digest"), "content")
    parsed = parse_java(digested.distinct(), ["digest"])
    parsed.write.parquet(f"{path}/rows/batch=0cut")  # its digests were never written
    assert rows(declarations.parse_kept(df, ["n", "path"], path)) == want
    # a second writer that began before the first was done
    parsed.write.parquet(f"{path}/rows/batch=00")
    digested.select("digest").distinct().write.parquet(f"{path}/seen/batch=00")
    assert rows(declarations.parse_kept(df, ["n", "path"], path)) == want and len(batches(spark, path)) == 2


def test_a_content_of_many_files_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(declarations, "BUSY", 3)
    df = files(spark, [*((f"copy {k}", TEXTS["A"]) for k in range(40)), *TEXTS.items()])
    assert rows(declarations.parse_kept(df, ["n", "path"], str(tmp_path / "kept"))) == rows(parse_java(df, ["n", "path"]))


def test_no_files(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert declarations.parse_kept(files(spark, [("a", "x")]).limit(0), ["n", "path"], path).count() == 0
    assert declarations.known(spark, path).count() == 0


@pytest.mark.parametrize("version", ["java-2"])
def test_another_parser_starts_anew(spark, tmp_path, monkeypatch, version):
    path, df = str(tmp_path / "kept"), files(spark, [("A", TEXTS["A"])])
    declarations.parse_kept(df, ["n"], path)
    monkeypatch.setattr(declarations, "PARSER_VERSION", version)
    declarations.parse_kept(df, ["n"], path)
    assert batches(spark, path) == [1, 1]
