"""The change-review domain, derived from the driver's tables by deterministic expressions.

A document is a changed file, its source the change; parts are methods, their line items call sites, suppliers the files that
call; orders are methods with line ranges; customers are types with parents. Every derivation takes all rows of its tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.functions.paths import category, change_type

REPO = "acme/app"
#: Lines of one hunk of a derived patch, and the gap between hunks.
HUNK, GAP = 20, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH = """CASE doc_id % 12
 WHEN 0 THEN concat('src/main/java/com/acme/p', (doc_id div 12) % 7, '/D', doc_id, '.java')
 WHEN 1 THEN concat('src/test/java/com/acme/p', (doc_id div 12) % 7, '/D', doc_id - 1, 'Test.java')
 WHEN 2 THEN concat('web/m', doc_id, '/package-lock.json') WHEN 3 THEN concat('conf/c', doc_id, '/.env.local')
 WHEN 4 THEN concat('assets/logo', doc_id, '.png') WHEN 5 THEN concat('docs/Guide', doc_id, '.md')
 WHEN 6 THEN concat('conf/app', doc_id, '.yml') WHEN 7 THEN concat('tools/run', doc_id, '.py')
 WHEN 8 THEN concat('src/main/java/com/acme/p', (doc_id div 12) % 7, '/CredentialsD', doc_id, '.java')
 WHEN 9 THEN concat('api/client', doc_id, '.pb.go') WHEN 10 THEN concat('keys/server', doc_id, '.pem')
 ELSE concat('data/blob', doc_id, '.xyz') END"""
STATUS = "element_at(array('added', 'modified', 'removed', 'renamed', 'copied'), cast(doc_id % 5 + 1 as int))"


def _patch(text: Column, doc_id: Column) -> Column:
    lines = F.split(text, "\n")
    third = lambda n, shift: F.floor((n + shift) / 3).cast("int")  # noqa: E731  how many of the first n lines are added (shift 1) or removed (0)

    def shown(line: Column, i: Column) -> Column:
        end = F.least(i + HUNK, F.size(lines))
        block = F.floor(i / HUNK).cast("int") * GAP
        wrong = F.when((doc_id % 17 == 3) & (i == 0), 1).otherwise(0)
        header = F.format_string("@@ -%d,%d +%d,%d @@ part\n", (1 + i - third(i, 1) + block).cast("int"), (end - i - third(end, 1) + third(i, 1) + wrong).cast("int"),
                                 (1 + i - third(i, 0) + block).cast("int"), (end - i - third(end, 0) + third(i, 0)).cast("int"))
        mark = F.element_at(F.array(F.lit(" "), F.lit("+"), F.lit("-")), (i % 3 + 1).cast("int"))
        return F.concat(F.when(i % HUNK == 0, header).otherwise(""), mark, line)

    return F.array_join(F.transform(lines, shown), "\n")


def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_key, repo, path, previous_path, status, change_type, category, patch, additions, deletions, content, n_chars)."""
    docs = read(spark, sf_dir, "documents")
    base = docs.select(F.col("source").alias("pr_key"), "doc_id", F.expr(PATH).alias("path"), F.expr(STATUS).alias("status"), F.col("text").alias("content"), "n_chars")
    binary = F.col("path").endswith(".png")
    n = F.size(F.split("content", "\n"))
    lines = lambda shift: F.when(binary | F.col("content").isNull(), 0).otherwise(F.floor((n + shift) / 3)).cast("int")
    return base.select("pr_key", F.lit(REPO).alias("repo"), "path", F.when(F.col("status") == "renamed", F.concat(F.lit("old/"), "path")).alias("previous_path"), "status", change_type(F.col("status")).alias("change_type"),
                       category(F.col("path")).alias("category"), F.when(~binary, _patch(F.col("content"), F.col("doc_id"))).alias("patch"), lines(1).alias("additions"), lines(0).alias("deletions"), "content", "n_chars")


def several_heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, heads, snapshot): each change has a head of its own, with its undeleted files and some counterparts that others changed."""
    files = patch_files(spark, sf_dir).select("pr_key", "repo", "path", "category", "change_type")
    numbered = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("source").alias("sha"), F.expr(PATH).alias("path"))
    mains, tests = numbered.where("d % 24 = 0"), numbered.where("d % 24 = 1")
    pairs = mains.alias("m").join(tests.alias("t"), F.col("t.d") == F.col("m.d") + 1).where("m.sha != t.sha")
    others = pairs.select("m.sha", "t.path").union(pairs.select("t.sha", "m.path"))
    snapshot = files.where("change_type != 'DELETE'").select(F.col("pr_key").alias("sha"), "path").union(others).select(F.lit(REPO).alias("repo"), "sha", "path")
    heads = files.select("pr_key").distinct().select("pr_key", F.lit(REPO).alias("repo"), F.col("pr_key").alias("sha"))
    return files.drop("repo", "change_type"), heads, snapshot


FQN = "concat('com.s', {0} % 40, '.S', {0})"
CALL_PATH = "concat('src/', CASE WHEN {0} % 5 = 0 THEN 'test' ELSE 'main' END, '/java/com/s', {0} % 40, '/S', {0}, '.java')"


def called_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as changed methods; the type is that of the part's first supplier."""
    owners = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("owner"))
    parts = read(spark, sf_dir, "part").join(owners, "p_partkey")
    return parts.selectExpr("p_brand AS pr_key", "p_partkey AS sym_ord", "CASE WHEN p_size % 4 = 0 THEN 'MERGE_BASE' ELSE 'HEAD' END AS side", f"{CALL_PATH.format('owner')} AS path", f"{FQN.format('owner')} AS class_fqn",
                            "concat('op', p_partkey) AS method_name", "p_size % 3 AS arity", "p_size AS start_line", "concat('op', p_partkey, '(', p_size % 3, ')') AS signature", "owner", "p_partkey")


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = called_symbols(spark, sf_dir).select("pr_key", F.col("p_partkey").alias("l_partkey"), "owner")
    lines = read(spark, sf_dir, "lineitem").join(symbols, "l_partkey")
    return lines.selectExpr("pr_key", f"{CALL_PATH.format('l_suppkey')} AS path", "cast(l_linenumber * 10 + l_quantity % 10 AS int) AS line",
                            "CASE l_returnflag WHEN 'R' THEN concat('s', owner) WHEN 'A' THEN concat('this.s', owner) ELSE 'svc' END AS receiver", f"{FQN.format('l_suppkey')} AS enclosing_type",
                            "CASE WHEN l_linenumber < 7 THEN concat('run', l_linenumber) END AS enclosing_method", "concat('op', l_partkey) AS method_name", "l_linenumber % 3 AS arity",
                            "concat_ws('-', lpad(l_orderkey, 12, '0'), l_linenumber, lpad(l_partkey, 12, '0'), lpad(l_suppkey, 12, '0')) AS site_ord", "l_suppkey", "owner", "l_quantity")


def calling_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a positive balance as types; they import the owners of what they call in quantity."""
    sites = call_sites(spark, sf_dir)
    known = read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    imports = F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, F.expr(FQN.format("owner")))))
    grouped = sites.join(known, "l_suppkey", "left_semi").groupBy("pr_key", "l_suppkey").agg(imports.alias("imports"))
    return grouped.selectExpr("pr_key", "'HEAD' AS side", f"{CALL_PATH.format('l_suppkey')} AS path", "0 AS decl_ord", f"{FQN.format('l_suppkey')} AS fqn", "concat('com.s', l_suppkey % 40) AS package_name", "imports")


def customer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_mktsegment AS pr_key", "CASE WHEN c_acctbal < 0 THEN 'MERGE_BASE' ELSE 'HEAD' END AS side", "concat('src/main/java/com/c/C', c_custkey, '.java') AS path", "c_custkey AS decl_ord",
        "concat('com.c.C', c_custkey) AS fqn", "array(concat('com.c.C', c_custkey div 3)) AS interfaces", "CASE WHEN c_nationkey < 12 THEN concat('com.c.C', c_custkey div 5) END AS super_class", "c_custkey")


def customer_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = customer_types(spark, sf_dir).select("pr_key", "side", "path", "fqn", "c_custkey", F.posexplode(F.array(F.lit("save"), F.lit("load"))).alias("k", "name"))
    return names.selectExpr("pr_key", "side", "path", "fqn", "name", "cast(c_custkey % 2 AS int) AS arity", "10 * (k + 1) AS start_line", "concat(name, '(', c_custkey % 2, ')') AS signature", "2 * c_custkey + k AS sym_ord")


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("concat('C', o_custkey) AS pr_key", "'F.java' AS path", "CASE WHEN o_orderstatus = 'F' THEN 'MERGE_BASE' ELSE 'HEAD' END AS side", "concat('m', o_orderkey) AS method_id",
                                                    "cast(o_orderkey % 40 AS int) AS start_line", "cast(o_orderkey % 40 AS int) + length(o_orderpriority) AS end_line")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return lines.selectExpr("concat('C', o_custkey) AS pr_key", "'F.java' AS path", "CASE l_returnflag WHEN 'A' THEN 'ADDED' WHEN 'R' THEN 'REMOVED' ELSE 'CONTEXT' END AS line_type", "cast(l_partkey % 50 AS int) AS old_no", "cast(l_partkey % 50 AS int) AS new_no")


def order_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(required items, edges): a customer's orders as files; neighbours in time of the same priority are linked."""
    orders = read(spark, sf_dir, "orders").selectExpr("concat('C', o_custkey) AS pr_key", "concat('pkg', o_orderkey % 3, '/F', o_orderkey, '.java') AS path", "o_orderkey", "o_orderdate", "o_orderpriority")
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    required = orders.join(counts, "o_orderkey", "left").select("pr_key", "path", (F.coalesce("n", F.lit(0)) * 100).alias("tokens"))
    before = Window.partitionBy("pr_key").orderBy("o_orderdate", "o_orderkey")
    lagged = orders.select("pr_key", F.col("path").alias("to_path"), "o_orderpriority", F.lag("path").over(before).alias("from_path"), F.lag("o_orderpriority").over(before).alias("was"))
    edges = lagged.where("o_orderpriority = was").select("pr_key", "from_path", "to_path")
    return required, edges


def pack_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE l_returnflag WHEN 'A' THEN 'CALLER' WHEN 'N' THEN 'TEST' ELSE 'OVERRIDE' END"
    return read(spark, sf_dir, "lineitem").selectExpr(
        "concat('O', l_orderkey) AS pr_key", "1 AS slice_no", f"concat_ws('#', {kind}, l_partkey, l_suppkey, l_linenumber) AS item_id", f"{kind} AS kind", "concat('F', l_partkey) AS path", "CASE WHEN l_tax > 0 THEN l_linenumber END AS start_line",
        "cast(l_quantity AS int) AS tokens", "l_linestatus = 'F' AND l_linenumber = 1 AS required", "cast(array() AS array<string>) AS requires", "1 - l_discount AS confidence")


def repeated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of ``pack_candidates`` with contents, of which many lines are the same within an order; some have none."""
    content = "CASE WHEN l_suppkey % 7 != 3 THEN concat('kind ', kind, '\n\n  part  ', l_partkey % 3, '\n}\nsupplier ', l_suppkey % 2, '\nline ', l_linenumber % 2) END"
    key = "concat_ws('#', kind, l_partkey, l_suppkey, l_linenumber) AS item_id"
    texts = read(spark, sf_dir, "lineitem").selectExpr("*", "CASE l_returnflag WHEN 'A' THEN 'CALLER' WHEN 'N' THEN 'TEST' ELSE 'OVERRIDE' END AS kind").selectExpr("concat('O', l_orderkey) AS pr_key", key, f"{content} AS content")
    return pack_candidates(spark, sf_dir).join(texts.distinct(), ["pr_key", "item_id"])


def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as findings; equal texts in a path and line are equal findings of different slices."""
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "'all' AS project", "concat('R', length(text) % 50) AS pr_key", "cast(conv_id AS int) AS slice_no", "cast(turn AS int) AS pos", "concat('f', length(text) % 10, '.java') AS path", "cast(length(text) % 7 AS int) AS line",
        "element_at(array('critical', ' Warning ', 'suggestion', 'fatal'), length(text) % 4 + 1) AS severity", "concat('Finding of ', length(text), ' characters') AS title", "text AS message",
        "CASE WHEN length(text) % 3 = 0 THEN 'shorten' END AS suggestion", "CASE WHEN length(text) % 2 = 0 THEN array(concat('DIFF#', conv_id)) ELSE cast(array() AS array<string>) END AS cited")


def conversation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("concat('R', length(text) % 50) AS pr_key", "concat('f', length(text) % 10, '.java') AS path", "cast(turn % 5 AS int) AS start_line", "cast(turn % 5 + length(text) % 3 AS int) AS end_line")


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers that carry a whole conversation text: fenced JSON, prose, a wrong list, and JSON within prose."""
    body = "substr(to_json(named_struct('message', coalesce(text, ''))), 2)"
    return read(spark, sf_dir, "conversations").selectExpr("conv_id AS pr_key", "turn AS slice_no", f"""CASE turn % 4
      WHEN 0 THEN concat('```json\\n{{"findings":[{{"path":"f.java","line":', turn + 1, ',"severity":"critical","title":"t","citedItemIds":["a"],', {body}, ',{{"path":"","line":3,"title":"x","message":"y"}}]}}\\n```')
      WHEN 1 THEN text
      WHEN 2 THEN '{{"findings":"none"}}'
      ELSE concat('Sure: {{"findings":[{{"path":"g.java","line":true,"title":"t","message":"m"}},{{"path":"g.java","line":2,"severity":"fatal","title":"t","suggestion":"  ",', {body}, ']}} ok') END AS raw""")


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a customer as a Java class with a method for each of its orders."""
    orders = read(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "element_at(array('', 'int a', 'final int a, Map<String, Integer> b'), cast(o_orderkey % 3 + 1 AS int)) AS params")
    text = F.expr("concat('  public long o', o_orderkey, '(', params, ') {\n    return svc.call(', o_orderkey, ', \"a, b(\").get();\n  }\n')")
    bodies = orders.select("c_custkey", F.struct("o_orderkey", text.alias("text")).alias("m")).groupBy("c_custkey").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    named = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(bodies, "c_custkey", "left")
    head = F.expr("concat('package com.n', c_nationkey, ';\n\nimport java.util.Map;\n\n/* orders { */\npublic class C', c_custkey, ' {\n')")
    return named.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(".java")).alias("path"), F.concat(head, F.coalesce(F.array_join("ms.text", ""), F.lit("")), F.lit("}\n")).alias("content"))


SECRET = "hook-secret"
_PAD = {name: "".join(chr(ord(c) ^ byte) for c in SECRET.ljust(64, "\0")) for name, byte in (("inner", 0x36), ("outer", 0x5C))}


def webhook_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries: props are the payload, signed with SECRET, but for errors, whose signature is that of other text.

    The signature is spelled out with SHA-256, so that it does not come from the code that checks it.
    """
    signed = F.when(F.col("event_type") == "error", F.concat("props", F.lit("!"))).otherwise(F.col("props"))
    inner = F.sha2(F.concat(F.lit(_PAD["inner"]), signed), 256)
    signature = F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(_PAD["outer"]).cast("binary"), F.unhex(inner)), 256))
    event = F.expr("CASE event_type WHEN 'signup' THEN 'ping' WHEN 'purchase' THEN 'push' ELSE 'pull_request' END")
    payload = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", event.alias("event"), payload.alias("payload"), F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(_PAD["outer"]).cast("binary"), F.unhex(F.sha2(F.concat(F.lit(_PAD["inner"]), payload), 256))), 256))).otherwise(signature).alias("signature"))


#: Paths with ``#`` for a number, and their categories: each rule, and names that nearly fit it.
SHAPES = (
    ("svc/#/Makefile", "CONFIG"), ("a#/.editorconfig", "CONFIG"), ("ci/Dockerfile.#", "OTHER"), ("conf/a#.toml", "CONFIG"), ("b#.GRADLE", "CONFIG"), ("lib/x#.min.css", "GENERATED"), ("x/gen/Api#.java", "GENERATED"),
    ("gen#/Api.java", "SOURCE"), ("x/generated/T#.kt", "GENERATED"), ("m#.designer.cs", "GENERATED"), ("proto#_pb2.py", "GENERATED"), ("v#/go.sum", "GENERATED"), ("v/go.sum.#", "OTHER"), ("pkg/test_#.py", "TEST"),
    ("pkg/contest_#.py", "SOURCE"), ("a/tests/b#.rb", "TEST"), ("a/latests/b#.rb", "SOURCE"), ("web/x#.spec.ts", "TEST"), ("web/spec.x#.ts", "SOURCE"), ("srv/Handler#IT.java", "TEST"), ("k#_test.go", "TEST"),
    ("docs/n#.adoc", "DOCUMENTATION"), ("x#.java.txt", "DOCUMENTATION"), ("img/i#.WEBP", "BINARY"), ("x#.tar.gz", "BINARY"), ("data#", "OTHER"), (".md#", "OTHER"), ("d#/.java", "OTHER"), ("src/main/java/P#.java", "SOURCE"),
)


def shaped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, path): parts as paths of every shape."""
    shapes = F.array(*(F.lit(path) for path, _ in SHAPES))
    path = F.replace(F.element_at(shapes, (F.col("p_partkey") % len(SHAPES) + 1).cast("int")), F.lit("#"), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, content): a customer's orders as a zip archive; some leave their folder and some hold a file of over 1 KB."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, files in zip(batch["o_custkey"].to_pylist(), batch["files"].to_pylist(), strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as archive:
                    archive.writestr("top/", "")
                    for f in files:
                        archive.writestr(f"top/src/F{f['k']}.txt", f["text"])
                    if key % 11 == 3:
                        archive.writestr("top/../out.txt", "x")
                    if key % 13 == 5:
                        archive.writestr("top/large.txt", "x" * 1025)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"C{k}" for k in batch["o_custkey"].to_pylist()]), pa.array(out, pa.binary())], names=["sha", "content"])

    files = read(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text")).alias("f")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("f")).alias("files"))
    return files.mapInArrow(packed, "sha string, content binary").select(F.lit(REPO).alias("repo"), "sha", "content")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw deliveries; some lack the installation, name no number, or are no JSON."""
    body = """CASE WHEN user_id % 11 = 0 THEN concat('{"action":"', event_type) ELSE concat('{"action":"', CASE event_type WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'synchronize' ELSE event_type END, '",', CASE WHEN user_id % 7 = 0 THEN '' ELSE concat('"installation":{"id":', user_id + 5, '},') END,
      '"repository":{"name":"app","owner":{"login":"acme"}},"pull_request":{"number":', CASE WHEN user_id % 5 = 0 THEN '"none"' ELSE concat('', user_id) END, '},"more":[1]}') END"""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("delivery"), F.expr(body).alias("payload"), F.col("ts").alias("received_at"))


def moved_methods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(methods, lines, files): customers as modified, deleted, renamed and added files, their orders as methods on both sides, line items as lines."""
    change = "element_at(array('MODIFY', 'DELETE', 'RENAME', 'ADD'), cast(c_custkey % 4 + 1 AS int))"
    old = "concat('src/main/java/', CASE WHEN c_custkey % 4 = 2 THEN 'Old' ELSE 'C' END, c_custkey, '.java')"
    files = read(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('N', c_nationkey) AS pr_key", "concat('src/main/java/C', c_custkey, '.java') AS path", f"{old} AS old", f"{change} AS change_type", "CASE WHEN c_custkey % 5 = 4 THEN 'TEST' ELSE 'SOURCE' END AS category")
    files = files.withColumn("previous_path", F.when(F.col("old") != F.col("path"), F.col("old")))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (F.col("o_orderkey") % 40).cast("int").alias("start_line"), (F.col("o_orderkey") % 40 + 3).cast("int").alias("end_line"))
    both = orders.join(files, "c_custkey")
    method = F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("method_id")
    methods = both.where("change_type != 'DELETE'").select("pr_key", F.lit("HEAD").alias("side"), "path", method, "start_line", "end_line")
    methods = methods.union(both.where("change_type != 'ADD'").select("pr_key", F.lit("MERGE_BASE"), "old", method, "start_line", "end_line"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag").join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(files, "c_custkey")
    kind = F.expr("CASE l_returnflag WHEN 'A' THEN 'ADDED' WHEN 'R' THEN 'REMOVED' ELSE 'CONTEXT' END")
    at = (F.col("l_partkey") % 60).cast("int")
    return methods, lines.select("pr_key", "path", kind.alias("line_type"), at.alias("old_no"), at.alias("new_no")), files


def tied_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, changed files, snapshot): line items as edges from suppliers to parts, many of them to one item and of equal confidence."""
    edges = read(spark, sf_dir, "lineitem").selectExpr(
        "concat('B', l_partkey % 25) AS pr_key", "CASE WHEN l_linestatus = 'F' THEN 'CONVENTION' ELSE 'SYMBOL_GRAPH' END AS source", "CASE WHEN l_linestatus = 'F' OR l_returnflag = 'R' THEN 'TESTED_BY' WHEN l_returnflag = 'A' THEN 'CALLS' ELSE 'OVERRIDES' END AS edge_type",
        "concat('s/S', l_suppkey, '.java') AS from_path", "CASE WHEN l_linestatus != 'F' THEN cast(l_linenumber AS int) END AS from_line", "CASE WHEN l_linestatus != 'F' THEN cast(l_linenumber AS int) END AS from_end", "concat('r', l_orderkey) AS from_symbol",
        "concat('p/P', l_partkey, '.java') AS to_path", "CASE WHEN l_linestatus != 'F' AND l_quantity > 10 THEN cast(l_quantity AS int) END AS to_line", "concat('t', l_orderkey, '-', l_linenumber) AS to_symbol", "cast(1 - l_discount AS double) AS confidence")
    suppliers = read(spark, sf_dir, "supplier")
    changed = edges.select("pr_key", F.col("from_path").alias("path")).where("cast(regexp_extract(path, '[0-9]+', 0) AS bigint) % 9 = 0").distinct()
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat("s_name", F.lit(" line "), k.cast("string"))), "\n")
    known = suppliers.where("s_suppkey % 7 != 0").select(F.concat(F.lit("s/S"), "s_suppkey", F.lit(".java")).alias("path"), text.alias("content"))
    return edges, changed, edges.select("pr_key", F.col("from_path").alias("path")).distinct().join(known, "path")


def chained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that require the next one of their order, and the last one the second: chains with a cycle. One of three second ones is required."""
    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    follows = F.when(F.col("l_linenumber") == last, 2).otherwise(F.col("l_linenumber") + 1).cast("string")
    name = lambda k: F.concat(F.lit("L"), k)
    return read(spark, sf_dir, "lineitem").withColumn("follows", follows).select(
        F.concat(F.lit("O"), "l_orderkey").alias("pr_key"), F.lit(1).alias("slice_no"), name(F.col("l_linenumber").cast("string")).alias("item_id"), F.concat(F.lit("F"), "l_partkey").alias("path"), F.col("l_linenumber").cast("int").alias("start_line"),
        F.col("l_quantity").cast("int").alias("tokens"), ((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 3 == 0)).alias("required"), F.array(name(F.col("follows")), F.lit("unknown")).alias("requires"), F.lit(1.0).alias("value"))


def word_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(queries, changed, snapshot, heads): benchmark items as changed files, documents as the files of two heads; long ones are left out there."""
    asked = read(spark, sf_dir, "benchmark").selectExpr("concat('B', item_id % 10) AS pr_key", "concat('q', item_id) AS to_path", "text")
    docs = read(spark, sf_dir, "documents")
    changed = docs.where("doc_id % 9 = 4").select(F.concat(F.lit("B"), (F.col("doc_id") % 10).cast("string")).alias("pr_key"), F.expr(PATH).alias("path"))
    snapshot = docs.select(F.lit(REPO).alias("repo"), F.concat(F.lit("h"), (F.col("doc_id") % 2).cast("string")).alias("sha"), F.expr(PATH).alias("path"), F.col("text").alias("content"))
    heads = asked.select("pr_key").distinct().select("pr_key", F.lit(REPO).alias("repo"), F.concat(F.lit("h"), (F.substring("pr_key", 2, 9).cast("int") % 2).cast("string")).alias("sha"))
    return asked, changed, snapshot, heads


def order_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed, revisions, history): orders as commits of five repositories, their line items as files, suppliers as changes at a time."""
    commits = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "concat('r', o_custkey % 5) AS repo", "cast(o_orderdate AS timestamp) AS commit_ts")
    files = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "concat('f', l_suppkey % 12, '.java') AS path")
    past = files.join(commits, "l_orderkey").select("repo", F.col("l_orderkey").alias("commit"), "commit_ts", "path")
    revisions = read(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) AS pr_key", "concat('r', s_suppkey % 5) AS repo", "timestamp'1995-01-02' + make_interval(0, 0, 0, cast(s_suppkey % 900 AS int)) AS pr_ts", "s_suppkey")
    changed = revisions.select("pr_key", F.explode(F.array(F.expr("s_suppkey % 12"), F.expr("(s_suppkey + 5) % 12"))).alias("f")).select("pr_key", F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(".java")).alias("path"))
    return changed, revisions.drop("s_suppkey"), past


#: Java files of several shapes with ``#`` for a number.
JAVA_SHAPES = (
    "package a.b#;\n\nimport x.Base;\nimport java.util.*;\n\n@Deprecated\npublic final class K# extends Base<String> implements Runnable, y.Other {\n  static { init(); }\n  K#() { super(); }\n  @Override public void run() { go(1, \"}\"); }\n}\n",
    "package a.b#;\n\ninterface I# extends Left, Right<Integer> {\n  int one(final String s, int... rest);\n  default void two() { one(\"\", 1); }\n}\n",
    "enum E# {\n  FIRST(1) { int v() { return 2; } }, SECOND(2);\n  E#(int n) { }\n  int v() { return 1; }\n}\n",
    "package r;\nrecord R#(int a, String b) implements Comparable<R#> {\n  R# { check(a); }\n  public int compareTo(R# other) { return Integer.compare(a, other.a); }\n}\n",
    "package n;\nclass Outer# {\n  class Inner {\n    <T extends Number> T pick(java.util.Map<String, T> m, T[] all) { return all[0]; }\n  }\n  @interface Mark { String value() default \"x\"; }\n}\n",
    "package broken#;\nclass Half {\n  void m( {\n}\n",
)


def java_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): suppliers as Java files of every shape, one of which cannot be parsed."""
    shapes = F.array(*(F.lit(text) for text in JAVA_SHAPES))
    key = F.col("s_suppkey").cast("string")
    content = F.replace(F.element_at(shapes, (F.col("s_suppkey") % len(JAVA_SHAPES) + 1).cast("int")), F.lit("#"), key)
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), key, F.lit(".java")).alias("path"), content.alias("content"))
