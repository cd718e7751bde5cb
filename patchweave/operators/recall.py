"""Related code as typed edges: callers, overrides and conventional tests, each an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.functions.paths import category
from patchweave.functions.text import decapitalize, package_of, simple_name

#: Confidence of each kind of evidence.
RECEIVER, IMPORTED, SAME_PACKAGE, REMOVED_FLOOR, PARENT, IMPLEMENTOR, CONVENTION = 0.85, 0.7, 0.6, 0.9, 0.9, 0.85, 0.95
MAIN, TEST = "src/main/java/", "src/test/java/"
SUFFIXES = ("Test", "Tests", "IT")
EDGE = ["pr_key", "edge_type", "from_path", "from_line", "from_symbol", "to_side", "to_path", "to_line", "to_symbol", "confidence", "source"]


def call_edges(symbols: DataFrame, invocations: DataFrame, types: DataFrame) -> DataFrame:
    """Calls of changed symbols from other files, by name and number of arguments.

    Evidence, strongest first: the receiver names the type; the caller imports it; both are in one package; else there is no edge.
    A call by receiver needs nothing else; the others need a type in the calling file, of which the first counts. Symbols of the
    merge base get at least REMOVED_FLOOR. Calls from test files are TESTED_BY. The first of several equal edges stays.
    """
    first = Window.partitionBy("pr_key", "path").orderBy("decl_ord")
    callers = types.where("side = 'HEAD'").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(F.col("pr_key").alias("c_pr"), F.col("path").alias("c_path"), F.col("package_name").alias("c_package"), F.col("imports").alias("c_imports"))
    called = symbols.select("pr_key", "sym_ord", F.col("side").alias("to_side"), F.col("path").alias("to_path"), "class_fqn", F.col("method_name").alias("name"), "arity", F.col("start_line").alias("to_line"), "signature")
    sites = invocations.select("pr_key", F.col("path").alias("from_path"), F.col("line").alias("from_line"), "receiver", "enclosing_type", "enclosing_method", F.col("method_name").alias("name"), "arity", "site_ord")
    met = called.join(sites, ["pr_key", "name", "arity"]).where("from_path != to_path")
    met = met.join(callers, (F.col("pr_key") == F.col("c_pr")) & (F.col("from_path") == F.col("c_path")), "left")
    own = decapitalize(simple_name(F.col("class_fqn")))
    confidence = (F.when((F.col("receiver") == own) | F.col("receiver").endswith(F.concat(F.lit("."), own)), RECEIVER).when(F.col("c_path").isNull(), None)
                  .when(F.array_contains("c_imports", F.col("class_fqn")), IMPORTED).when((F.col("c_package") != "") & (F.col("c_package") == package_of(F.col("class_fqn"))), SAME_PACKAGE))
    scored = met.withColumn("confidence", confidence).where("confidence IS NOT NULL")
    scored = scored.withColumn("confidence", F.when(F.col("to_side") == "MERGE_BASE", F.greatest("confidence", F.lit(REMOVED_FLOOR))).otherwise(F.col("confidence")))
    kind = F.when(category(F.col("from_path")) == "TEST", "TESTED_BY").otherwise("CALLS")
    edges = scored.select("pr_key", kind.alias("edge_type"), "from_path", "from_line", F.when(F.col("enclosing_method").isNotNull(), F.concat("enclosing_type", F.lit("#"), "enclosing_method")).alias("from_symbol"),
                          "to_side", "to_path", "to_line", F.concat("class_fqn", F.lit("#"), "signature").alias("to_symbol"), "confidence", F.lit("SYMBOL_GRAPH").alias("source"), "sym_ord", F.lit(0).alias("phase"), F.col("site_ord").alias("ord"))
    return first_edges(edges)


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each type, origin and target: the first by symbol, phase and site."""
    same = Window.partitionBy("pr_key", "edge_type", "from_path", "from_line", "to_path", "to_symbol").orderBy("sym_ord", "phase", "ord", F.desc("confidence"))
    return edges.withColumn("nth", F.row_number().over(same)).where("nth = 1").select(*EDGE)


def edge_order() -> Column:
    """What edges are ordered by within a change: by channel; calls and overrides by type, target and origin, the others by origin and target.

    Missing lines come last.
    """
    by_name = F.col("source") != "SYMBOL_GRAPH"
    channel = F.when(F.col("source") == "SYMBOL_GRAPH", 0).when(F.col("source") == "CONVENTION", 1).when(F.col("source") == "LEXICAL_BM25", 2).otherwise(3)
    last = F.lit((1 << 31) - 1)
    return F.struct(channel.alias("channel"), F.when(by_name, F.col("from_path")).otherwise(F.col("edge_type")).alias("first"), "to_path", F.coalesce("to_line", last).alias("to_at"),
                    "from_path", F.coalesce("from_line", last).alias("from_at"), F.coalesce("to_symbol", F.lit("")).alias("symbol"))


def _head_first(types: DataFrame) -> DataFrame:
    """One type for each name and side: the first declared."""
    order = Window.partitionBy("pr_key", "side", "fqn").orderBy("decl_ord")
    return types.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def _supertypes() -> Column:
    return F.array_distinct(F.filter(F.concat(F.coalesce("interfaces", F.array()), F.array("super_class")), lambda x: x.isNotNull()))


def override_edges(symbols: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges between a changed method and the methods of its type's parents and implementors with the same name and arity.

    A parent is looked up at HEAD, else at MERGE_BASE; implementors at HEAD. Supertypes are exploded once, so both are hash joins.
    """
    known = _head_first(types)
    changed = symbols.select("pr_key", "sym_ord", F.col("side").alias("to_side"), F.col("path").alias("to_path"), "class_fqn", "method_name", "arity", F.col("start_line").alias("to_line"), F.concat("class_fqn", F.lit("#"), "signature").alias("to_symbol"))
    above = known.select("pr_key", F.col("side").alias("to_side"), F.col("fqn").alias("class_fqn"), F.explode(_supertypes()).alias("parent"))
    best = Window.partitionBy("pr_key", "fqn").orderBy(F.when(F.col("side") == "HEAD", 0).otherwise(1))
    parents = known.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("pr_key", F.col("fqn").alias("parent"), F.col("side").alias("p_side"))
    body = methods.select("pr_key", F.col("side").alias("p_side"), F.col("fqn").alias("parent"), F.col("name").alias("method_name"), "arity", F.col("path").alias("from_path"), F.col("start_line").alias("from_line"), F.concat("fqn", F.lit("#"), "signature").alias("from_symbol"))
    up = changed.join(above, ["pr_key", "to_side", "class_fqn"]).join(parents, ["pr_key", "parent"]).join(body, ["pr_key", "p_side", "parent", "method_name", "arity"])
    below = known.where("side = 'HEAD'").select("pr_key", F.col("fqn").alias("parent"), F.explode(_supertypes()).alias("class_fqn"))
    down = changed.join(below, ["pr_key", "class_fqn"]).join(body.where("p_side = 'HEAD'"), ["pr_key", "parent", "method_name", "arity"])

    def edges(met: DataFrame, confidence: float, phase: int) -> DataFrame:
        return met.select("pr_key", F.lit("OVERRIDES").alias("edge_type"), "from_path", "from_line", "from_symbol", "to_side", "to_path", "to_line", "to_symbol",
                          F.lit(confidence).alias("confidence"), F.lit("SYMBOL_GRAPH").alias("source"), "sym_ord", F.lit(phase).alias("phase"), F.col("from_symbol").alias("ord"))

    return first_edges(edges(up, PARENT, 1).unionByName(edges(down, IMPLEMENTOR, 2)))


def convention_edges(files: DataFrame, heads: DataFrame, snapshot: DataFrame) -> DataFrame:
    """TESTED_BY edges between a changed Java file and its counterpart by name, if the head of its own change has that.

    ``files`` has pr_key, path and category; ``heads`` pr_key, repo and sha; ``snapshot`` repo, sha and path. Names are looked up by head,
    so that changes with one head share its rows and changes of one repository do not see each other's.
    """
    java = files.where("path LIKE '%.java' AND category IN ('SOURCE', 'TEST')")
    stem = F.regexp_replace("path", r"\.java$", "")
    tests = F.array(*(F.concat(F.replace(stem, F.lit(MAIN), F.lit(TEST)), F.lit(f"{s}.java")) for s in SUFFIXES))
    cut = lambda s: F.replace(stem.substr(F.lit(1), F.length(stem) - len(s)), F.lit(TEST), F.lit(MAIN))
    mains = F.array(*(F.when(stem.endswith(s), F.concat(cut(s), F.lit(".java"))) for s in SUFFIXES))
    named = java.select("pr_key", "path", "category", F.explode(F.when(F.col("category") == "SOURCE", tests).otherwise(mains)).alias("other")).where("other IS NOT NULL AND other != path")
    asked = named.join(heads.select("pr_key", "repo", "sha"), "pr_key")
    found = asked.join(snapshot.select("repo", "sha", F.col("path").alias("other")), ["repo", "sha", "other"], "left_semi")
    is_source = F.col("category") == "SOURCE"
    return found.select("pr_key", F.lit("TESTED_BY").alias("edge_type"), F.when(is_source, F.col("other")).otherwise(F.col("path")).alias("from_path"), F.lit(None).cast("int").alias("from_line"), F.lit(None).cast("string").alias("from_symbol"),
                        F.lit("HEAD").alias("to_side"), F.when(is_source, F.col("path")).otherwise(F.col("other")).alias("to_path"), F.lit(None).cast("int").alias("to_line"), F.lit(None).cast("string").alias("to_symbol"),
                        F.lit(CONVENTION).alias("confidence"), F.lit("CONVENTION").alias("source")).distinct()


