"""Context items: what a reviewer gets to read, with its cost, evidence and dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.config import ReviewConfig
from patchweave.functions import paths
from patchweave.functions.text import bounded, class_header, estimate_tokens, extract_lines, simple_name
from patchweave.operators.diff import hunk_ref

ITEM = ["pr_key", "item_id", "kind", "ref_side", "ref_path", "ref_start", "ref_end", "symbol_id", "content", "tokens", "required", "requires", "confidence", "owner_path"]
KIND_OF_EDGE = {"CALLS": "CALLER", "OVERRIDES": "OVERRIDE", "TESTED_BY": "TEST", "SIMILAR": "RELATED_FILE", "CO_CHANGED": "RELATED_FILE"}
#: Fixed value: what stands for the content of a sensitive file.
WITHHELD = "sensitive file, content withheld"


def _item(df: DataFrame, **columns: Column) -> DataFrame:
    missing = {"ref_start": "int", "ref_end": "int", "symbol_id": "string", "requires": "array<string>", "confidence": "double", "owner_path": "string"}
    empty = {c: F.array().cast("array<string>") if c == "requires" else F.lit(None).cast(t) for c, t in missing.items()}
    return df.select(*((F.col(c) if c == "pr_key" else columns.get(c, empty.get(c))).alias(c) for c in ITEM))


def diff_items(rendered: DataFrame, files: DataFrame, config: ReviewConfig = ReviewConfig()) -> DataFrame:
    """A required item for each hunk of a file that is not sensitive; ``files`` has change_type, and is not read where the hunks have it."""
    side, start, end = hunk_ref(F.col("change_type"))
    known = rendered if "change_type" in rendered.columns else rendered.join(files.select("pr_key", "path", "change_type"), ["pr_key", "path"])
    met = known.where(~paths.is_sensitive(F.col("path"), config.sensitive_patterns))
    return _item(met, item_id=F.concat(F.lit("DIFF#"), "path", F.lit("#"), F.col("hunk_idx").cast("string")), kind=F.lit("DIFF_HUNK"), ref_side=side, ref_path=F.col("path"), ref_start=start, ref_end=end,
                 content=F.col("rendered"), tokens=estimate_tokens(F.col("rendered")), required=F.lit(True))


def metadata_items(files: DataFrame, with_hunks: DataFrame, config: ReviewConfig = ReviewConfig()) -> DataFrame:
    """A required item for each sensitive file and each file without hunks. Tokens are those of the path, or of the statistics."""
    known = with_hunks.select("pr_key", "path", F.lit(True).alias("parsed")).distinct()
    all_files = files.join(known, ["pr_key", "path"], "left")
    stats = paths.file_stats(F.col("change_type"), F.col("additions"), F.col("deletions"))
    hidden = paths.is_sensitive(F.col("path"), config.sensitive_patterns)
    shown = all_files.where(hidden | F.col("parsed").isNull())
    content = F.when(hidden, F.concat("path", F.lit(f" ({WITHHELD})"))).otherwise(F.concat("path", F.lit(" ("), stats, F.lit(")")))
    return _item(shown, item_id=F.concat(F.lit("FILE#"), "path"), kind=F.lit("METADATA"), ref_side=F.lit("HEAD"), ref_path=F.col("path"), content=content,
                 tokens=F.when(hidden, estimate_tokens(F.col("path"))).otherwise(estimate_tokens(stats)), required=F.lit(True))


def symbol_items(symbols: DataFrame, contents: DataFrame, config: ReviewConfig) -> DataFrame:
    """Bodies of changed methods (required; the last of equal ids stays) and headers of their classes (optional; the first stays)."""
    met = symbols.join(contents, ["pr_key", "side", "path"])
    if not config.emit_sensitive_methods:
        met = met.where(~paths.is_sensitive(F.col("path"), config.sensitive_patterns))
    symbol = F.concat("class_fqn", F.lit("#"), "signature")
    met = met.withColumn("symbol", symbol)
    last = Window.partitionBy("pr_key", "symbol").orderBy(F.desc("sym_ord"))
    bodies = met.withColumn("nth", F.row_number().over(last)).where("nth = 1")
    body = extract_lines(F.col("content"), F.col("start_line"), F.col("end_line"))
    class_id = F.concat(F.lit("CLASS#"), "class_fqn")
    methods = _item(bodies, item_id=F.concat(F.lit("METHOD#"), "symbol"), kind=F.lit("CHANGED_METHOD"), ref_side=F.col("side"), ref_path=F.col("path"), ref_start=F.col("start_line"), ref_end=F.col("end_line"), symbol_id=F.col("symbol"),
                    content=body, tokens=estimate_tokens(body), required=F.lit(True), requires=F.array(class_id))
    first = Window.partitionBy("pr_key", "class_fqn").orderBy("sym_ord")
    heads = met.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    header = class_header(F.col("content"), simple_name(F.col("class_fqn")))
    classes = _item(heads, item_id=class_id, kind=F.lit("METADATA"), ref_side=F.col("side"), ref_path=F.col("path"), symbol_id=F.col("class_fqn"), content=header, tokens=estimate_tokens(header), required=F.lit(False), owner_path=F.col("path"))
    return methods.unionByName(classes)


def strongest_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """One edge for each key: content and confidence of the strongest (the first of equals), owner of the first.

    ``edges`` has owner and edge_ord, which is anything that can be ordered.
    """
    rest = [c for c in edges.columns if c not in (*key, "owner")]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("least"), "edge_ord")).alias("best")
    return edges.groupBy(*key).agg(best, F.min_by("owner", "edge_ord").alias("owner")).select(*key, "best.*", "owner")


def related_items(edges: DataFrame, changed: DataFrame, snapshot: DataFrame, config: ReviewConfig) -> DataFrame:
    """Callers, overrides, tests and related files from unchanged, insensitive files with known content; ``edges`` has edge_ord and from_end."""
    kind = F.lit(None).cast("string")
    for edge, name in KIND_OF_EDGE.items():
        kind = F.when(F.col("edge_type") == edge, name).otherwise(kind)
    outside = edges.where(~paths.is_sensitive(F.col("from_path"), config.sensitive_patterns)).join(changed.select("pr_key", F.col("path").alias("from_path")).distinct(), ["pr_key", "from_path"], "left_anti")
    at = F.coalesce(F.col("from_line").cast("string"), F.lit("file"))
    named = outside.select("pr_key", F.concat_ws("#", kind, "from_path", at).alias("item_id"), kind.alias("kind"), "from_path", "from_line", "from_end", "from_symbol", "confidence", "edge_ord", F.col("to_path").alias("owner"))
    one = strongest_edges(named, ["pr_key", "item_id"])
    met = one.join(snapshot.select("pr_key", F.col("path").alias("from_path"), F.col("content").alias("file")), ["pr_key", "from_path"])
    content = F.when(F.col("from_line").isNull(), bounded(F.col("file"), config.max_file_kb)).otherwise(extract_lines(F.col("file"), F.col("from_line"), F.coalesce("from_end", "from_line")))
    return _item(met, item_id=F.col("item_id"), kind=F.col("kind"), ref_side=F.lit("HEAD"), ref_path=F.col("from_path"), ref_start=F.col("from_line"), ref_end=F.coalesce("from_end", "from_line"), symbol_id=F.col("from_symbol"),
                 content=content, tokens=estimate_tokens(content), required=F.lit(False), confidence=F.col("confidence"), owner_path=F.col("owner"))


def all_items(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
