"""Whole plans: from changed files to frozen, packed slices, for all changes at once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchweave.config import SCHEMA_VERSION, POLICY_VERSION, ReviewConfig
from patchweave.functions import ids, scoring
from patchweave.functions.paths import is_sensitive
from patchweave.operators import covering, diff, freeze, history, items, lexical, packing, recall, review, slicing, symbols
from patchweave.sources.archives import snapshot_files
from patchweave.sources.declarations import parse_kept
from patchweave.sources.java import parse_java
from patchweave.sources.scratch import stored


@dataclass(frozen=True)
class Tables:
    """What a build reads. ``revisions``: pr_key, repo, pr_number, merge_base, head. ``files``: one row for each changed file.

    ``snapshot``: repo, sha, path, content of the head, and kind where some files were read one by one (``head_snapshot``);
    ``base``: repo, sha, path, content of the merge base. ``history``, for co-change recall: repo, commit, commit_ts, path; ``revisions``
    then has pr_ts, and of the history only what lies before it is used.
    """

    revisions: DataFrame
    files: DataFrame
    snapshot: DataFrame
    base: DataFrame
    history: DataFrame | None = None


def head_snapshot(revisions: DataFrame, archives: DataFrame, lazy: DataFrame, config: ReviewConfig = ReviewConfig()) -> DataFrame:
    """(repo, sha, path, content, kind) of the heads: the files of a sound archive, else those that were read one by one.

    ``archives`` has repo, sha and content, the bytes of a zip; ``lazy`` has repo, sha, path and content.
    """
    heads = revisions.select("repo", F.col("head").alias("sha")).distinct()
    unpacked = stored(snapshot_files(archives.join(heads, ["repo", "sha"], "left_semi"), config.max_file_kb << 10, config.max_snapshot_mb << 20), "unpacked")
    rest = lazy.join(heads, ["repo", "sha"], "left_semi").join(unpacked.select("repo", "sha").distinct(), ["repo", "sha"], "left_anti")
    return unpacked.withColumn("kind", F.lit("ARCHIVE")).unionByName(rest.select("repo", "sha", "path", "content", F.lit("CONTENTS_LAZY").alias("kind")))


def identify(tables: Tables, config: ReviewConfig) -> DataFrame:
    """``revisions`` with patch_sha, corpus_key and context_id; a change without files has the digest of nothing."""
    met = tables.revisions.join(ids.patch_sha(tables.files), "pr_key", "left").withColumn("patch_sha", F.coalesce("patch_sha", F.sha2(F.lit(""), 256)))
    keyed = met.withColumn("corpus_key", ids.corpus_key(F.col("repo"), F.col("merge_base"), F.col("head"), F.col("patch_sha")))
    return keyed.withColumn("context_id", ids.context_id(F.col("corpus_key"), config))


def needed_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pr_key, path) of the Java files to parse at the head, and of those to load at the merge base, by their old paths."""
    java = files.where("path LIKE '%.java'")
    head = java.where("change_type != 'DELETE' AND category IN ('SOURCE', 'TEST')").select("pr_key", "path").distinct()
    return head, java.where("change_type != 'ADD'").select("pr_key", F.coalesce("previous_path", "path").alias("path")).distinct()


def capabilities(tables: Tables, code: DataFrame, contents: DataFrame, summary: DataFrame, states: DataFrame, config: ReviewConfig) -> DataFrame:
    """(pr_key, capabilities): how complete patches, head, merge base and parsing are, and which channels were on."""
    head, base = needed_sources(tables.files)
    failed = code.where("row = 'failure' AND side = 'HEAD'").select("pr_key", "path", F.lit(True).alias("failed")).distinct()
    loaded = contents.where("side = 'MERGE_BASE'").select("pr_key", "path", F.lit(True).alias("loaded")).distinct()
    no = F.lit(False)
    attempts = head.join(failed, ["pr_key", "path"], "left").select("pr_key", F.lit("HEAD").alias("side"), no.alias("loaded"), F.coalesce("failed", no).alias("failed"))
    attempts = attempts.union(base.join(loaded, ["pr_key", "path"], "left").select("pr_key", F.lit("MERGE_BASE"), F.coalesce("loaded", no), no))
    kind = F.col("kind") if "kind" in tables.snapshot.columns else F.lit("ARCHIVE")
    heads = tables.snapshot.groupBy("repo", F.col("sha").alias("head")).agg(F.bool_or(kind == "ARCHIVE").alias("whole"))
    state = F.when(F.col("whole"), "COMPLETE").when(F.col("whole").isNotNull(), "PARTIAL").otherwise("MISSING")
    met = tables.revisions.join(heads, ["repo", "head"], "left").join(summary.select("pr_key", "patch_state"), "pr_key", "left").join(freeze.capability_report(attempts), "pr_key", "left").join(states, "pr_key", "left")
    channel = lambda on: F.lit("ENABLED" if on else "DISABLED_BY_CONFIG")
    return met.select("pr_key", F.struct(
        F.coalesce("patch_state", F.lit("COMPLETE")).alias("patch"), state.alias("headSnapshot"), F.coalesce("base_state", F.lit("COMPLETE")).alias("mergeBaseFiles"), F.coalesce("ast_coverage", F.lit(1.0)).alias("astCoverage"),
        channel(config.symbol_graph).alias("symbolRecall"), channel(config.bm25).alias("lexicalRecall"), F.col("co_change").alias("coChange")).alias("capabilities"))


def source_contents(tables: Tables, whole_snapshot: bool = False) -> DataFrame:
    """(pr_key, side, path, content) of the files to parse: changed Java files at head, their old versions at the merge base.

    ``whole_snapshot`` takes all Java files of the head, so that callers in unchanged files are found. Only paths that are needed
    meet the wide content column.
    """
    heads = tables.revisions.select("pr_key", "repo", F.col("head").alias("sha"))
    bases = tables.revisions.select("pr_key", "repo", F.col("merge_base").alias("sha"))
    head_paths, base_paths = needed_sources(tables.files)
    java = "path LIKE '%.java'"
    # a head's contents meet the paths, not all changes of that head
    head = heads.join(tables.snapshot.where(java), ["repo", "sha"]) if whole_snapshot else heads.join(head_paths, "pr_key").join(tables.snapshot.where(java), ["repo", "sha", "path"])
    old = bases.join(base_paths, "pr_key")
    # files renamed from another kind are few, and other contents need not be dealt out for them
    renamed = stored(old.where(f"NOT {java}"), "renamed")
    base = old.where(java).join(tables.base.where(java), ["repo", "sha", "path"]).unionByName(renamed.join(tables.base.where(f"NOT {java}"), ["repo", "sha", "path"]))
    return head.select("pr_key", F.lit("HEAD").alias("side"), "path", "content").union(base.select("pr_key", F.lit("MERGE_BASE"), "path", "content"))


def co_change_states(tables: Tables, config: ReviewConfig) -> DataFrame:
    """(pr_key, co_change): the state of the co-change channel for each change."""
    known = tables.revisions.select("pr_key").distinct()
    if not config.co_change:
        return known.withColumn("co_change", F.lit("DISABLED_BY_CONFIG"))
    return known.withColumn("co_change", F.lit("UNAVAILABLE_NO_HISTORY")) if tables.history is None else history.channel_states(tables.history, tables.revisions)


def recall_edges(changed: DataFrame, parsed: DataFrame, lines: DataFrame, tables: Tables, states: DataFrame, config: ReviewConfig) -> DataFrame:
    """Edges of all channels that are switched on, numbered in a fixed order within a change."""
    types = parsed.where("row = 'type'").withColumnRenamed("ord", "decl_ord")
    methods = parsed.where("row = 'method'")
    sites = parsed.where("row = 'call' AND side = 'HEAD'").select("pr_key", "path", F.col("start_line").alias("line"), "receiver", F.col("fqn").alias("enclosing_type"), "enclosing_method", F.col("name").alias("method_name"), "arity", F.format_string("%s %08d", "path", "ord").alias("site_ord"))
    channels = []
    if config.symbol_graph:
        channels += [recall.call_edges(changed, sites, types), recall.override_edges(changed, types, methods)]
    if config.conventions:
        heads = tables.revisions.select("pr_key", "repo", F.col("head").alias("sha"))
        channels.append(recall.convention_edges(tables.files, heads, tables.snapshot))
    if config.bm25:
        heads = tables.revisions.select("pr_key", "repo", F.col("head").alias("sha"))
        index = stored(lexical.index_files(tables.snapshot.join(heads, ["repo", "sha"], "left_semi"), config.sensitive_patterns, config.max_file_kb), "words")
        asked = lexical.changed_words(lines, tables.files, config.sensitive_patterns)
        channels.append(lexical.lexical_edges(lexical.related_files(asked, tables.files, index, heads)))
    if config.co_change and tables.history is not None:
        old_enough = tables.revisions.join(states.where("co_change = 'ENABLED'"), "pr_key", "left_semi")
        rules = history.co_change_rules(tables.files, old_enough, history.narrow_commits(tables.history))
        channels.append(history.co_change_edges(rules))
    if not channels:
        return recall.first_edges(recall.override_edges(changed.limit(0), types, methods).selectExpr("*", "0 AS sym_ord", "0 AS phase", "'' AS ord"))
    return items.all_items(*channels)


def related(edges: DataFrame, code: DataFrame) -> DataFrame:
    """Edges with ``edge_ord``, their place within the change, and ``from_end``, the last line of the first method of that name."""
    methods = code.where("side = 'HEAD' AND row = 'method'").select("pr_key", F.col("path").alias("from_path"), F.concat("fqn", F.lit("#"), "signature").alias("from_symbol"), "end_line", "ord")
    ends = methods.groupBy("pr_key", "from_path", "from_symbol").agg(F.min_by("end_line", "ord").alias("from_end"))
    return edges.join(ends, ["pr_key", "from_path", "from_symbol"], "left").withColumn("edge_ord", recall.edge_order())


def build_plans(tables: Tables, config: ReviewConfig = ReviewConfig(), whole_snapshot: bool = False, store: DataFrame | None = None, declarations: str | None = None) -> dict[str, DataFrame]:
    """Plans of all changes, by name. ``declarations``, a folder, keeps what was parsed by content, so that later builds parse only new contents.

    ``results``: (pr_key, status, reason), READY, REUSED from ``store`` (context_id, plan_json) without being built anew, or SKIPPED
    where no revision is known; rows that cannot be read stop no change, and ``build_isolated`` keeps exceptions to theirs. ``plans``: (pr_key, context_id, plan_json, diagnostics) of the ready
    and reused ones. ``items``, ``slices`` (pr_key, slice_no, path), ``packed`` (status of every item), ``edges`` and ``requests``
    (pr_key, slice_no, prompt) of the ready ones.
    """
    identified = stored(identify(tables, config), "identities")
    known_keys = tables.revisions.where("merge_base IS NOT NULL AND head IS NOT NULL").select("pr_key").distinct()
    skipped = tables.files.select("pr_key").union(tables.revisions.select("pr_key")).distinct().join(known_keys, "pr_key", "left_anti")
    fresh, reused = (identified, None) if store is None else freeze.reuse(identified, store)
    # what is small is stored, so that its size is known before texts are dealt out for its sake
    wanted = stored(fresh.select("pr_key").join(known_keys, "pr_key", "left_semi"), "wanted")
    whole = tables.files.join(wanted, "pr_key", "left_semi")
    files = stored(whole.select("pr_key", "path", "previous_path", "change_type", "category", "additions", "deletions", freeze.no_patch().alias("missing")), "files")
    tables = Tables(tables.revisions.join(wanted, "pr_key", "left_semi"), files, tables.snapshot, tables.base, tables.history)

    # patches are dealt out by file once; their hunks stay where they are
    gathered = stored(diff.gather_hunks(diff.parse_patches(whole)).join(files.select("pr_key", "path", "change_type", "category"), ["pr_key", "path"]), "patches", "zstd")
    rendered, checks = diff.render_gathered(gathered), gathered.groupBy("pr_key", "path").agg(F.count("*").alias("n_hunks"), F.min("error").alias("error"))
    contents = stored(source_contents(tables, whole_snapshot), "contents", "zstd")
    sides = ["pr_key", "side", "path"]
    code = stored(parse_java(contents, sides) if declarations is None else parse_kept(contents, sides, declarations), "code")
    methods = code.where("row = 'method'").select("pr_key", "side", "path", "fqn", "name", "signature", "arity", "start_line", "end_line")
    located = symbols.locate_changed(methods, diff.gathered_lines(gathered.where("category = 'SOURCE' AND path LIKE '%.java'")), files)
    order = F.struct(F.when(F.col("side") == "HEAD", 0).otherwise(1), "path", "start_line", "signature")
    changed = stored(located.select("pr_key", "side", "path", F.col("fqn").alias("class_fqn"), F.col("name").alias("method_name"), "arity", "start_line", "end_line", "signature", order.alias("sym_ord")), "changed")
    states = co_change_states(tables, config)
    edges = stored(recall_edges(changed, code, diff.gathered_lines(gathered), tables, states, config), "recall")

    # only what edges come from is read with its content, and only where it can be an item
    outside = edges.select("pr_key", F.col("from_path").alias("path")).where(~is_sensitive(F.col("path"), config.sensitive_patterns)).distinct().join(files, ["pr_key", "path"], "left_anti")
    origins = stored(outside.join(tables.revisions.select("pr_key", "repo", F.col("head").alias("sha")), "pr_key"), "origins")
    head_files = origins.join(tables.snapshot.select("repo", "sha", "path", "content"), ["repo", "sha", "path"]).select("pr_key", "path", "content")
    full = items.all_items(items.diff_items(rendered, files, config), items.metadata_items(files, gathered.where("error IS NULL"), config), items.symbol_items(changed, contents, config), items.related_items(related(edges, code), files, head_files, config))
    # contents are put together anew where they are read
    found = stored((full.withColumn("pieces", covering.pieces(F.col("content"))) if config.covering else full).drop("content"), "items")

    required = found.where("required").select("pr_key", F.col("ref_path").alias("path"), "tokens")
    assigned = slicing.slice_paths(required, edges.select("pr_key", "from_path", "to_path"), config.context_budget)
    slices = stored(slicing.with_fallback(assigned, tables.revisions), "slices")
    home = F.when(F.col("required"), F.col("ref_path")).otherwise(F.coalesce("owner_path", "ref_path"))
    placed = found.withColumn("home", home).join(slices.withColumnRenamed("path", "home"), ["pr_key", "home"])
    parts = ["pieces"] if config.covering else []
    scored = placed.select("pr_key", "slice_no", "item_id", F.col("ref_path").alias("path"), F.col("ref_start").alias("start_line"), "tokens", "required", "requires", scoring.heuristic_score(F.col("kind"), F.col("confidence")).alias("value"), *parts)
    packed = stored((covering if config.covering else packing).pack_slices(scored, config.context_budget), "packed")

    summary = stored(freeze.change_summary(files, checks), "summary")
    shown = packed.join(found.select("pr_key", "item_id", "kind", "ref_path", "ref_start", "ref_end", "symbol_id"), ["pr_key", "item_id"])
    entry = F.struct("slice_no", F.when(F.col("status") == "included", 0).otherwise(1).alias("dropped"), "pack_ord", "item_id", "kind", F.col("ref_path").alias("path"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), F.col("symbol_id").alias("symbol"), "tokens")
    gathered = shown.groupBy("pr_key").agg(F.sort_array(F.collect_list(entry)).alias("items"))
    used = packed.where("status = 'included'").groupBy("pr_key", "slice_no").agg(F.sum("tokens").alias("tokens"))
    sliced = freeze.themes(slices, ["pr_key", "slice_no"]).join(used, ["pr_key", "slice_no"], "left").select("pr_key", F.struct("slice_no", "theme", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(config.context_budget).alias("budget")).alias("s"))
    sliced = sliced.groupBy("pr_key").agg(F.sort_array(F.collect_list("s")).alias("slices"))
    hidden = files.where(is_sensitive(F.col("path"), config.sensitive_patterns)).groupBy("pr_key").agg(F.count("*").alias("n_hidden"))
    counted = edges.groupBy("pr_key").agg(F.count("*").alias("n_edges"))
    named = identified.join(wanted, "pr_key", "left_semi").join(summary, "pr_key", "left").join(gathered, "pr_key", "left").join(sliced, "pr_key", "left")
    named = named.join(capabilities(tables, code, contents, summary, states, config), "pr_key", "left").join(hidden, "pr_key", "left").join(counted, "pr_key", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    plan = F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.col("context_id").alias("contextId"), F.col("corpus_key").alias("corpusKey"), F.lit(POLICY_VERSION).alias("policyVersion"), F.lit(config.fingerprint()).alias("configFingerprint"), "repo", "pr_number", "head",
                    F.struct("n_files", "additions", "deletions", "n_hunks", "patch_state", F.col("slices.theme").alias("themes")).alias("summary"), "slices", "items", "capabilities")
    diagnostics = F.struct(none("missing_patches").alias("missingPatches"), none("parse_failures").alias("parseFailures"), none("n_hidden").alias("sensitiveSkipped"), none("n_edges").alias("edgeCount"))
    plans = stored(named.select("pr_key", "context_id", freeze.canonical_json(plan).alias("plan_json"), freeze.canonical_json(diagnostics).alias("diagnostics")), "plans")
    results = plans.select("pr_key", F.lit("READY").alias("status"), F.lit(None).cast("string").alias("reason")).union(skipped.select("pr_key", F.lit("SKIPPED"), F.lit("no revision")))
    if reused is not None:
        plans = plans.unionByName(reused.select("pr_key", "context_id", "plan_json", F.lit(None).cast("string").alias("diagnostics")))
        results = results.union(reused.select("pr_key", F.lit("REUSED"), F.lit(None).cast("string")))
    return {"items": full, "edges": edges, "slices": slices, "packed": packed, "plans": plans, "results": results, "requests": review_requests(full, packed, identified)}


#: Fixed value: what the reason of a failed build begins with.
FAILED = "context build failed: "


def _reason(fault: Exception) -> str:
    """What an exception says of the change: of a failed task, the last error that its trace names."""
    named = re.findall(r"^\s*(?:[\w.]+\.)?\w+(?:Error|Exception): ([^\n]+)", str(fault), re.MULTILINE)
    return FAILED + (named[-1] if named else str(fault).strip().partition("\n")[0])[:500]


def build_isolated(tables: Tables, config: ReviewConfig = ReviewConfig(), build: Callable[..., dict[str, DataFrame]] = build_plans, **options) -> dict[str, DataFrame]:
    """What ``build`` gives, but a change whose build raises is SKIPPED with the reason in ``results``, and the others are built.

    All changes are built at once. Only if that fails they are parted in two by a hash of their key, and each part is tried by itself, so
    a faulty change costs as many more builds as the logarithm of the number of changes. If no change at all can be built, it is
    no fault of a change, and the first exception is raised.
    """
    built: list[dict[str, DataFrame]] = []
    faults: list[tuple[str, str]] = []
    first: list[Exception] = []

    def attempt(depth: int, rest: int) -> None:
        mine = F.pmod(F.xxhash64("pr_key"), F.lit(1 << depth)) == rest
        part = replace(tables, revisions=tables.revisions.where(mine), files=tables.files.where(mine)) if depth else tables
        keys = part.revisions.select("pr_key").union(part.files.select("pr_key")).distinct().limit(2).collect() if depth else [None, None]
        if not keys:
            return
        try:
            built.append(build(part, config, **options))
        except Exception as fault:  # whatever a change's parser raises
            first.append(fault)
            if len(keys) == 1:
                faults.append((keys[0].pr_key, _reason(fault)))
            else:
                attempt(depth + 1, rest)
                attempt(depth + 1, rest + (1 << depth))

    attempt(0, 0)
    if not built:
        raise first[0]
    out = {name: items.all_items(*(b[name] for b in built)) for name in built[0]}
    skipped = tables.revisions.sparkSession.createDataFrame([(key, "SKIPPED", reason) for key, reason in faults], "pr_key string, status string, reason string")
    return out | {"results": out["results"].unionByName(skipped)}


def review_requests(found: DataFrame, packed: DataFrame, identified: DataFrame) -> DataFrame:
    """(pr_key, slice_no, prompt): the included items of each slice as a request, with the lines of diffs numbered."""
    kept = packed.where("status = 'included'").select("pr_key", "slice_no", "item_id", "pack_ord")
    hunks = found.where("kind = 'DIFF_HUNK'").select("pr_key", "item_id", F.col("content").alias("rendered"))
    numbered = diff.annotate(hunks, ["pr_key", "item_id"])
    met = kept.join(found, ["pr_key", "item_id"]).join(numbered, ["pr_key", "item_id"], "left").join(identified.select("pr_key", "repo", "pr_number", "context_id"), "pr_key")
    return review.render_prompts(met.select("pr_key", "slice_no", "repo", "pr_number", "context_id", "pack_ord", "item_id", "kind", F.col("ref_path").alias("path"), "symbol_id", F.col("ref_start").alias("start_line"),
                                            F.col("ref_end").alias("end_line"), "required", F.coalesce("annotated", "content").alias("content")))


def plan_comment(plans: DataFrame, title: str = "") -> DataFrame:
    """(pr_key, comment): a plan's headline as text, below a heading if there is a ``title``."""
    # The texts of the comment.
    schema = (
        "head string, policyVersion string, summary struct<n_files:bigint,additions:bigint,deletions:bigint>, slices array<struct<slice_no:int>>, "
        "capabilities struct<patch:string,headSnapshot:string,mergeBaseFiles:string,astCoverage:double>, items array<struct<dropped:int,kind:string,symbol:string>>"
    )
    read = plans.select("pr_key", F.from_json("plan_json", schema).alias("p"))
    kept = F.filter(F.coalesce("p.items", F.array().cast("array<struct<dropped:int,kind:string,symbol:string>>")), lambda i: i["dropped"] == 0)
    count = lambda kind: F.size(F.filter(kept, lambda i: i["kind"] == kind)).cast("string")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    methods = F.array_sort(F.array_distinct(F.transform(F.filter(kept, lambda i: i["kind"] == "CHANGED_METHOD"), lambda i: i["symbol"])))
    listed = F.array_join(F.transform(F.slice(methods, 1, 10), lambda m: F.concat(F.lit("- `"), m, F.lit("`\n"))), "")
    share = F.floor(F.col("p.capabilities.astCoverage") * 100 + 0.5).cast("string")
    body = F.concat(
        F.lit(f"## {title}\n\n" if title else ""),
        F.lit("Context built for `"), F.left("p.head", F.lit(7)), F.lit("` · policy `"), F.col("p.policyVersion"), F.lit("` · slices: **"), F.greatest(F.size("p.slices"), F.lit(0)).cast("string"),
        F.lit("**\n\nChanged files: **"), number("p.summary.n_files"), F.lit("** (+"), number("p.summary.additions"), F.lit(" / -"), number("p.summary.deletions"), F.lit(")\n\n"),
        F.when(F.size(methods) > 0, F.concat(F.lit("Changed methods:\n"), listed, F.when(F.size(methods) > 10, "- …\n").otherwise(""), F.lit("\n"))).otherwise(""),
        F.lit("Related context: **"), count("CALLER"), F.lit("** callers, **"), count("OVERRIDE"), F.lit("** overrides, **"), count("TEST"), F.lit("** test references\n"),
        F.lit("\nCapabilities: patch="), F.col("p.capabilities.patch"), F.lit(", snapshot="), F.col("p.capabilities.headSnapshot"), F.lit(", mergeBase="), F.col("p.capabilities.mergeBaseFiles"),
        F.lit(", astCoverage="), share, F.lit("%\n"),
    )
    return read.select("pr_key", body.alias("comment"))
