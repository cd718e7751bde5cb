"""All registered queries of the change-review engine and their SQL counterparts.

The SQL is written on its own, on the driver's tables, not generated from the DataFrame plans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.config import ReviewConfig
from patchweave.functions import ids, paths, scoring, text
from patchweave.operators import covering, diff, evaluation, freeze, history, items, lexical, packing, publish, recall, replay, review, slicing, symbols
from patchweave.plans import domain
from patchweave.plans.pipeline import Tables, build_plans, needed_sources
from patchweave.sources import archives, declarations
from patchweave.sources.java import parse_java
from patchweave.sources.scratch import shared_dir, stored
from patchweave.streaming import events, newest

FLAGSHIP = "change_summary"
PACK_BUDGET, SLICE_BUDGET = 60, 1500
RECALL_LIMITS = [(1, None), (2, None), (None, 30), (2, 30)]

# ---- DuckDB views of the derived domain ----

FILES = r"""files AS (
  SELECT *, CASE status WHEN 'added' THEN 'ADD' WHEN 'removed' THEN 'DELETE' WHEN 'renamed' THEN 'RENAME' ELSE 'MODIFY' END AS change_type,
         CASE WHEN status = 'renamed' THEN 'old/' || path END AS previous_path, len(string_split(content, chr(10))) AS n_lines
  FROM (SELECT source AS pr_key, doc_id, text AS content, n_chars,
    CASE doc_id % 12
      WHEN 0 THEN 'src/main/java/com/acme/p' || ((doc_id // 12) % 7) || '/D' || doc_id || '.java'
        WHEN 1 THEN 'src/test/java/com/acme/p' || ((doc_id // 12) % 7) || '/D' || (doc_id - 1) || 'Test.java'
      WHEN 2 THEN 'web/m' || doc_id || '/package-lock.json' WHEN 3 THEN 'conf/c' || doc_id || '/.env.local'
        WHEN 4 THEN 'assets/logo' || doc_id || '.png' WHEN 5 THEN 'docs/Guide' || doc_id || '.md'
      WHEN 6 THEN 'conf/app' || doc_id || '.yml' WHEN 7 THEN 'tools/run' || doc_id || '.py'
        WHEN 8 THEN 'src/main/java/com/acme/p' || ((doc_id // 12) % 7) || '/CredentialsD' || doc_id || '.java'
      WHEN 9 THEN 'api/client' || doc_id || '.pb.go' WHEN 10 THEN 'keys/server' || doc_id || '.pem' ELSE 'data/blob' || doc_id || '.xyz' END AS path,
    ['added', 'modified', 'removed', 'renamed', 'copied'][CAST(doc_id % 5 AS INT) + 1] AS status
  FROM documents)
)"""
CATEGORY = "CASE doc_id % 12 WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'TEST' WHEN 2 THEN 'GENERATED' WHEN 3 THEN 'OTHER' WHEN 4 THEN 'BINARY' WHEN 5 THEN 'DOCUMENTATION' WHEN 6 THEN 'CONFIG' WHEN 7 THEN 'SOURCE' WHEN 8 THEN 'SOURCE' WHEN 9 THEN 'GENERATED' ELSE 'OTHER' END"
LINES = FILES + r""", raw AS (
  SELECT pr_key, path, doc_id, change_type, n_lines, unnest(string_split(content, chr(10))) AS content, unnest(range(n_lines)) AS i FROM files
        WHERE NOT ends_with(path, '.png')
), lines AS (
  SELECT *, CAST(i // 20 AS INT) AS hunk_idx, ['CONTEXT', 'ADDED', 'REMOVED'][i % 3 + 1] AS line_type,
         sum(CASE WHEN i % 3 != 1 THEN 1 ELSE 0 END) OVER w AS olds, sum(CASE WHEN i % 3 != 2 THEN 1 ELSE 0 END) OVER w AS news
  FROM raw WINDOW w AS (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING)
), numbered AS (
  SELECT pr_key, path, doc_id, change_type, hunk_idx, CAST(i % 20 AS INT) AS line_idx, line_type, content, i,
         CASE WHEN line_type != 'ADDED' THEN CAST(olds + 10 * hunk_idx AS INT) END AS old_no, CASE
           WHEN line_type != 'REMOVED' THEN CAST(news + 10 * hunk_idx AS INT) END AS new_no,
         CAST(olds + CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END + 10 * hunk_idx AS INT) AS old_at, CAST(news + CASE WHEN i % 3 = 2 THEN 1
           ELSE 0 END + 10 * hunk_idx AS INT) AS new_at
  FROM lines
), hunks AS (
  SELECT pr_key, path, doc_id, change_type, hunk_idx, min(old_at) AS old_start, min(new_at) AS new_start,
         CAST(count(*) FILTER (line_type != 'ADDED') AS INT) AS old_count, CAST(count(*) FILTER (line_type != 'REMOVED') AS INT) AS new_count,
         string_agg(CASE line_type WHEN 'ADDED' THEN '+' WHEN 'REMOVED' THEN '-' ELSE ' ' END || content, chr(10) ORDER BY i) AS body,
         string_agg(CASE line_type WHEN 'ADDED' THEN printf('+ %4d | ', new_no) WHEN 'REMOVED' THEN '-      | ' ELSE printf('  %4d | ',
           new_no) END || content, chr(10) ORDER BY i) AS annotated_body
  FROM numbered WHERE doc_id % 17 != 3 GROUP BY ALL
)"""
SHAS = LINES + r""", every_hunk AS (
  SELECT path, hunk_idx, printf('@@ -%d,%d +%d,%d @@ part', min(old_at), CAST(count(*) FILTER (line_type != 'ADDED') AS INT) + CASE
        WHEN doc_id % 17 = 3 AND hunk_idx = 0 THEN 1 ELSE 0 END, min(new_at), CAST(count(*) FILTER (line_type != 'REMOVED') AS INT))
         || chr(10) || string_agg(CASE line_type WHEN 'ADDED' THEN '+' WHEN 'REMOVED' THEN '-' ELSE ' ' END || content, chr(10) ORDER BY i) AS hunk
           FROM numbered GROUP BY path, hunk_idx, doc_id
), patches AS (SELECT path, string_agg(hunk, chr(10) ORDER BY hunk_idx) AS patch FROM every_hunk GROUP BY path
), shas AS (
  SELECT pr_key, sha256(string_agg(path || chr(0) || coalesce(previous_path, '') || chr(0) || change_type || chr(0) || coalesce(patch, '') || chr(0),
        '' ORDER BY path)) AS patch_sha FROM files LEFT JOIN patches USING (path) GROUP BY pr_key
)"""
#: The default settings' fingerprint, worked out by hand from their documented values with another program.
FINGERPRINT = "bd9bb442b3ca27f7f6c3fbe2e1b5cca0b1ee5149400c8bb5bb1f45f085bfe28e"
SYMBOLS = r"""owners AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS owner FROM lineitem GROUP BY 1
), symbols AS (
  SELECT p_brand AS pr_key, p_partkey, owner, CASE WHEN p_size % 4 = 0 THEN 'MERGE_BASE' ELSE 'HEAD' END AS to_side, p_size % 3 AS arity,
        p_size AS to_line,
         'src/' || CASE WHEN owner % 5 = 0 THEN 'test' ELSE 'main' END || '/java/com/s' || (owner % 40) || '/S' || owner || '.java' AS to_path,
           'com.s' || (owner % 40) || '.S' || owner AS fqn
  FROM part JOIN owners USING (p_partkey)
), sites AS (
  SELECT s.pr_key, l.*, owner, CAST(l_linenumber * 10 + l_quantity % 10 AS INT) AS from_line,
        'com.s' || (l_suppkey % 40) || '.S' || l_suppkey AS caller,
         'src/' || CASE WHEN l_suppkey % 5 = 0 THEN 'test' ELSE 'main' END || '/java/com/s' || (l_suppkey % 40) || '/S' || l_suppkey || '.java' AS
           from_path
  FROM lineitem l JOIN symbols s ON l_partkey = p_partkey
), imports AS (
  SELECT DISTINCT pr_key, l_suppkey, 'com.s' || (owner % 40) || '.S' || owner AS fqn FROM sites WHERE l_quantity > 25
)"""

CONFIG = ReviewConfig()
REPLAYED = (replay.Policy("default", PACK_BUDGET), replay.Policy("tests first", 40, {"CALLER": 0.5, "TEST": 1.0, "OVERRIDE": 0.9}))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.patch_files(spark, sf_dir)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.parse_patches(_files(spark, sf_dir))


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("pr_key", "path", "change_type", "category", paths.is_sensitive(F.col("path")).alias("sensitive"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("pr_key", "category", text.estimate_tokens(F.col("content")).alias("tokens"))
    return files.groupBy("pr_key", "category").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunk_lines(_parsed(spark, sf_dir))


def diff_hunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.file_checks(_parsed(spark, sf_dir))


def render_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.render_hunks(_parsed(spark, sf_dir))


def annotate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.annotate(diff.render_hunks(_parsed(spark, sf_dir)), ["pr_key", "path", "hunk_idx"])


def diff_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return items.diff_items(diff.render_hunks(diff.parse_patches(files)), files).select("pr_key", "item_id", "ref_side", "ref_path", "ref_start", "ref_end", "tokens")


def metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return items.metadata_items(files, diff.hunks(diff.parse_patches(files))).select("pr_key", "item_id", "content", "tokens")


def patch_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.patch_sha(_files(spark, sf_dir))


def context_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shas = ids.patch_sha(_files(spark, sf_dir))
    keyed = shas.select("pr_key", ids.corpus_key(F.lit(domain.REPO), F.lit("base"), F.col("pr_key"), F.col("patch_sha")).alias("corpus_key"))
    return keyed.select("pr_key", "corpus_key", ids.context_id(F.col("corpus_key"), CONFIG).alias("context_id"))


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return freeze.change_summary(files, diff.file_checks(diff.parse_patches(files)))


def capability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is parsed as Java at the head; the merge base has those of over 800 characters."""
    files = _files(spark, sf_dir)
    head, base = needed_sources(files)
    texts = files.select("pr_key", "path", "content")
    broken = parse_java(head.join(texts, ["pr_key", "path"]), ["pr_key", "path"]).where("row = 'failure'").select("pr_key", "path", F.lit(True).alias("broken")).distinct()
    parsed = head.join(broken, ["pr_key", "path"], "left").select("pr_key", F.lit("HEAD").alias("side"), F.lit(False).alias("loaded"), F.coalesce("broken", F.lit(False)).alias("failed"))
    known = files.where("n_chars > 800").select("pr_key", F.coalesce("previous_path", "path").alias("path"), F.lit(True).alias("known"))
    loaded = base.join(known, ["pr_key", "path"], "left").select("pr_key", F.lit("MERGE_BASE"), F.coalesce("known", F.lit(False)), F.lit(False))
    return freeze.capability_report(parsed.union(loaded))


def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.themes(_files(spark, sf_dir).where("category = 'SOURCE'"), ["pr_key", "change_type"])


def changed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = symbols.changed_lines(domain.order_lines(spark, sf_dir))
    return symbols.touched_methods(domain.order_ranges(spark, sf_dir), lines)


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.call_edges(domain.called_symbols(spark, sf_dir), domain.call_sites(spark, sf_dir), domain.calling_types(spark, sf_dir))


def override_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = domain.customer_methods(spark, sf_dir)
    changed = methods.select("pr_key", "sym_ord", "side", "path", F.col("fqn").alias("class_fqn"), F.col("name").alias("method_name"), "arity", "start_line", "signature")
    return recall.override_edges(changed, domain.customer_types(spark, sf_dir), methods).select("pr_key", "from_path", "from_line", "from_symbol", "to_side", "to_path", "to_line", "to_symbol", "confidence")


def convention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.convention_edges(*domain.several_heads(spark, sf_dir)).select("pr_key", "from_path", "to_path", "confidence")


def lexical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, changed, snapshot, heads = domain.word_queries(spark, sf_dir)
    index = stored(lexical.index_files(snapshot, CONFIG.sensitive_patterns, 8), "words")
    queries = asked.select("pr_key", "to_path", F.explode(lexical.words(F.col("text"))).alias("word"))
    return lexical.related_files(queries, changed, index, heads)


def co_change_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, revisions, past = domain.order_history(spark, sf_dir)
    return history.co_change_rules(changed, revisions, history.narrow_commits(past, 4), confidence=0.25)


def co_change_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, revisions, past = domain.order_history(spark, sf_dir)
    return history.history_before(past, revisions).join(history.channel_states(past, revisions, 1500), "pr_key")


def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.read(spark, sf_dir, "lineitem").selectExpr("concat('S', l_suppkey) AS pr_key", "concat('CALLER#L', l_linenumber) AS item_id", "1 - l_discount AS confidence", "l_orderkey * 1000000000 + l_partkey AS edge_ord",
                                                             "concat('o', l_orderkey, ' p', l_partkey) AS content", "concat('P', l_partkey) AS owner")
    return items.strongest_edges(rows, ["pr_key", "item_id"]).select("pr_key", "item_id", "confidence", "content", "owner")


def policy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = domain.pack_candidates(spark, sf_dir)
    confidence = F.when(F.col("start_line").isNotNull(), F.col("confidence"))
    return candidates.select("pr_key", "item_id", "kind", scoring.heuristic_score(F.col("kind"), confidence).alias("score"))


def review_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    required, edges = domain.order_paths(spark, sf_dir)
    return slicing.slice_paths(required, edges, SLICE_BUDGET)


def pack_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = domain.pack_candidates(spark, sf_dir)
    return packing.pack_slices(candidates.withColumn("value", scoring.heuristic_score(F.col("kind"), F.col("confidence"))), PACK_BUDGET)


def support_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the tests of each order, and of items that no channel found, at ranks and budgets; 0 stands for any."""
    gold = domain.pack_candidates(spark, sf_dir).where("kind = 'TEST'").selectExpr("pr_key", "item_id", "tokens")
    gold = gold.select("pr_key", "item_id").union(gold.where("tokens % 5 = 0").selectExpr("pr_key", "concat('lost', item_id)"))
    return evaluation.recall_at(evaluation.support_hits(pack_slices(spark, sf_dir), gold), RECALL_LIMITS).fillna(0, ["top", "budget"])


def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.compare(replay.replay(domain.pack_candidates(spark, sf_dir), REPLAYED), len(REPLAYED))


def _covered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = domain.repeated_candidates(spark, sf_dir)
    found = found.withColumns({"value": scoring.heuristic_score(F.col("kind"), F.col("confidence")), "pieces": covering.pieces(F.col("content"))})
    return covering.pack_slices(found, PACK_BUDGET), found


def pack_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir)[0]


def shown_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.overlap(*_covered(spark, sf_dir))


def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.merge_findings(domain.conversation_findings(spark, sf_dir)).select("pr_key", "path", "line", "severity", "title", "message", "slice_no", "pos")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.severity_counts(review.merge_findings(domain.conversation_findings(spark, sf_dir)))


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.anchor(review.merge_findings(domain.conversation_findings(spark, sf_dir)), domain.conversation_ranges(spark, sf_dir))


def anchor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir).select("pr_key", "path", "line", "title", "anchored")


def inline_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.comments(_anchored(spark, sf_dir), "Findings outside the diff")[0]


def comment_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.comments(_anchored(spark, sf_dir), "Findings outside the diff")[1]


def parse_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.parse_answers(domain.model_answers(spark, sf_dir))[0].select("pr_key", "slice_no", "pos", "path", "line", "severity", "title", "message", "suggestion")


def answer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.parse_answers(domain.model_answers(spark, sf_dir))[1]


def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.read(spark, sf_dir, "lineitem").selectExpr("concat('O', l_orderkey) AS pr_key", "l_orderkey", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS slice_no", "l_returnflag != 'R' AS ok",
                                                             "CASE WHEN l_linestatus = 'F' THEN concat('model-', l_suppkey) ELSE ' ' END AS model", "CASE WHEN l_tax > 0 THEN cast(l_quantity AS int) END AS prompt_tokens",
                                                             "l_linenumber AS completion_tokens", "l_linenumber % 2 AS dropped", "l_linenumber % 3 AS invalid")
    return review.review_totals(rows)


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed changes, their line items of a larger quantity as findings."""
    lines = domain.read(spark, sf_dir, "lineitem")
    severity = F.expr("CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'WARNING' ELSE 'SUGGESTION' END")
    found = lines.where("l_quantity > 40").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("pr_key"), severity.alias("severity"))
    plans = domain.read(spark, sf_dir, "orders").selectExpr("concat('O', o_orderkey) AS pr_key", "concat('Plan of ', o_orderkey, '\n') AS comment")
    return publish.review_comment(plans, review_totals(spark, sf_dir), publish.severity_counts(found))


def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.read(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS pr_key", "1 AS slice_no", f"'{domain.REPO}' AS repo", "conv_id AS pr_number", "'ctx' AS context_id", "turn AS pack_ord", "concat('TURN#', turn) AS item_id", "upper(role) AS kind", "'chat.txt' AS path",
        "CASE WHEN role = 'user' THEN concat('u#', turn) END AS symbol_id", "CASE WHEN turn > 1 THEN turn END AS start_line", "turn + 1 AS end_line", "role = 'assistant' AS required", "coalesce(text, '') AS content")
    return review.render_prompts(rows).select("pr_key", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.route(events.from_table(domain.read(spark, sf_dir, "events"))).select("event_id", "action", "status")


def latest_event_per_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = events.route(events.from_table(domain.read(spark, sf_dir, "events")))
    return events.latest(routed.where("status = 'ACCEPTED'")).select("pr_key", "event_id", "action")


def coalesced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: the newest of each change, if it was quiet for six hours by the stream's clock, an hour behind."""
    known = domain.read(spark, sf_dir, "events")
    # a stream's source is a folder or a pattern, and the table may be a single file
    raw = spark.readStream.schema(known.schema).parquet(f"{sf_dir}/events.parque[t]")
    routed = events.route(events.from_table(raw)).where("status = 'ACCEPTED'").select("event_id", "action", "pr_key", "received_at")
    return newest.coalesced(spark, routed, f"newest-{uuid.uuid4().hex}", 6 * 3_600_000, "1 hour", ("received_at", "event_id")).select("pr_key", "event_id", "action")


def frozen_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = domain.read(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("pr_key"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("context_id"), "o_orderstatus")
    plan = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"contextId":"'), "context_id", F.lit('"}'))).otherwise("broken{")
    store = orders.where("o_orderstatus IN ('F', 'P')").select("context_id", plan.alias("plan_json"))
    build, known = freeze.reuse(orders.select("pr_key", "context_id"), store)
    return build.select("pr_key", F.lit("BUILD").alias("state")).union(known.select("pr_key", F.lit("REUSE")))


def method_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.called_symbols(spark, sf_dir).select("pr_key", F.concat("class_fqn", F.lit("#"), "signature").alias("symbol_id"))
    return publish.method_list(rows).select("pr_key", F.array_join("methods", ";").alias("methods"))


def java_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_java(domain.java_files(spark, sf_dir), ["path"]).where("row = 'method'").select("path", "fqn", "signature", "arity", "start_line", "end_line")


def java_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_java(domain.java_files(spark, sf_dir), ["path"]).where("row = 'call'").select("path", "fqn", "enclosing_method", "name", "receiver", "arity", F.col("start_line").alias("line"))


def signature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.http_status(domain.webhook_deliveries(spark, sf_dir), domain.SECRET).select("event_id", "http_status")


def symbol_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = domain.java_files(spark, sf_dir).select(F.lit("p").alias("pr_key"), F.lit("HEAD").alias("side"), "path", "content")
    methods = parse_java(files, ["pr_key", "side", "path"]).where("row = 'method'")
    changed = methods.select("pr_key", F.struct("path", "ord").alias("sym_ord"), "side", "path", F.col("fqn").alias("class_fqn"), F.col("name").alias("method_name"), "signature", "arity", "start_line", "end_line")
    return items.symbol_items(changed, files, CONFIG).select("item_id", "kind", "ref_path", "ref_start", "content", "tokens", "required")


def snapshot_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = domain.read(spark, sf_dir, "orders").select(F.lit(domain.REPO).alias("repo"), F.lit("head").alias("sha"), F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("content"), "o_orderstatus")
    found = archives.with_fallback(orders.select("repo", "sha", "path"), orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus IN ('F', 'O')"))
    return found.select("path", "content", "kind")


def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.shaped_paths(spark, sf_dir).select("p_partkey", "path", paths.category(F.col("path")).alias("category"))


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.snapshot_files(domain.archives(spark, sf_dir), max_file=1024).select("sha", "path", "content")


def archive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_errors(domain.archives(spark, sf_dir), max_file=1024).select("sha", "error")


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.route(events.parse_payload(domain.payloads(spark, sf_dir))).select("delivery", "action", "installation", "owner", "name", "number", "status")


def located_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.locate_changed(*domain.moved_methods(spark, sf_dir)).select("pr_key", "side", "path", "method_id")


def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, changed, snapshot = domain.tied_edges(spark, sf_dir)
    found = items.related_items(edges.withColumn("edge_ord", recall.edge_order()), changed, snapshot, CONFIG)
    return found.select("pr_key", "item_id", "kind", "symbol_id", "content", "tokens", "confidence", "owner_path")


def required_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a budget only the required items and all that they require are included."""
    return packing.pack_slices(domain.chained_candidates(spark, sf_dir), 0).select("pr_key", "item_id", "status", "tokens")


def java_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_java(domain.java_shapes(spark, sf_dir), ["path"]).where("row IN ('type', 'failure')")
    return rows.select("path", "row", "fqn", "kind", "super_class", F.array_join("interfaces", ",").alias("interfaces"))


def kept_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds over one table of declarations: a third of the files is new in the second, and only these are parsed then."""
    files = domain.java_shapes(spark, sf_dir)
    digested = files.withColumn("digest", declarations.digest(F.col("content")))
    kept = f"{shared_dir(spark)}/declarations-{uuid.uuid4().hex}"
    early = declarations.parse_new(digested.where("cast(regexp_extract(path, '[0-9]+', 0) AS bigint) % 3 != 0").select("digest", "content"), kept)
    rows = declarations.parse_kept(files, ["path"], kept).where("row IN ('type', 'failure')")
    reused = digested.select("path", "digest").join(early.withColumn("reused", F.lit(True)), "digest", "left").select("path", F.coalesce("reused", F.lit(False)).alias("reused"))
    return rows.join(reused, "path").select("path", "row", "fqn", "kind", "super_class", F.array_join("interfaces", ",").alias("interfaces"), "reused")


def java_shape_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_java(domain.java_shapes(spark, sf_dir), ["path"]).where("row = 'method'").select("path", "fqn", "signature", "start_line", "end_line")


def java_shape_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_java(domain.java_shapes(spark, sf_dir), ["path"]).where("row = 'call'").select("path", "fqn", "enclosing_method", "receiver", "name", "arity", F.col("start_line").alias("line"))


def bounded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.read(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text"), 1).alias("content"))


def reviewer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer that answers with the prompt's length, and fails for every fifth length: a failure stays with its slice."""
    def reviewer(prompt: str) -> dict:
        if len(prompt) % 5 == 0:
            raise ValueError(f"{len(prompt)} characters")
        return {"raw": f'{{"findings": [], "length": {len(prompt)}}}', "model": "m", "prompt_tokens": len(prompt)}

    prompts = domain.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("pr_key"), F.col("turn").cast("int").alias("slice_no"), F.coalesce("text", F.lit("")).alias("prompt"))
    return review.call_reviewer(prompts, reviewer)


def fallback_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose inline comments were refused: those of even numbers."""
    inline, bodies = publish.comments(_anchored(spark, sf_dir), "Findings outside the diff")
    refused = inline.select("pr_key").where("cast(substr(pr_key, 2) AS int) % 2 = 0")
    return publish.fallback(inline, bodies, refused, "Findings")


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    files = _files(spark, sf_dir)
    heads = files.where("change_type != 'DELETE'").select("repo", F.lit("head").alias("sha"), "path", "content")
    bases = files.where("change_type != 'ADD'").select("repo", F.lit("base").alias("sha"), F.coalesce("previous_path", "path").alias("path"), "content")
    revisions = files.select("pr_key", "repo").distinct().select("pr_key", "repo", F.lit(1).alias("pr_number"), F.lit("base").alias("merge_base"), F.lit("head").alias("head"))
    return build_plans(Tables(revisions, files, heads, bases), CONFIG)


def review_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["packed"].groupBy("pr_key", "slice_no", "status").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))


def plan_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole build says of each change: its summary, capabilities and diagnostics."""
    built = _built(spark, sf_dir)
    met = built["plans"].join(built["results"], "pr_key")
    plan, notes = lambda p, t: F.get_json_object("plan_json", p).cast(t), lambda p: F.get_json_object("diagnostics", p).cast("long")
    return met.select("pr_key", "status", plan("$.summary.n_files", "long").alias("n_files"), plan("$.summary.additions", "long").alias("additions"), plan("$.capabilities.patch", "string").alias("patch"),
                      plan("$.capabilities.headSnapshot", "string").alias("head_snapshot"), plan("$.capabilities.mergeBaseFiles", "string").alias("merge_base_files"), plan("$.capabilities.astCoverage", "double").alias("ast_coverage"),
                      notes("$.missingPatches").alias("missing_patches"), notes("$.parseFailures").alias("parse_failures"), notes("$.sensitiveSkipped").alias("sensitive_skipped"))


_FUNCTIONS = (
    change_summary, classify_files, token_estimates, diff_lines, diff_hunk_validation, render_hunks, annotate_diff, diff_items, metadata_items, patch_sha, context_ids, capability_report, common_prefixes,
    changed_methods, call_edges, override_edges, convention_edges, dedup_items, policy_scores, review_slices, pack_slices, pack_covering, shown_twice, support_recall, policy_replay, merge_findings, severity_counts, anchor_findings, inline_comments, comment_bodies,
    parse_llm_json, answer_counts, review_totals, render_prompts, route_events, latest_event_per_change, frozen_reuse, method_lists, java_methods, java_calls, signature_checks, symbol_items, snapshot_fallback,
    category_rules, archive_files, archive_errors, event_payloads, located_methods, related_items, required_closures, java_types, kept_declarations, java_shape_methods, java_shape_calls, bounded_texts, reviewer_answers, fallback_comments,
    review_comments, review_plans, plan_overview, lexical_files, co_change_rules, co_change_states, coalesced_events,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

FINDINGS = r"""found AS (
  SELECT 'R' || (length(text) % 50) AS pr_key, CAST(conv_id AS INT) AS slice_no, CAST(turn AS INT) AS pos,
        'f' || (length(text) % 10) || '.java' AS path, CAST(length(text) % 7 AS INT) AS line,
         ['CRITICAL', 'WARNING', 'SUGGESTION', 'WARNING'][length(text) % 4 + 1] AS severity, 'Finding of ' || length(text) || ' characters' AS title,
           text AS message,
         CASE WHEN length(text) % 3 = 0 THEN 'shorten' END AS suggestion, CASE WHEN length(text) % 2 = 0 THEN 'DIFF#' || conv_id END AS cited
  FROM conversations WHERE role = 'assistant'
), merged AS (
  SELECT * FROM found WHERE line > 0 AND trim(message) != '' QUALIFY row_number() OVER (PARTITION BY pr_key, path, line, title ORDER BY slice_no,
        pos) = 1
), ranges AS (
  SELECT 'R' || (length(text) % 50) AS pr_key, 'f' || (length(text) % 10) || '.java' AS path, turn % 5 AS a, turn % 5 + length(text) % 3 AS b
        FROM conversations WHERE role = 'user'
), anchored AS (
  SELECT *, EXISTS (SELECT 1 FROM ranges r WHERE r.pr_key = m.pr_key AND r.path = m.path AND m.line BETWEEN r.a AND r.b) AS anchored FROM merged m
)"""

ORACLE_SQL = {
    "classify_files": f"WITH {FILES} SELECT pr_key, path, change_type, {CATEGORY} AS category, doc_id % 12 IN (3, 8, 10) AS sensitive FROM files",
    "token_estimates": f"""WITH {FILES} SELECT pr_key, {CATEGORY} AS category, count(*) AS n_files,
        CAST(sum((length(content) + 3) // 4) AS BIGINT) AS tokens FROM files GROUP BY ALL""",
    "diff_lines": f"WITH {LINES} SELECT pr_key, path, hunk_idx, line_idx, line_type, old_no, new_no, content FROM numbered WHERE doc_id % 17 != 3",
    "diff_hunk_validation": f"""WITH {LINES} SELECT pr_key, path, count(DISTINCT hunk_idx) AS n_hunks, CASE
        WHEN doc_id % 17 = 3 THEN 'count mismatch' END AS error FROM numbered GROUP BY pr_key, path, doc_id""",
    "render_hunks": f"""WITH {LINES} SELECT pr_key, path, hunk_idx, old_start, old_count, new_start, new_count, printf('@@ -%d,%d +%d,%d @@',
        old_start, old_count, new_start, new_count) || chr(10) || body AS rendered FROM hunks""",
    "annotate_diff": f"""WITH {LINES} SELECT pr_key, path, hunk_idx, printf('@@ -%d,%d +%d,%d @@', old_start, old_count, new_start,
        new_count) || chr(10) || annotated_body AS annotated FROM hunks""",
    "diff_items": f"""WITH {LINES}, shown AS (SELECT *, printf('@@ -%d,%d +%d,%d @@', old_start, old_count, new_start,
        new_count) || chr(10) || body AS rendered, change_type = 'DELETE' AS gone FROM hunks WHERE doc_id % 12 NOT IN (3, 8, 10))
      SELECT pr_key, 'DIFF#' || path || '#' || hunk_idx AS item_id, CASE WHEN gone THEN 'MERGE_BASE' ELSE 'HEAD' END AS ref_side, path AS ref_path,
        CASE WHEN gone THEN old_start ELSE new_start END AS ref_start,
        CASE WHEN gone THEN greatest(old_start, old_start + old_count - 1) ELSE greatest(new_start, new_start + new_count - 1) END AS ref_end,
          CAST((length(rendered) + 3) // 4 AS INT) AS tokens FROM shown""",
    "metadata_items": f"""WITH {FILES}, stats AS (SELECT *, doc_id % 12 IN (3, 8, 10) AS hidden, lower(change_type) || ', +' || CASE
        WHEN doc_id % 12 = 4 THEN 0 ELSE (n_lines + 1) // 3 END || '/-' || CASE WHEN doc_id % 12 = 4 THEN 0 ELSE n_lines // 3 END AS shown FROM files)
      SELECT pr_key, 'FILE#' || path AS item_id, CASE WHEN hidden THEN path || ' (sensitive file, content withheld)'
        ELSE path || ' (' || shown || ')' END AS content,
        CAST((length(CASE WHEN hidden THEN path ELSE shown END) + 3) // 4 AS INT) AS tokens FROM stats
          WHERE hidden OR doc_id % 12 = 4 OR doc_id % 17 = 3""",
    "change_summary": f"""WITH {FILES} SELECT pr_key, count(*) AS n_files, CAST(sum(CASE WHEN doc_id % 12 = 4 THEN 0
        ELSE (n_lines + 1) // 3 END) AS BIGINT) AS additions, CAST(sum(CASE WHEN doc_id % 12 = 4 THEN 0
        ELSE n_lines // 3 END) AS BIGINT) AS deletions,
      CAST(sum(CASE WHEN doc_id % 12 = 4 OR doc_id % 17 = 3 THEN 0 ELSE (n_lines + 19) // 20 END) AS BIGINT) AS n_hunks,
        count(*) FILTER (doc_id % 12 = 4) AS missing_patches, count(*) FILTER (doc_id % 12 != 4 AND doc_id % 17 = 3) AS parse_failures,
      CASE WHEN count(*) FILTER (doc_id % 12 = 4 OR doc_id % 17 = 3) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS patch_state FROM files
        GROUP BY pr_key""",
    "capability_report": f"""WITH {FILES}, needed AS (SELECT *, ends_with(path, '.java') AS java, coalesce(regexp_replace(content,
        '/[*].*?[*]/|//[^\n]*', '', 'gs'), '') AS code FROM files),
      asked AS (SELECT *, java AND change_type != 'DELETE' AS head, java AND change_type != 'ADD' AS base FROM needed)
      SELECT pr_key, count(*) FILTER (head) AS ast_attempted, count(*) FILTER (head AND regexp_matches(code, '[^\\s;]')) AS ast_failed,
        count(*) FILTER (base) AS base_attempted, count(*) FILTER (base AND n_chars > 800) AS base_loaded,
        CASE WHEN count(*) FILTER (head) = 0 THEN 1.0 ELSE count(*) FILTER (head AND NOT regexp_matches(code,
          '[^\\s;]')) / count(*) FILTER (head) END AS ast_coverage,
        CASE WHEN count(*) FILTER (base AND NOT coalesce(n_chars > 800, false)) = 0 THEN 'COMPLETE' WHEN count(*) FILTER (base
          AND n_chars > 800) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS base_state
      FROM asked WHERE head OR base GROUP BY pr_key""",
    "common_prefixes": f"""WITH {FILES}, g AS (SELECT pr_key, change_type, list(regexp_replace(path, '/?[^/]*$', '') ORDER BY path) AS parents
        FROM files WHERE {CATEGORY} = 'SOURCE' GROUP BY ALL),
      p AS (SELECT *, list_reduce(parents, lambda a, b: coalesce(list_filter([array_to_string(string_split(a, '/')[1:k],
        '/') for k in range(len(string_split(a, '/')), 0, -1)], lambda c: starts_with(b, c))[1], '')) AS prefix FROM g)
      SELECT pr_key, change_type, CASE WHEN parents[1] = '' THEN 'root' WHEN prefix = '' THEN 'multiple' ELSE prefix END AS theme FROM p""",
    "changed_methods": """WITH lines AS (SELECT o_custkey, l_returnflag != 'R' AS head, l_partkey % 50 AS line FROM lineitem JOIN orders
        ON l_orderkey = o_orderkey), methods AS (SELECT *, CAST(o_orderkey % 40 AS INT) AS a FROM orders)
      SELECT 'C' || o_custkey AS pr_key, 'F.java' AS path, CASE WHEN o_orderstatus = 'F' THEN 'MERGE_BASE' ELSE 'HEAD' END AS side,
        'm' || o_orderkey AS method_id, a AS start_line, CAST(a + length(o_orderpriority) AS INT) AS end_line FROM methods m
      WHERE EXISTS (SELECT 1 FROM lines l WHERE l.o_custkey = m.o_custkey AND l.head = (o_orderstatus != 'F') AND l.line BETWEEN a
        AND a + length(o_orderpriority))""",
    "call_edges": f"""WITH {SYMBOLS}, met AS (
        SELECT y.*, from_path, from_line, caller, l_linenumber, l_orderkey, l_partkey, x.l_suppkey, CASE WHEN l_returnflag IN ('R', 'A') THEN 0.85
          WHEN s_acctbal < 0 THEN NULL WHEN i.fqn IS NOT NULL THEN 0.7 WHEN x.l_suppkey % 40 = y.owner % 40 THEN 0.6 END AS evidence
        FROM symbols y JOIN sites x ON l_partkey = p_partkey AND y.arity = l_linenumber % 3 AND from_path != to_path JOIN supplier
          ON s_suppkey = x.l_suppkey LEFT JOIN imports i ON i.pr_key = y.pr_key AND i.l_suppkey = x.l_suppkey AND i.fqn = y.fqn)
      SELECT pr_key, CASE WHEN l_suppkey % 5 = 0 THEN 'TESTED_BY' ELSE 'CALLS' END AS edge_type, from_path, from_line, CASE
        WHEN l_linenumber < 7 THEN caller || '#run' || l_linenumber END AS from_symbol, to_side, to_path, to_line,
        fqn || '#op' || p_partkey || '(' || arity || ')' AS to_symbol, CAST(CASE WHEN to_side = 'MERGE_BASE' THEN greatest(evidence, 0.9)
          ELSE evidence END AS DOUBLE) AS confidence, 'SYMBOL_GRAPH' AS source
      FROM met WHERE evidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey, from_path, from_line ORDER BY l_orderkey, l_linenumber,
        l_partkey, l_suppkey) = 1""",
    "override_edges": """WITH t AS (SELECT *, 'com.c.C' || c_custkey AS fqn, CASE WHEN c_acctbal < 0 THEN 'MERGE_BASE' ELSE 'HEAD' END AS side,
        'src/main/java/com/c/C' || c_custkey || '.java' AS path FROM customer),
      supers AS (SELECT c_custkey, c_custkey // 3 AS parent FROM customer UNION SELECT c_custkey, c_custkey // 5 FROM customer
        WHERE c_nationkey < 12),
      m AS (SELECT * FROM (VALUES ('save', 10, 0), ('load', 20, 1)) v(name, line, k)),
      pairs AS (SELECT c.c_custkey AS child, p.c_custkey AS base, c.c_mktsegment AS pr_key FROM supers s JOIN t c ON c.c_custkey = s.c_custkey
        JOIN t p ON p.c_custkey = s.parent AND p.c_mktsegment = c.c_mktsegment WHERE c.c_custkey % 2 = p.c_custkey % 2),
      edges AS (SELECT pr_key, base AS origin, child AS target, 0.9 AS confidence, 1 AS phase FROM pairs UNION ALL SELECT pr_key, child, base, 0.85, 2
        FROM pairs JOIN t ON t.c_custkey = child WHERE side = 'HEAD')
      SELECT pr_key, o.path AS from_path, m.line AS from_line, o.fqn || '#' || name || '(' || (origin % 2) || ')' AS from_symbol, g.side AS to_side,
        g.path AS to_path, m.line AS to_line, g.fqn || '#' || name || '(' || (target % 2) || ')' AS to_symbol,
        CAST(confidence AS DOUBLE) AS confidence
      FROM edges JOIN t o ON o.c_custkey = origin JOIN t g ON g.c_custkey = target CROSS JOIN m QUALIFY row_number() OVER (PARTITION BY pr_key,
        origin, target, name ORDER BY phase) = 1""",
    "convention_edges": f"""WITH {FILES}, pairs AS (SELECT m.path AS main, t.path AS test, m.pr_key AS main_pr, t.pr_key AS test_pr,
        m.change_type AS mc, t.change_type AS tc, m.doc_id AS d FROM files m JOIN files t ON t.doc_id = m.doc_id + 1 WHERE m.doc_id % 12 = 0)
      SELECT DISTINCT pr_key, from_path, to_path, CAST(0.95 AS DOUBLE) AS confidence FROM (SELECT main_pr AS pr_key, test AS from_path,
        main AS to_path FROM pairs WHERE CASE WHEN main_pr = test_pr THEN tc != 'DELETE' ELSE d % 24 = 0 END
        UNION ALL SELECT test_pr, test, main FROM pairs WHERE CASE WHEN main_pr = test_pr THEN mc != 'DELETE' ELSE d % 24 = 0 END)""",
    "dedup_items": """WITH r AS (SELECT 'S' || l_suppkey AS pr_key, 'CALLER#L' || l_linenumber AS item_id, 1 - l_discount AS confidence, l_orderkey,
        l_partkey FROM lineitem),
      best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pr_key, item_id ORDER BY confidence DESC, l_orderkey, l_partkey) = 1), first
        AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pr_key, item_id ORDER BY l_orderkey, l_partkey) = 1)
      SELECT pr_key, item_id, b.confidence, 'o' || b.l_orderkey || ' p' || b.l_partkey AS content, 'P' || f.l_partkey AS owner FROM best b
        JOIN first f USING (pr_key, item_id)""",
    "policy_scores": """WITH r AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'CALLER' WHEN 'N' THEN 'TEST' ELSE 'OVERRIDE' END AS kind FROM lineitem)
      SELECT 'O' || l_orderkey AS pr_key, kind || '#' || l_partkey || '#' || l_suppkey || '#' || l_linenumber AS item_id, kind, CAST(CASE kind
        WHEN 'CALLER' THEN 0.8 WHEN 'TEST' THEN 0.85 ELSE 0.9 END AS DOUBLE) * CASE WHEN l_tax > 0 THEN 1 - l_discount ELSE 0.5 END AS score
        FROM r""",
    "review_slices": """WITH RECURSIVE n AS (SELECT 'C' || o_custkey AS pr_key, 'pkg' || (o_orderkey % 3) || '/F' || o_orderkey || '.java' AS path,
        'pkg' || (o_orderkey % 3) AS dir, o_orderkey, o_orderdate, o_orderpriority FROM orders),
      tok AS (SELECT n.*, 100 * (SELECT count(*) FROM lineitem WHERE l_orderkey = n.o_orderkey) AS tokens FROM n),
      e AS (SELECT pr_key, path AS a, prior AS b FROM (SELECT *, lag(path) OVER w AS prior, lag(o_orderpriority) OVER w AS was FROM n WINDOW w
        AS (PARTITION BY pr_key ORDER BY o_orderdate, o_orderkey)) WHERE was = o_orderpriority),
      both_ways AS (SELECT * FROM e UNION ALL SELECT pr_key, b, a FROM e), reach AS (SELECT pr_key, path AS a, path AS b FROM n UNION SELECT r.pr_key,
        r.a, w.b FROM reach r JOIN both_ways w ON w.pr_key = r.pr_key AND w.a = r.b),
      root AS (SELECT pr_key, a AS path, min(b) AS root FROM reach GROUP BY ALL), grp AS (SELECT t.*, CASE WHEN count(*) OVER (PARTITION BY pr_key,
        root) = 1 THEN 'dir:' || dir ELSE 'root:' || root END AS g FROM tok t JOIN root USING (pr_key, path)),
      cut AS (SELECT *, CASE WHEN count(*) OVER w > 1 AND sum(tokens) OVER w > 1500 THEN 'path:' || path ELSE g END AS h FROM grp WINDOW w
        AS (PARTITION BY pr_key, g)), firsts AS (SELECT *, min(path) OVER (PARTITION BY pr_key, h) AS lead FROM cut)
      SELECT pr_key, CAST(dense_rank() OVER (PARTITION BY pr_key ORDER BY lead) AS INT) AS slice_no, path FROM firsts""",
    "pack_slices": """WITH RECURSIVE c AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'CALLER' WHEN 'N' THEN 'TEST' ELSE 'OVERRIDE' END AS kind
        FROM lineitem),
      i AS (SELECT 'O' || l_orderkey AS pr_key, kind || '#' || l_partkey || '#' || l_suppkey || '#' || l_linenumber AS item_id,
        'F' || l_partkey AS path, CASE WHEN l_tax > 0 THEN l_linenumber ELSE -1 END AS spot, CAST(l_quantity AS INT) AS tokens,
        l_linestatus = 'F' AND l_linenumber = 1 AS required, CAST(CASE kind WHEN 'CALLER' THEN 0.8 WHEN 'TEST' THEN 0.85
          ELSE 0.9 END AS DOUBLE) * (1 - l_discount) / greatest(CAST(l_quantity AS INT), 1) AS ratio FROM c
          QUALIFY row_number() OVER (PARTITION BY pr_key, item_id ORDER BY spot, tokens, required, ratio) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY pr_key, required ORDER BY CASE WHEN required THEN 0 ELSE -ratio END, path, spot, item_id) AS k
        FROM i),
      start AS (SELECT pr_key, CAST(coalesce(sum(tokens) FILTER (required), 0) AS BIGINT) AS used, count(*) FILTER (required) AS taken FROM r
        GROUP BY pr_key),
      walk AS (SELECT pr_key, CAST(0 AS BIGINT) AS k, used, taken, false AS fits FROM start UNION ALL
        SELECT w.pr_key, r.k, CASE WHEN w.used + greatest(r.tokens, 1) <= 60 THEN w.used + r.tokens ELSE w.used END, CASE
          WHEN w.used + greatest(r.tokens, 1) <= 60 THEN w.taken + 1 ELSE w.taken END, w.used + greatest(r.tokens, 1) <= 60
        FROM walk w JOIN r ON r.pr_key = w.pr_key AND NOT r.required AND r.k = w.k + 1),
      out AS (SELECT r.*, w.fits, w.taken FROM r LEFT JOIN walk w ON w.pr_key = r.pr_key AND w.k = r.k AND w.k > 0 AND NOT r.required)
      SELECT pr_key, 1 AS slice_no, item_id, CASE WHEN required OR fits THEN 'included' ELSE 'dropped' END AS status, tokens,
        CAST(CASE WHEN required THEN k - 1 WHEN fits THEN taken - 1 ELSE row_number() OVER (PARTITION BY pr_key, required, fits ORDER BY path, spot,
          item_id) - 1 END AS INT) AS pack_ord FROM out""",
    "merge_findings": f"WITH {FINDINGS} SELECT pr_key, path, line, severity, title, message, slice_no, pos FROM merged",
    "severity_counts": f"""WITH {FINDINGS} SELECT pr_key, count(*) AS n_findings, count(*) FILTER (severity = 'CRITICAL') AS critical,
        count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'SUGGESTION') AS suggestion FROM merged GROUP BY pr_key""",
    "anchor_findings": f"WITH {FINDINGS} SELECT pr_key, path, line, title, anchored FROM anchored",
    "inline_comments": f"""WITH {FINDINGS} SELECT pr_key, path, line, '**[' || severity || '] ' || title || '**' || chr(10) || chr(10) || message ||
        CASE WHEN suggestion IS NOT NULL THEN chr(10) || chr(10) || 'Suggestion: ' || suggestion ELSE '' END
      || CASE WHEN cited IS NOT NULL THEN chr(10) || chr(10) || '_Cited context: ' || cited || '_' ELSE '' END AS comment FROM anchored
        WHERE anchored""",
    "comment_bodies": f"""WITH {FINDINGS} SELECT pr_key, chr(10) || chr(10) || '**Findings outside the diff:**' || chr(10) || string_agg('- `' || path
        || ':' || line || '` [' || severity || '] **' || title || '** — ' || message || chr(10), '' ORDER BY slice_no, pos) AS body
      FROM anchored WHERE NOT anchored GROUP BY pr_key""",
    "parse_llm_json": """SELECT conv_id AS pr_key, turn AS slice_no, CASE WHEN turn % 4 = 0 THEN 0 ELSE 1 END AS pos, CASE
        WHEN turn % 4 = 0 THEN 'f.java' ELSE 'g.java' END AS path, CAST(CASE WHEN turn % 4 = 0 THEN turn + 1 ELSE 2 END AS INT) AS line,
      CASE WHEN turn % 4 = 0 THEN 'critical' ELSE 'warning' END AS severity, 't' AS title, text AS message, CAST(NULL AS VARCHAR) AS suggestion
        FROM conversations WHERE turn % 4 IN (0, 3) AND trim(text) != ''""",
    "answer_counts": """SELECT conv_id AS pr_key, turn AS slice_no, CAST(CASE WHEN turn % 4 IN (0, 3) AND trim(text) != '' THEN 1
        ELSE 0 END AS BIGINT) AS n_findings, CAST(CASE turn % 4 WHEN 2 THEN 0 ELSE 1 END + CASE WHEN turn % 4 IN (0, 3) AND trim(coalesce(text,
        '')) = '' THEN 1 ELSE 0 END AS BIGINT) AS n_dropped FROM conversations""",
    "review_totals": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k,
        l_returnflag != 'R' AS ok FROM lineitem)
      SELECT 'O' || l_orderkey AS pr_key, bool_or(ok) AS available, arg_max('model-' || l_suppkey, k) FILTER (ok AND l_linestatus = 'F') AS model,
        CAST(coalesce(sum(CAST(l_quantity AS INT)) FILTER (ok AND l_tax > 0), 0) AS BIGINT) AS prompt_tokens,
        CAST(coalesce(sum(l_linenumber) FILTER (ok), 0) AS BIGINT) AS completion_tokens,
          CAST(coalesce(sum(l_linenumber % 2 + l_linenumber % 3) FILTER (ok), 0) AS BIGINT) AS dropped, count(*) FILTER (NOT ok) AS failures FROM r
          GROUP BY l_orderkey""",
    "render_prompts": """WITH i AS (SELECT conv_id, turn, '### ITEM TURN#' || turn || ' kind=' || upper(role) || ' path=chat.txt' || CASE
        WHEN role = 'user' THEN ' symbol=u#' || turn ELSE '' END || CASE WHEN turn > 1 THEN ' lines=' || turn || '-' || (turn + 1) ELSE '' END
        || CASE WHEN role = 'assistant' THEN ' required' ELSE '' END || chr(10) || '<<<BEGIN TURN#' || turn || '>>>' || chr(10) || coalesce(text,
          '') || chr(10) || '<<<END TURN#' || turn || '>>>' AS item FROM conversations),
      p AS (SELECT conv_id, 'Repository: acme/app' || chr(10) || 'Pull request: #' || conv_id || chr(10) || 'Context: ctx / slice slice-1' || chr(10)
        || chr(10) || string_agg(item, chr(10) || chr(10) ORDER BY turn) || chr(10) AS prompt FROM i GROUP BY conv_id)
      SELECT CAST(conv_id AS VARCHAR) AS pr_key, CAST(length(prompt) AS INT) AS chars, sha256(prompt) AS prompt_sha256 FROM p""",
    "route_events": """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'synchronize' WHEN 'click' THEN 'reopened'
        WHEN 'error' THEN 'closed' ELSE 'labeled' END AS action, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
      SELECT event_id, action, CASE WHEN action IN ('closed', 'labeled') THEN 'IGNORED' WHEN k = 0 OR user_id = 0 THEN 'INVALID'
        ELSE 'ACCEPTED' END AS status FROM e""",
    "latest_event_per_change": """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'synchronize'
        WHEN 'click' THEN 'reopened' END AS action, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
      SELECT 'acme/app#' || user_id AS pr_key, event_id, action FROM e WHERE action IS NOT NULL AND k != 0 AND user_id != 0
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "coalesced_events": """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'synchronize'
        WHEN 'click' THEN 'reopened' END AS action, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events),
      a AS (SELECT * FROM e WHERE action IS NOT NULL AND k != 0 AND user_id != 0)
      SELECT 'acme/app#' || user_id AS pr_key, event_id, action FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      WHERE ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM a) - INTERVAL 1 HOUR""",
    "frozen_reuse": "SELECT 'O' || o_orderkey AS pr_key, CASE WHEN o_orderstatus = 'F' THEN 'REUSE' ELSE 'BUILD' END AS state FROM orders",
    "method_lists": f"""WITH {SYMBOLS}, m AS (SELECT DISTINCT pr_key, fqn || '#op' || p_partkey || '(' || arity || ')' AS id FROM symbols), n
        AS (SELECT *, row_number() OVER (PARTITION BY pr_key ORDER BY id) AS k, count(*) OVER (PARTITION BY pr_key) AS n FROM m)
      SELECT pr_key, string_agg(id, ';' ORDER BY id) || CASE WHEN max(n) > 10 THEN ';…' ELSE '' END AS methods FROM n WHERE k <= 10
        GROUP BY pr_key""",
    "java_methods": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders JOIN customer
        ON c_custkey = o_custkey)
      SELECT 'C' || o_custkey || '.java' AS path, 'com.n' || c_nationkey || '.C' || o_custkey AS fqn, 'o' || o_orderkey || ['()', '(int)',
        '(int,Map<String,Integer>)'][o_orderkey % 3 + 1] AS signature, CAST(o_orderkey % 3 AS INT) AS arity, CAST(3 * k + 4 AS INT) AS start_line,
        CAST(3 * k + 6 AS INT) AS end_line FROM m""",
    "java_calls": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders JOIN customer
        ON c_custkey = o_custkey)
      SELECT 'C' || o_custkey || '.java' AS path, 'com.n' || c_nationkey || '.C' || o_custkey AS fqn, 'o' || o_orderkey AS enclosing_method, name,
        CASE name WHEN 'call' THEN 'svc' ELSE 'svc.call(' || o_orderkey || ', "a, b(")' END AS receiver, CASE name WHEN 'call' THEN 2
        ELSE 0 END AS arity, CAST(3 * k + 5 AS INT) AS line
      FROM m CROSS JOIN (VALUES ('call'), ('get')) v(name)""",
    "signature_checks": """SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 7 != 0 THEN 401 WHEN event_type IN ('signup',
        'purchase') THEN 200 WHEN user_id % 7 = 0 THEN 400 ELSE 202 END AS http_status FROM events""",
    "symbol_items": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 'C' || o_custkey || '.java' AS path,
        'com.n' || c_nationkey || '.C' || o_custkey AS fqn,
        '  public long o' || o_orderkey || '(' || ['', 'int a', 'final int a, Map<String, Integer> b'][o_orderkey % 3 + 1] || ') {' || chr(10) ||
          '    return svc.call(' || o_orderkey || ', "a, b(").get();' || chr(10) || '  }' AS body FROM orders JOIN customer ON c_custkey = o_custkey),
      c AS (SELECT DISTINCT path, fqn, 'package com.n' || c_nationkey || ';' || chr(10) || 'import java.util.Map;' || chr(10) || 'public class C' ||
        o_custkey || ' {' AS head FROM m)
      SELECT 'METHOD#' || fqn || '#o' || o_orderkey || ['()', '(int)', '(int,Map<String,Integer>)'][o_orderkey % 3 + 1] AS item_id,
        'CHANGED_METHOD' AS kind, path AS ref_path, CAST(3 * k + 4 AS INT) AS ref_start, body AS content,
        CAST((length(body) + 3) // 4 AS INT) AS tokens, true AS required FROM m
      UNION ALL SELECT 'CLASS#' || fqn, 'METADATA', path, NULL, head, CAST((length(head) + 3) // 4 AS INT), false FROM c""",
    "snapshot_fallback": """SELECT 'F' || o_orderkey AS path, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END AS content,
        CASE o_orderstatus WHEN 'F' THEN 'ARCHIVE' WHEN 'O' THEN 'CONTENTS_LAZY' END AS kind FROM orders""",
    "patch_sha": f"WITH {SHAS} SELECT pr_key, patch_sha FROM shas",
    "context_ids": f"""WITH {SHAS}, keyed AS (SELECT pr_key, sha256('acme/app' || chr(10) || 'base' || chr(10) || pr_key || chr(10) || patch_sha ||
        chr(10) || 'acq-v1') AS corpus_key FROM shas)
      SELECT pr_key, corpus_key, sha256(corpus_key || chr(10) || '1' || chr(10) || 'builder-v1' || chr(10) || 'heuristic-v1' || chr(10) ||
        '{FINGERPRINT}' || chr(10) || 'chars-div-4-v1') AS context_id FROM keyed""",
    "category_rules": f"""SELECT p_partkey, replace([{', '.join(f"'{p}'" for p, _ in domain.SHAPES)}][p_partkey % {len(domain.SHAPES)} + 1], '#',
        p_partkey::VARCHAR) AS path, [{', '.join(f"'{c}'" for _, c in domain.SHAPES)}][p_partkey % {len(domain.SHAPES)} + 1] AS category FROM part""",
    "archive_files": """SELECT 'C' || o_custkey AS sha, 'src/F' || o_orderkey || '.txt' AS path, o_orderpriority AS content FROM orders
        WHERE o_custkey % 11 != 3 AND o_custkey % 13 != 5""",
    "archive_errors": """SELECT DISTINCT 'C' || o_custkey AS sha, CASE WHEN o_custkey % 11 = 3 THEN 'leaves the archive'
        ELSE 'file too large' END AS error FROM orders WHERE o_custkey % 11 = 3 OR o_custkey % 13 = 5""",
    "event_payloads": """WITH e AS (SELECT *, user_id % 11 = 0 AS broken FROM events), p AS (
        SELECT event_id AS delivery, CASE WHEN NOT broken THEN CASE event_type WHEN 'signup' THEN 'opened' WHEN 'view' THEN 'synchronize'
          ELSE event_type END END AS action, CASE WHEN broken OR user_id % 7 = 0 THEN 0 ELSE user_id + 5 END AS installation, CASE
          WHEN NOT broken THEN 'acme' END AS owner, CASE WHEN NOT broken THEN 'app' END AS name,
          CASE WHEN broken OR user_id % 5 = 0 THEN 0 ELSE user_id END AS number FROM e)
      SELECT delivery, action, CAST(installation AS BIGINT) AS installation, owner, name, CAST(number AS BIGINT) AS number, CASE
        WHEN action IN ('opened', 'synchronize') THEN CASE WHEN installation = 0 OR number = 0 THEN 'INVALID' ELSE 'ACCEPTED' END
        ELSE 'IGNORED' END AS status FROM p""",
    "located_methods": """WITH f AS (SELECT c_custkey, 'N' || c_nationkey AS pr_key, 'src/main/java/C' || c_custkey || '.java' AS path,
        'src/main/java/' || CASE WHEN c_custkey % 4 = 2 THEN 'Old' ELSE 'C' END || c_custkey || '.java' AS old, c_custkey % 4 AS change FROM customer
        WHERE c_custkey % 5 != 4),
      m AS (SELECT f.*, o_orderkey, o_orderkey % 40 AS a FROM orders JOIN f ON o_custkey = c_custkey), n AS (SELECT DISTINCT o_custkey,
        l_returnflag = 'R' AS gone, l_partkey % 60 AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
      SELECT pr_key, 'HEAD' AS side, path, 'm' || o_orderkey AS method_id FROM m WHERE change != 1 AND EXISTS (SELECT 1 FROM n
        WHERE o_custkey = c_custkey AND NOT gone AND line BETWEEN a AND a + 3)
      UNION ALL SELECT pr_key, 'MERGE_BASE', old, 'm' || o_orderkey FROM m WHERE change != 3 AND (change = 1 OR EXISTS (SELECT 1 FROM n
        WHERE o_custkey = c_custkey AND gone AND line BETWEEN a AND a + 3))""",
    "related_items": """WITH e AS (
        SELECT 'B' || (l_partkey % 25) AS pr_key, l_linestatus = 'F' AS named, CASE WHEN l_linestatus = 'F' OR l_returnflag = 'R' THEN 'TESTED_BY'
          WHEN l_returnflag = 'A' THEN 'CALLS' ELSE 'OVERRIDES' END AS edge_type, l_suppkey, 's/S' || l_suppkey || '.java' AS from_path,
          CASE WHEN l_linestatus != 'F' THEN l_linenumber END AS from_line, 'r' || l_orderkey AS symbol_id, 'p/P' || l_partkey || '.java' AS to_path,
            CASE WHEN l_linestatus != 'F' AND l_quantity > 10 THEN CAST(l_quantity AS INT) END AS to_line,
            't' || l_orderkey || '-' || l_linenumber AS target, CAST(1 - l_discount AS DOUBLE) AS confidence FROM lineitem),
      i AS (SELECT *, CASE edge_type WHEN 'CALLS' THEN 'CALLER' WHEN 'OVERRIDES' THEN 'OVERRIDE' ELSE 'TEST' END AS kind FROM e
        WHERE l_suppkey % 9 != 0 AND l_suppkey % 7 != 0),
      o AS (SELECT *, kind || '#' || from_path || '#' || coalesce(from_line::VARCHAR, 'file') AS item_id, row_number() OVER (PARTITION BY pr_key
        ORDER BY named, CASE WHEN named THEN from_path ELSE edge_type END, to_path, to_line NULLS LAST, from_path, from_line NULLS LAST, target,
        symbol_id) AS k FROM i),
      b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pr_key, item_id ORDER BY confidence DESC, k) = 1), f AS (SELECT * FROM o
        QUALIFY row_number() OVER (PARTITION BY pr_key, item_id ORDER BY k) = 1),
      t AS (SELECT b.*, f.to_path AS owner_path, CASE WHEN b.from_line IS NULL THEN array_to_string([s_name || ' line ' || n FOR n IN range(1, 6)],
        chr(10)) WHEN b.from_line > 5 THEN '' ELSE s_name || ' line ' || b.from_line END AS content FROM b JOIN f USING (pr_key, item_id)
        JOIN supplier ON s_suppkey = b.l_suppkey)
      SELECT pr_key, item_id, kind, symbol_id, content, CAST((length(content) + 3) // 4 AS INT) AS tokens, confidence, owner_path FROM t""",
    "required_closures": """WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber AS k, l_partkey, CAST(l_quantity AS INT) AS tokens, CASE
        WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 2 ELSE l_linenumber + 1 END AS follows FROM lineitem),
      one AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey, k ORDER BY 'F' || l_partkey, tokens) = 1),
      reached AS (SELECT l_orderkey, k, follows FROM one WHERE k = 3 AND l_orderkey % 3 = 0 UNION SELECT n.l_orderkey, n.k, n.follows FROM reached r
        JOIN one n ON n.l_orderkey = r.l_orderkey AND n.k = r.follows)
      SELECT 'O' || l_orderkey AS pr_key, 'L' || k AS item_id, CASE WHEN r.k IS NULL THEN 'dropped' ELSE 'included' END AS status, tokens FROM one
        LEFT JOIN reached r USING (l_orderkey, k)""",
    "java_types": """WITH s AS (SELECT s_suppkey AS k, 'S' || s_suppkey || '.java' AS path, s_suppkey % 6 AS shape FROM supplier)
      SELECT path, 'type' AS row, 'a.b' || k || '.K' || k AS fqn, 'CLASS' AS kind, 'x.Base' AS super_class,
        'a.b' || k || '.Runnable,y.Other' AS interfaces FROM s WHERE shape = 0
      UNION ALL SELECT path, 'type', 'a.b' || k || '.I' || k, 'INTERFACE', 'a.b' || k || '.Left', '' FROM s WHERE shape = 1
      UNION ALL SELECT path, 'type', 'E' || k, 'ENUM', NULL, '' FROM s WHERE shape = 2
      UNION ALL SELECT path, 'type', 'r.R' || k, 'RECORD', NULL, '' FROM s WHERE shape = 3
      UNION ALL SELECT path, 'type', 'n.Outer' || k, 'CLASS', NULL, '' FROM s WHERE shape = 4
      UNION ALL SELECT path, 'type', 'n.Outer' || k || '.Inner', 'CLASS', NULL, '' FROM s WHERE shape = 4
      UNION ALL SELECT path, 'type', 'n.Outer' || k || '.Mark', 'ANNOTATION', NULL, '' FROM s WHERE shape = 4
      UNION ALL SELECT path, 'failure', NULL, NULL, NULL, NULL FROM s WHERE shape = 5""",
    "java_shape_methods": """WITH s AS (SELECT s_suppkey AS k, 'S' || s_suppkey || '.java' AS path, s_suppkey % 6 AS shape FROM supplier)
      SELECT path, 'a.b' || k || '.K' || k AS fqn, 'run()' AS signature, 10 AS start_line, 10 AS end_line FROM s WHERE shape = 0
      UNION ALL SELECT path, 'a.b' || k || '.I' || k, unnest(['one(String,int...)', 'two()']), unnest([4, 5]), unnest([4, 5]) FROM s WHERE shape = 1
      UNION ALL SELECT path, 'E' || k, 'v()', 4, 4 FROM s WHERE shape = 2
      UNION ALL SELECT path, 'r.R' || k, 'compareTo(R' || k || ')', 4, 4 FROM s WHERE shape = 3
      UNION ALL SELECT path, 'n.Outer' || k || '.Inner', 'pick(java.util.Map<String,T>,T[])', 4, 4 FROM s WHERE shape = 4
      UNION ALL SELECT path, 'n.Outer' || k || '.Mark', 'value()', 6, 6 FROM s WHERE shape = 4""",
    "java_shape_calls": """WITH s AS (SELECT s_suppkey AS k, 'S' || s_suppkey || '.java' AS path, s_suppkey % 6 AS shape FROM supplier)
      SELECT path, 'a.b' || k || '.K' || k AS fqn, CAST(NULL AS VARCHAR) AS enclosing_method, '' AS receiver, 'init' AS name, 0 AS arity, 8 AS line
        FROM s WHERE shape = 0
      UNION ALL SELECT path, 'a.b' || k || '.K' || k, 'run', '', 'go', 2, 10 FROM s WHERE shape = 0
      UNION ALL SELECT path, 'a.b' || k || '.I' || k, 'two', '', 'one', 2, 5 FROM s WHERE shape = 1
      UNION ALL SELECT path, 'r.R' || k, CAST(NULL AS VARCHAR), '', 'check', 1, 3 FROM s WHERE shape = 3
      UNION ALL SELECT path, 'r.R' || k, 'compareTo', 'Integer', 'compare', 2, 4 FROM s WHERE shape = 3""",
    "plan_overview": f"""WITH {FILES}, n AS (SELECT *, ends_with(path, '.java') AS java, coalesce(regexp_replace(content, '/[*].*?[*]/|//[^\\n]*', '',
        'gs'), '') AS code FROM files), a AS (SELECT *, java AND change_type != 'DELETE' AS head, doc_id % 12 = 4 AS bare, doc_id % 12 != 4
        AND doc_id % 17 = 3 AS odd FROM n)
      SELECT pr_key, 'READY' AS status, count(*) AS n_files, CAST(sum(CASE WHEN bare THEN 0 ELSE (n_lines + 1) // 3 END) AS BIGINT) AS additions, CASE
        WHEN bool_or(bare OR odd) THEN 'PARTIAL' ELSE 'COMPLETE' END AS patch, 'COMPLETE' AS head_snapshot, 'COMPLETE' AS merge_base_files,
        CASE WHEN count(*) FILTER (head) = 0 THEN 1.0 ELSE count(*) FILTER (head AND NOT regexp_matches(code,
          '[^\\s;]')) / count(*) FILTER (head) END AS ast_coverage,
        count(*) FILTER (bare) AS missing_patches, count(*) FILTER (odd) AS parse_failures, count(*) FILTER (doc_id % 12 IN (3, 8,
          10)) AS sensitive_skipped FROM a GROUP BY pr_key""",
    "lexical_files": f"""WITH {FILES}, cut AS (SELECT doc_id, path, 'h' || (doc_id % 2) AS sha, list_filter(string_split_regex(translate(regexp_replace(content,
        '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: length(w) > 1) AS w FROM files
        WHERE strlen(content) <= 8192 AND doc_id % 12 NOT IN (3, 8, 10)),
      post AS (SELECT sha, path, len(w) AS n, word, count(*) AS tf FROM (SELECT sha, path, w, unnest(w) AS word FROM cut) GROUP BY ALL),
      size AS (SELECT sha, count(*) AS files, CAST(sum(n) AS BIGINT) AS total FROM (SELECT DISTINCT sha, path, n FROM post) GROUP BY sha),
      df AS (SELECT sha, word, count(*) AS df FROM post GROUP BY ALL),
      asked AS (SELECT DISTINCT 'B' || (item_id % 10) AS pr_key, 'q' || item_id AS to_path, 'h' || (item_id % 2) AS sha, unnest(list_filter(string_split_regex(translate(regexp_replace(text,
        '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: length(w) > 1)) AS word FROM benchmark),
      weighed AS (SELECT a.*, files, total, CAST(floor(1000.0::DOUBLE * ln(1 + (files - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS BIGINT) AS weight FROM asked a
        JOIN df USING (sha, word) JOIN size USING (sha)),
      most AS (SELECT pr_key, to_path, CAST(sum(weight) * 2200 AS BIGINT) AS most FROM weighed GROUP BY ALL),
      own AS (SELECT 'B' || (doc_id % 10) AS pr_key, path FROM files WHERE doc_id % 9 = 4),
      scored AS (SELECT pr_key, to_path, path, CAST(sum(weight * CAST(floor(2200 * 1000 * tf / (1000 * tf + 1200 * (250 + (750 * n * files) // total) // 1000)) AS BIGINT)) AS BIGINT) AS score
        FROM weighed JOIN post USING (sha, word) GROUP BY ALL)
      SELECT pr_key, to_path, path, score, most, CAST(row_number() OVER (PARTITION BY pr_key, to_path ORDER BY score DESC, path) AS INT) AS rank
      FROM scored JOIN most USING (pr_key, to_path) WHERE score > 0 AND (pr_key, path) NOT IN (SELECT (pr_key, path) FROM own)
      QUALIFY rank <= 5""",
    "co_change_rules": """WITH h AS (SELECT DISTINCT 'r' || (o_custkey % 5) AS repo, o_orderkey AS c, o_orderdate AS ts, 'f' || (l_suppkey % 12) || '.java' AS path FROM orders JOIN lineitem
        ON l_orderkey = o_orderkey), narrow AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY c) <= 4),
      pr AS (SELECT 'S' || s_suppkey AS pr_key, 'r' || (s_suppkey % 5) AS repo, DATE '1995-01-02' + CAST(s_suppkey % 900 AS INT) AS ts, unnest([s_suppkey % 12, (s_suppkey + 5) % 12]) AS f FROM supplier),
      own AS (SELECT pr_key, repo, ts, 'f' || f || '.java' AS to_path FROM pr),
      past AS (SELECT pr_key, to_path, n.c FROM own o JOIN narrow n ON n.repo = o.repo AND n.path = o.to_path AND n.ts < o.ts),
      n AS (SELECT pr_key, to_path, count(*) AS commits FROM past GROUP BY ALL)
      SELECT pr_key, to_path, h.path, count(*) AS support, commits, count(*) / commits AS confidence FROM past p JOIN n USING (pr_key, to_path) JOIN narrow h ON h.c = p.c AND h.path != to_path
      WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pr_key = p.pr_key AND o.to_path = h.path) GROUP BY pr_key, to_path, h.path, commits HAVING count(*) >= 3 AND count(*) / commits >= 0.25""",
    "co_change_states": """SELECT 'S' || s_suppkey AS pr_key, count(o_orderkey) AS commits, CASE WHEN count(o_orderkey) >= 1500 THEN 'ENABLED' ELSE 'UNAVAILABLE_NO_HISTORY' END AS co_change
      FROM supplier LEFT JOIN (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) ON o_custkey % 5 = s_suppkey % 5 AND o_orderdate < DATE '1995-01-02' + CAST(s_suppkey % 900 AS INT)
      GROUP BY s_suppkey""",
    "bounded_texts": """SELECT doc_id, CASE WHEN length(text) > 1024 THEN left(text, 1024) || chr(10) || '… (truncated)' ELSE text END AS content
        FROM documents""",
    "reviewer_answers": """WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS pr_key, CAST(turn AS INT) AS slice_no, CAST(length(coalesce(text,
        '')) AS INT) AS n FROM conversations)
      SELECT pr_key, slice_no, n % 5 != 0 AS ok, CASE WHEN n % 5 != 0 THEN '{"findings": [], "length": ' || n || '}' END AS raw, CASE
        WHEN n % 5 != 0 THEN 'm' END AS model, CASE WHEN n % 5 != 0 THEN n END AS prompt_tokens,
        CAST(NULL AS INT) AS completion_tokens, CASE WHEN n % 5 = 0 THEN 'ValueError: ' || n || ' characters' END AS error FROM p""",
    "fallback_comments": f"""WITH {FINDINGS}, shown AS (
        SELECT *, '**[' || severity || '] ' || title || '**' || chr(10) || chr(10) || message || CASE
          WHEN suggestion IS NOT NULL THEN chr(10) || chr(10) || 'Suggestion: ' || suggestion ELSE '' END
          || CASE WHEN cited IS NOT NULL THEN chr(10) || chr(10) || '_Cited context: ' || cited || '_' ELSE '' END AS comment FROM anchored
            WHERE CAST(substr(pr_key, 2) AS INT) % 2 = 0),
      lost AS (SELECT pr_key, string_agg('- `' || path || ':' || line || '` ' || comment || chr(10), '' ORDER BY path, line, comment) AS listed
        FROM shown WHERE anchored GROUP BY pr_key),
      bodies AS (SELECT pr_key, chr(10) || chr(10) || '**Findings outside the diff:**' || chr(10) || string_agg('- `' || path || ':' || line || '` ['
        || severity || '] **' || title || '** — ' || message || chr(10), '' ORDER BY slice_no, pos) AS body FROM shown WHERE NOT anchored
        GROUP BY pr_key)
      SELECT pr_key, chr(10) || chr(10) || '**Findings:**' || chr(10) || listed || coalesce(body, '') AS comment FROM lost LEFT
        JOIN bodies USING (pr_key)""",
    "review_comments": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_returnflag != 'R' AS ok FROM lineitem),
      t AS (SELECT l_orderkey, bool_or(ok) AS available, coalesce(arg_max('model-' || l_suppkey, k) FILTER (ok AND l_linestatus = 'F'), '') AS model, coalesce(sum(CAST(l_quantity AS INT)) FILTER (ok AND l_tax > 0), 0) AS asked,
        coalesce(sum(l_linenumber) FILTER (ok), 0) AS answered, coalesce(sum(l_linenumber % 2 + l_linenumber % 3) FILTER (ok), 0) AS dropped, count(*) FILTER (l_quantity > 40) AS n,
        count(*) FILTER (l_quantity > 40 AND l_returnflag = 'R') AS c, count(*) FILTER (l_quantity > 40 AND l_returnflag = 'A') AS w FROM r GROUP BY l_orderkey)
      SELECT 'O' || o_orderkey AS pr_key, 'Plan of ' || o_orderkey || chr(10) || chr(10) || '### LLM Review' || chr(10) || CASE WHEN coalesce(available, false) THEN
          'Model `' || model || '` · tokens: prompt=' || asked || ', completion=' || answered || CASE WHEN dropped > 0 THEN ' · dropped malformed findings: ' || dropped ELSE '' END || chr(10)
          || CASE WHEN n = 0 THEN 'No issues found.' ELSE '**' || n || '** findings (critical=' || c || ', warning=' || w || ', suggestion=' || (n - c - w) || ')' END || chr(10)
        ELSE 'LLM review unavailable (service down or not configured); context summary only.' || chr(10) END AS comment
      FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""",
}


def _replayed(policy: str, budget: int, caller: float, test: float) -> str:
    """The SQL of packing under other settings."""
    packed = ORACLE_SQL["pack_slices"].replace("<= 60", f"<= {budget}").replace("WHEN 'CALLER' THEN 0.8 WHEN 'TEST' THEN 0.85", f"WHEN 'CALLER' THEN {caller} WHEN 'TEST' THEN {test}")
    return f"SELECT '{policy}' AS policy, pr_key, item_id, status, tokens FROM ({packed})"


ORACLE_SQL["policy_replay"] = f"""WITH p AS ({_replayed("default", 60, 0.8, 0.85)} UNION ALL {_replayed("tests first", 40, 0.5, 1.0)}),
  t AS (SELECT *, status = 'included' AS took, count(*) FILTER (status = 'included') OVER (PARTITION BY pr_key, item_id) AS takers FROM p)
  SELECT policy, pr_key, count(*) FILTER (took) AS n_included, count(*) FILTER (NOT took) AS n_dropped, CAST(coalesce(sum(tokens) FILTER (took), 0) AS BIGINT) AS tokens,
    count(*) FILTER (took AND takers = 2) AS n_shared, count(*) FILTER (took AND takers = 1) AS n_alone FROM t GROUP BY GROUPING SETS ((policy, pr_key), (policy))"""

_COVERING = """WITH RECURSIVE c AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'CALLER' WHEN 'N' THEN 'TEST' ELSE 'OVERRIDE' END AS kind FROM lineitem),
  i AS (SELECT 'O' || l_orderkey AS pr_key, kind || '#' || l_partkey || '#' || l_suppkey || '#' || l_linenumber AS item_id, 'F' || l_partkey AS path,
      CASE WHEN l_tax > 0 THEN l_linenumber ELSE -1 END AS spot, CAST(l_quantity AS INT) AS tokens, l_linestatus = 'F' AND l_linenumber = 1 AS required,
      CAST(CASE kind WHEN 'CALLER' THEN 0.8 WHEN 'TEST' THEN 0.85 ELSE 0.9 END AS DOUBLE) * (1 - l_discount) AS value,
      CASE WHEN l_suppkey % 7 = 3 THEN CAST([] AS VARCHAR[]) ELSE [kind || '/p' || l_partkey % 3, 'p' || l_partkey % 3 || '/s' || l_suppkey % 2, 's' || l_suppkey % 2 || '/l' || l_linenumber % 2] END AS pieces
    FROM c QUALIFY row_number() OVER (PARTITION BY pr_key, item_id ORDER BY spot, tokens, required, value) = 1),
  start AS (SELECT pr_key, CAST(coalesce(sum(tokens) FILTER (required), 0) AS BIGINT) AS used, coalesce(list(item_id) FILTER (required), CAST([] AS VARCHAR[])) AS taken,
      coalesce(flatten(list(pieces) FILTER (required)), CAST([] AS VARCHAR[])) AS shown FROM i GROUP BY pr_key),
  walk AS (SELECT pr_key, 0 AS step, used, taken, shown, CAST(NULL AS VARCHAR) AS item_id FROM start
    UNION ALL SELECT pr_key, step + 1, used + tokens, list_append(taken, next_id), list_concat(shown, pieces), next_id FROM (
      SELECT *, row_number() OVER (PARTITION BY pr_key ORDER BY -(CASE WHEN len(pieces) = 0 THEN value ELSE value * fresh / len(pieces) END) / greatest(tokens, 1), path, spot, next_id) AS nth
      FROM (SELECT w.pr_key, w.step, w.used, w.taken, w.shown, i.item_id AS next_id, i.tokens, i.pieces, i.value, i.path, i.spot, len(list_filter(i.pieces, lambda p: NOT list_contains(w.shown, p))) AS fresh
        FROM walk w JOIN i ON i.pr_key = w.pr_key AND NOT list_contains(w.taken, i.item_id) AND w.used + greatest(i.tokens, 1) <= 60)
      WHERE len(pieces) = 0 OR fresh > 0) WHERE nth = 1),
  out AS (SELECT i.*, w.step FROM i LEFT JOIN walk w ON w.pr_key = i.pr_key AND w.item_id = i.item_id),
  packed AS (SELECT pr_key, 1 AS slice_no, item_id, CASE WHEN required OR step IS NOT NULL THEN 'included' ELSE 'dropped' END AS status, tokens, pieces,
    CAST(row_number() OVER (PARTITION BY pr_key, required OR step IS NOT NULL ORDER BY CASE WHEN required THEN 0 ELSE step END, path, spot, item_id) - 1 AS INT) AS pack_ord FROM out)"""

ORACLE_SQL["pack_covering"] = f"{_COVERING} SELECT pr_key, slice_no, item_id, status, tokens, pack_ord FROM packed"
ORACLE_SQL["shown_twice"] = f"""{_COVERING}, p AS (SELECT pr_key, slice_no, unnest(pieces) AS piece FROM packed WHERE status = 'included')
  SELECT pr_key, slice_no, count(*) AS n_pieces, count(*) - count(DISTINCT piece) AS n_repeated FROM p GROUP BY pr_key, slice_no"""

ORACLE_SQL["kept_declarations"] = f"SELECT *, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) % 3 != 0 AS reused FROM ({ORACLE_SQL['java_types']})"

ORACLE_SQL["support_recall"] = f"""WITH packed AS ({ORACLE_SQL["pack_slices"]}),
  tests AS (SELECT 'O' || l_orderkey AS pr_key, 'TEST#' || l_partkey || '#' || l_suppkey || '#' || l_linenumber AS item_id, CAST(l_quantity AS INT) AS tokens FROM lineitem WHERE l_returnflag = 'N'),
  gold AS (SELECT pr_key, item_id FROM tests UNION SELECT pr_key, 'lost' || item_id FROM tests WHERE tokens % 5 = 0),
  placed AS (SELECT pr_key, item_id, row_number() OVER w AS place, sum(tokens) OVER w AS spent FROM packed WHERE status = 'included' WINDOW w AS (PARTITION BY pr_key ORDER BY pack_ord)),
  limits AS (SELECT * FROM (VALUES (1, NULL), (2, NULL), (NULL, 30), (2, 30)) v(top, budget))
  SELECT g.pr_key, CAST(coalesce(l.top, 0) AS INT) AS top, CAST(coalesce(l.budget, 0) AS BIGINT) AS budget, count(*) AS n_gold, count(*) FILTER (place <= coalesce(l.top, place) AND spent <= coalesce(l.budget, spent)) AS n_found,
    n_found / n_gold AS recall FROM gold g CROSS JOIN limits l LEFT JOIN placed p ON p.pr_key = g.pr_key AND p.item_id = g.item_id GROUP BY ALL"""
