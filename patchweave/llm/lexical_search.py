r"""Ranked lexical search by bit-sliced Bloom signatures: bounds from bitmaps, exact scores for all that the bounds cannot rule out.

1. Index. Documents are packed into blocks of similar vocabulary. A block is a Bloom filter for each document, stored by slices: slice
   ``s`` holds bit ``s`` of all documents of the block, so a term's presence in a whole block is the conjunction of a few bitmaps. A
   term goes in once for each threshold of LEVELS that its occurrences reach. Filters only overestimate. Besides, each Arrow batch
   leaves its exact lexicon: how many of its documents hold each term.
2. Bounds. For each query the slices of its terms are summed with the terms' weights, level by level; times what a level adds to a
   document of that length, this is no less than the document's score.
3. The documents with the highest bounds are scored exactly. That gives each query a threshold, the score and id of its last place.
4. All documents whose bound does not prove them to be behind the threshold are scored exactly from their texts.

Scores are 64-bit integers throughout, but for the weight's logarithm.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.common import bounded_batches, materialize, table

#: Occurrences that make a level, hash functions of a filter, and its bits for each entry at least.
LEVELS, HASHES, BITS = (1, 2, 3, 5, 9, 17), 4, 10
#: Documents of a block at most, and bits of a block at most.
BLOCK, BLOCK_BITS = 1024, 1 << 23
#: Documents of the highest bounds that set a query's threshold.
SEEDS = 32
#: Bytes of query texts that are broadcast at a time, and candidates that are; more are joined.
QUERY_BYTES, BROADCAST_ROWS = 16 << 20, 500_000
#: The bytes of a term, with A-Z in lower case; all others part terms.
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_LEVEL_SALT = np.uint64(0x9E3779B97F4A7C15)

_INDEX = "kind string, n_docs long, n_terms long, width int, keys binary, ids binary, no_id binary, lengths binary, slices binary, terms array<binary>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def _places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The slices of each hash at a level, (HASHES, n)."""
    with np.errstate(over="ignore"):
        h = (hashes + _LEVEL_SALT * np.uint64(level)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        step = (h * np.uint64(0xC4CEB9FE1A85EC53)) | np.uint64(1)
        return np.stack([((h + np.uint64(k) * step) >> np.uint64(20)) & np.uint64(width - 1) for k in range(HASHES)]).astype(np.int64)


def _block(docs: list[tuple], bits_each: int) -> dict:
    """One block from (key, doc_id, length, hashes, occurrences) of documents."""
    entries = max(sum(int((tf >= level).sum()) for level in LEVELS) for *_, tf in docs)
    width, n = 1 << max(6, (bits_each * entries - 1).bit_length()), -(-len(docs) // 8) * 8
    bits = np.zeros((width, n), bool)
    at, hashes, tf = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs]), np.concatenate([d[3] for d in docs]), np.concatenate([d[4] for d in docs])
    for k, level in enumerate(LEVELS):
        held = tf >= level
        for slices in _places(hashes[held], k, width):
            bits[slices, at[held]] = True
    ids = [d[1] for d in docs]
    return {"kind": "block", "n_docs": len(docs), "n_terms": sum(d[2] for d in docs), "width": width, "keys": np.array([d[0] for d in docs], np.int64).tobytes(), "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
            "no_id": np.array([i is None for i in ids]).tobytes(), "lengths": np.array([d[2] for d in docs], np.int64).tobytes(), "slices": np.packbits(bits, axis=1).tobytes(), "terms": [], "counts": []}


def _indexed(block: int, bits: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "no_id", "lengths", "slices")), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))])
        for batch in batches:
            docs, lexicon, known = [], Counter(), {}
            for key, doc_id, text in zip(batch["row_key"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                found = Counter(terms_of(text.as_py()))
                if found:
                    new = [t for t in found if t not in known]
                    known.update(zip(new, _hashes(new).tolist(), strict=True))
                    lexicon.update(found.keys())
                    docs.append((key, doc_id, found.total(), np.fromiter((known[t] for t in found), np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
            docs.sort(key=lambda d: len(d[3]))
            first = 0
            while first < len(docs):
                last = min(first + block, len(docs))
                # filters are as wide as the largest document asks for, so long documents make small blocks
                while last - first > 8 and (last - first) * 2 * bits * len(LEVELS) * len(docs[last - 1][3]) > BLOCK_BITS:
                    last = first + (last - first) // 2
                yield pa.RecordBatch.from_pylist([_block(docs[first:last], bits)], schema)
                first = last
            if lexicon:
                yield pa.RecordBatch.from_pylist([{"kind": "lexicon", "terms": list(lexicon), "counts": list(lexicon.values())}], schema)

    return made


def _keyed(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, text); the key is a hash of both, so rows of null or repeated ids are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")


def index_documents(docs: DataFrame, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The index of ``docs`` (doc_id, text), stored: rows of kind block, and rows of kind lexicon.

    It knows nothing of queries. One pass over the texts without a shuffle; a task holds an Arrow batch of documents. Documents without
    a term, null texts among them, are not in it.
    """
    return materialize(_keyed(docs).mapInArrow(_indexed(block, bits), _INDEX), "signatures")


@dataclass
class Queries:
    """What the tasks know of a set of queries: their terms, and what a term weighs."""

    names: list[int]
    terms: list[list[bytes]]
    n_docs: int = 0
    n_terms: int = 0
    weight: dict[bytes, int] = field(default_factory=dict)

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """What the lengths of documents add to the occurrences in a score's denominator."""
        different, where = np.unique(lengths, return_inverse=True)
        return np.array([10 + 90 * int(n) * self.n_docs // self.n_terms for n in different], np.int64)[where]


def _share(tf: np.ndarray | int, norm: np.ndarray | int):
    """What a document's occurrences of a term earn for a unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def _bounds(row: dict, queries: Queries, hashes: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """(query, bounds of the block's documents) for each query that has a term in the block's filters."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
    norm = queries.norm(lengths)
    present, added, before = [], [], np.zeros(len(lengths), np.int64)
    for k in range(len(LEVELS)):
        bits = np.bitwise_and.reduce(slices[_places(hashes, k, row["width"])], axis=0)
        bits = bits & present[-1] if present else bits
        present.append(bits)
        # no more occurrences than below the next level, or than the document has terms
        most = np.minimum(lengths, LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else lengths
        share = _share(most, norm)
        added.append(share - before)
        before = share
    some = [bits.any(axis=1) for bits in present]
    for q, (at, weights) in enumerate(own):
        total = None
        for k, bits in enumerate(present):
            held = some[k][at]
            if not held.any():
                break
            # the sum of slices is exact: a sum of weights, far below 2^53
            summed = weights[held].astype(np.float64) @ np.unpackbits(bits[at[held]], axis=1, count=len(lengths)).astype(np.float64)
            step = summed.astype(np.int64) * added[k]
            total = step if total is None else total + step
        if total is not None:
            yield q, total


def _own_terms(queries: Queries) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The hashes of all terms, and for each query the places of its own among them with their weights."""
    vocabulary = [t for t, w in queries.weight.items() if w > 0]
    place = {t: k for k, t in enumerate(vocabulary)}
    own = []
    for terms in queries.terms:
        at = np.array([place[t] for t in terms if t in place], np.int64)
        own.append((at, np.array([queries.weight[vocabulary[k]] for k in at], np.int64)))
    return _hashes(vocabulary), own


def _last(doc_id: int | None) -> tuple[bool, int]:
    """The order of ids among equal scores: nulls last."""
    return doc_id is None, doc_id or 0


def _highest_bounds(shared, k: int):
    """(query, row_key) of the documents of a task with the highest bounds of each query."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = shared.value, defaultdict(list)
        hashes, own = _own_terms(queries)
        for batch in batches:
            for row in batch.to_pylist():
                keys, ids = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ids"], np.int64)
                missing = np.frombuffer(row["no_id"], bool)
                for q, bound in _bounds(row, queries, hashes, own):
                    top = np.lexsort((ids, missing, -bound))[:k]
                    rows = [(int(bound[i]), bool(missing[i]), int(ids[i]), int(keys[i])) for i in top if bound[i] > 0]
                    best[q] = heapq.nsmallest(k, best[q] + rows, key=lambda r: (-r[0], *r[1:]))
        flat = [(q, *row) for q, rows in best.items() for row in rows]
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate(kinds)], names=["query", "bound", "no_id", "id", "row_key"])

    return found


def _not_excluded(shared, limits: dict[int, tuple[int, tuple[bool, int]]]):
    """(row_key, queries) of the documents that the bounds do not prove to be behind a query's last place."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        hashes, own = _own_terms(queries)
        for batch in batches:
            for row in batch.to_pylist():
                keys, ids = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ids"], np.int64)
                missing = np.frombuffer(row["no_id"], bool)
                asked = defaultdict(list)
                for q, bound in _bounds(row, queries, hashes, own):
                    score, (no_id, last) = limits.get(q, (1, (True, 1 << 63)))
                    ahead = (missing < no_id) | ((missing == no_id) & (ids <= last))
                    for i in np.flatnonzero((bound > score) | ((bound == score) & ahead)):
                        asked[i].append(q)
                yield pa.RecordBatch.from_arrays([pa.array([int(keys[i]) for i in asked], pa.int64()), pa.array(list(asked.values()), pa.list_(pa.int32()))], names=["row_key", "queries"])

    return found


def _scored(shared, k: int):
    """(query, doc_id, score) of the best documents of a task, exact."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = shared.value, defaultdict(list)
        for batch in batches:
            for doc_id, text, asked in zip(batch["doc_id"].to_pylist(), batch["text"], batch["queries"].to_pylist(), strict=True):
                occurs = Counter(terms_of(text.as_py()))
                norm = 10 + 90 * occurs.total() * queries.n_docs // queries.n_terms
                earned = {}
                for q in asked:
                    score = 0
                    for t in queries.terms[q]:
                        if t in occurs:
                            if t not in earned:
                                earned[t] = queries.weight[t] * _share(occurs[t], norm)
                            score += earned[t]
                    if score > 0:
                        best[q].append((-score, *_last(doc_id)))
                        if len(best[q]) > 16 * k:
                            best[q] = heapq.nsmallest(k, best[q])
        flat = [(q, None if row[1] else row[2], -row[0]) for q, rows in best.items() for row in heapq.nsmallest(k, rows)]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate(kinds)], names=["query", "doc_id", "score"])

    return found


def _score(docs: DataFrame, asked: DataFrame, shared, k: int) -> DataFrame:
    """(query, rank, doc_id, score): the exact ranks among the documents asked for, (row_key, queries)."""
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    rows = _keyed(docs).join(asked, "row_key").select("doc_id", "text", "queries").mapInArrow(_scored(shared, k), "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def _document_frequencies(index: DataFrame, wanted) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms, from the lexicons."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for terms, counts in zip(batch["terms"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                for t, n in zip(terms, counts, strict=True):
                    if t in wanted.value:
                        total[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    lexicons = index.where("kind = 'lexicon'").select("terms", "counts").mapInArrow(counted, "term binary, n long")
    return {bytes(r.term): r.n for r in lexicons.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def search(index: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query with a score above 0, fewer if there are no more.

    ``index`` comes from ``index_documents(docs)``; ``queries`` has item_id and text, each different pair is a query of its own. Equal
    scores rank by doc_id, nulls last; each row of ``docs`` is a document, so repeated rows count and rank each. A null text and a
    query of null item_id match nothing. Queries are taken by QUERY_BYTES of text at a time, so what is broadcast, and the terms and
    thresholds that reach the driver, are bounded whatever the number of queries.
    """
    spark = docs.sparkSession
    asked = queries.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / QUERY_BYTES))
    size = index.where("kind = 'block'").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        chunk = Queries([r.item_id for r in rows], [list(dict.fromkeys(terms_of(r.text))) for r in rows], size[0] or 0, size[1] or 0)
        if chunk.n_terms:
            out.append(_ranked(index, docs, chunk, k))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _ranked(index: DataFrame, docs: DataFrame, chunk: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast({t for terms in chunk.terms for t in terms})
    frequencies = _document_frequencies(index, wanted)
    chunk.weight = {t: math.floor(1000 * math.log((2 * chunk.n_docs + 2) / (2 * df + 1))) for t, df in frequencies.items()}
    chunk.terms = [[t for t in terms if t in chunk.weight] for terms in chunk.terms]
    shared = spark.sparkContext.broadcast(chunk)
    blocks = index.where("kind = 'block'").drop("kind", "terms", "counts", "n_docs", "n_terms")

    high = blocks.mapInArrow(_highest_bounds(shared, SEEDS), "query int, bound long, no_id boolean, id long, row_key long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "no_id", "id", "row_key"))
    seeds = high.withColumn("place", place).where(F.col("place") <= SEEDS).groupBy("row_key").agg(F.collect_list("query").alias("queries"))
    last = _score(docs, materialize(seeds, "seeds"), shared, k).where(F.col("rank") == k)
    limits = {r.query: (r.score, _last(r.doc_id)) for r in last.collect()}

    left = materialize(blocks.mapInArrow(_not_excluded(shared, limits), "row_key long, queries array<int>"), "candidates")
    # equal rows share a key and are asked for once
    left = left.groupBy("row_key").agg(F.first("queries").alias("queries"))
    ranked = _score(docs, left, shared, k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(chunk.names)), "query int, item_id long"))
    return materialize(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score"), "ranks")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return search(index_documents(docs), docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT d, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM found WHERE len(w) > 0
), size AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), held AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held CROSS JOIN size WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, text, d, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights w USING (term) JOIN held USING (term) JOIN docs USING (d) CROSS JOIN size GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
