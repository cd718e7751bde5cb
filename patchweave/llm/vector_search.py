r"""Exact top-k inner products by an impact-ordered index, a score at a time.

1. Index. Vectors are packed into blocks. For each component a block lists its vectors by descending value, cut into SEGMENTS posting
   segments of equal length, each with its highest and lowest value. It knows nothing of queries.
2. Search. What a segment can add to a query's score at most, above the least that its component can add, is its impact, quantised
   upwards to IMPACTS levels. Segments of all components are processed by descending impact, a wave at a time; their vectors
   accumulate them. A component that a vector has not met yet adds no more than the impact of the next segment, so after each wave
   every vector has a bound. Those whose bound is behind the query's threshold are proved to be no members.
3. When few possible members are left, or all segments are processed, the possible members are scored exactly, in integers.

The threshold starts from a bounded sample of SAMPLE vectors, whose scores are exact too, and rises with what a task finds. It is always the
score and id of k real vectors, so nothing is cut without proof.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.common import bounded_batches, materialize, table

#: Vectors of a block at most (a place in it takes 16 bits), segments of a component, levels of impact, and waves that a block's segments are processed in.
BLOCK, SEGMENTS, IMPACTS, WAVES = 4096, 32, 4096, 8
#: Possible members of a block that are scored at once, whatever segments are left.
FEW = 32
#: Vectors that thresholds start from, and bytes of queries that are broadcast at a time.
SAMPLE, QUERY_BYTES = 1024, 32 << 20

_INDEX = "ids binary, vectors binary, width int, segments int, postings binary, high binary, low binary"
_NONE = (-math.inf, math.inf)


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), of vectors without null and non-finite components, and of a known id."""
    real = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    whole: Column = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(real, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - ends[:-1][row]] = flat
    return out


def _block(ids: np.ndarray, vectors: np.ndarray, segments: int) -> tuple:
    """A block's postings: for each component its vectors by descending value, filled up with a place that is none."""
    n, width = vectors.shape
    size = -(-n // segments)
    order = np.full((width, segments * size), n, np.uint16)
    order[:, :n] = np.argsort(-vectors, axis=0, kind="stable").T
    ranked = np.sort(vectors, axis=0)[::-1].T
    first, last = np.minimum(np.arange(segments) * size, n - 1), np.minimum(np.arange(1, segments + 1) * size, n) - 1
    return ids.tobytes(), vectors.tobytes(), width, segments, order.tobytes(), ranked[:, first].tobytes(), ranked[:, last].tobytes()


def _indexed(width: int, block: int, segments: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for part in (batch.slice(k, block) for k in range(0, batch.num_rows, block)):
                row = _block(part["vec_id"].to_numpy(), _matrix(part["v"], width), segments)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["ids", "vectors", "width", "segments", "postings", "high", "low"])

    return made


def index_vectors(vectors: DataFrame, scale: float = 256, block: int = BLOCK, segments: int = SEGMENTS) -> tuple[DataFrame, int]:
    """(index, components) of ``vectors`` (vec_id, embedding); every usable vector is in it, in one pass without a shuffle."""
    found = usable(vectors, scale)
    width = found.agg(F.max(F.size("v"))).first()[0] or 0
    return materialize(found.mapInArrow(_indexed(width, block, segments), _INDEX), "postings"), width


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in 64 bits; what may not fit is worked out in whole numbers of any size, and an error if it does not."""
    most = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).sum())
    if most < 1 << 62:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors], np.int64)


def _segments(high: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(segments by descending impact, their quantised impacts, the least score, what a level of impact is worth)."""
    with_high, with_low = high * query[:, None], low * query[:, None]
    most, least = np.maximum(with_high, with_low), np.minimum(with_high, with_low).min(axis=1)
    impact = most - least[:, None]
    step = max(float(impact.max()) / (IMPACTS - 1), 1.0)
    level = np.ceil(impact / step)
    order = np.argsort(-level, axis=None, kind="stable")
    return order, level.ravel()[order], float(least.sum()), step


def possible_members(postings: np.ndarray, high: np.ndarray, low: np.ndarray, n: int, query: np.ndarray, least_score: float, few: int) -> np.ndarray:
    """The vectors of a block that may reach ``least_score``; all others are proved not to."""
    width, _, size = postings.shape
    if least_score == -math.inf or not width:
        return np.arange(n)
    if float(np.abs(high).max(initial=0) + np.abs(low).max(initial=0)) * float(np.abs(query).sum()) >= 1 << 50:
        return np.arange(n)  # bounds in floating point would prove nothing
    order, level, base, step = _segments(high, low, query)
    gained, met = np.zeros(n + 1), np.zeros(n + 1)
    flat = postings.reshape(-1, size)
    # no proof can come before the bound of what is not met is small, so the first wave takes half
    cuts = np.unique(np.linspace(len(order) // 2, len(order), WAVES).astype(int))
    done, left = 0, np.arange(n)
    for cut in cuts:
        wave = order[done:cut]
        at = flat[wave].ravel()
        gained += np.bincount(at, weights=np.repeat(level[done:cut], size), minlength=n + 1)
        met += np.bincount(at, minlength=n + 1)
        done = cut
        following = level[cut] if cut < len(level) else 0
        bound = base + step * (gained[:n] + following * (width - met[:n]))
        left = np.flatnonzero(bound >= least_score)
        if len(left) <= few:
            break
    return left


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best different ones of (-score, vec_id)."""
    return heapq.nsmallest(k, set(found))


def _searched(shared, k: int, few: int):
    """(query, vec_id, score): the best vectors that a task finds for each query, if they are not behind its threshold."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, thresholds = shared.value
        mine: list[list[tuple[int, int]]] = [[] for _ in names]
        limits = list(thresholds)
        for batch in batches:
            for row in batch.to_pylist():
                ids, width, segments = np.frombuffer(row["ids"], np.int64), row["width"], row["segments"]
                n = len(ids)
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, width)
                postings = np.frombuffer(row["postings"], np.uint16).reshape(width, segments, -(-n // segments))
                high, low = (np.frombuffer(row[c], np.int64).reshape(width, segments).astype(np.float64) for c in ("high", "low"))
                for q, query in enumerate(queries):
                    least, last = limits[q]
                    at = possible_members(postings, high, low, n, query.astype(np.float64), least, few)
                    scores = _exact(vectors[at], query)
                    ahead = (ids[at] != names[q]) & ((scores > least) | ((scores == least) & (ids[at] <= last)))
                    if ahead.any():
                        better = list(zip((-scores[ahead]).tolist(), ids[at][ahead].tolist(), strict=True))
                        mine[q] = _best(mine[q] + better, k)
                        if len(mine[q]) == k and (-mine[q][-1][0], -mine[q][-1][1]) > (least, -last):
                            limits[q] = (-mine[q][-1][0], mine[q][-1][1])
        flat = [(names[q], i, -s) for q, rows in enumerate(mine) for s, i in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["query_id", "vec_id", "score"])

    return found


def _starting(sample, width: int, k: int):
    """Queries (vec_id, v) with the score and id of the k-th best vector of the sample; nulls if there are fewer."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sample.value
        for batch in batches:
            limits = []
            for name, query in zip(batch["vec_id"].to_pylist(), _matrix(batch["v"], width), strict=True):
                scores = _exact(vectors, query)
                best = np.lexsort((ids, -scores))
                best = best[ids[best] != name][:k]
                limits.append((int(scores[best[-1]]), int(ids[best[-1]])) if len(best) == k else (None, None))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], *(pa.array([x[j] for x in limits], pa.int64()) for j in (0, 1))], names=["vec_id", "v", "least", "last"])

    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256, block: int = BLOCK, segments: int = SEGMENTS, few: int = FEW) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with vectors of other ids, fewer if there are no more.

    Both tables have vec_id and embedding. Components count as floor(scale * x). Vectors that are null, hold null or non-finite components
    or have no id take no part. Shorter vectors end in zeros. Ties rank by vec_id. Rows of one id with equal scores count once, so repeated
    rows do; different vectors of one id rank each by its own score, and the ranks of an id with several queries come from all of them.
    Queries are taken by QUERY_BYTES at a time, so what is broadcast is bounded; every part reads the whole index. An empty table on either
    side gives no rows.
    """
    spark = vectors.sparkSession
    index, width = index_vectors(vectors, scale, block, segments)
    drawn = usable(vectors, scale).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    # one id counts once among those that a threshold rests on
    ids, place = np.unique(drawn["vec_id"].to_numpy(), return_index=True)
    sample = spark.sparkContext.broadcast((ids, _matrix(drawn["v"].combine_chunks(), width)[place] if len(ids) else np.zeros((0, width), np.int64)))
    asked = usable(queries, scale).select("vec_id", F.slice("v", 1, max(width, 1)).alias("v")).distinct()
    started = materialize(asked.mapInArrow(_starting(sample, width, k), "vec_id long, v array<long>, least long, last long"), "thresholds")
    parts = max(1, math.ceil(started.count() * max(width, 1) * 8 / QUERY_BYTES))
    out = []
    for part in range(parts):
        rows = started.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)) == part).toArrow()
        limits = [_NONE if a is None else (a, b) for a, b in zip(rows["least"].to_pylist(), rows["last"].to_pylist(), strict=True)]
        matrix = _matrix(rows["v"].combine_chunks(), width) if rows.num_rows else np.zeros((0, width), np.int64)
        shared = spark.sparkContext.broadcast((rows["vec_id"].to_pylist(), matrix, limits))
        out.append(materialize(index.mapInArrow(_searched(shared, k, few), "query_id long, vec_id long, score long"), "members"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([a * c.v[i] FOR a, i IN q.v]), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
