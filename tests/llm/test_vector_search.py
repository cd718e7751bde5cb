import random

import duckdb
import numpy as np
import pytest

from patchweave.llm import vector_search as vectors


def by_sql(df, tmp_path):
    df.write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return sorted(con.sql(vectors.SQL).fetchall())


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.125) for _ in range(24)] for _ in range(5)]
    rows = [(k, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)]) for k in range(1500)]
    common = rows[0][1]
    rows += [(5000 + k, common) for k in range(400)]  # a very common vector, which ties
    odd = [None, [], [0.1] * 5, [0.1, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [-float("inf"), *[0.0] * 23], [0.0] * 24, [-0.5] * 24, [0.3] * 24]
    rows += [(6000 + 50 * k, v) for k, v in enumerate(odd)] + [(7000 + k, v) for k, v in enumerate(odd)]
    rows += [(100, [0.2] * 24), (100, [0.2] * 24), (101, rows[7][1]), (None, common), *rows[:30]]
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")


def found(df, **layout):
    return sorted(tuple(r) for r in vectors.top_k(df, df.where("vec_id % 50 = 0"), **layout).collect())


def test_ranks_equal_the_sql(embeddings, tmp_path):
    assert found(embeddings) == by_sql(embeddings, tmp_path)


def test_small_blocks_samples_and_parts(embeddings, tmp_path, monkeypatch):
    for name, value in (("SAMPLE", 6), ("QUERY_BYTES", 2000)):
        monkeypatch.setattr(vectors, name, value)
    assert found(embeddings, block=100, segments=4, few=0) == by_sql(embeddings, tmp_path)


def test_few_and_no_vectors(spark, embeddings, tmp_path):
    few = embeddings.where("vec_id IN (0, 50, 51)")
    assert found(few) == by_sql(few, tmp_path) and len(found(few)) == 4
    assert found(embeddings.limit(0)) == [] and vectors.top_k(embeddings, embeddings.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    large = spark.createDataFrame([(0, [1.0, 1.0]), (1, [3.0, 2.0**40]), (2, [-(2.0**30), 5.0])], "vec_id long, embedding array<double>")
    query = spark.createDataFrame([(0, [64.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.top_k(large, query).orderBy("rank").collect()] == [(0, 1, 1, 256 * 256 * (192 + 2**40)), (0, 2, 2, 256 * 256 * (5 - 2**36))]


def test_members_are_proved_and_few():
    rng = np.random.default_rng(4)
    data = np.floor(256 * rng.normal(0, 0.125, (4096, 64))).astype(np.int64)
    _, _, width, segments, postings, high, low = vectors._block(np.arange(4096), data, vectors.SEGMENTS)
    postings = np.frombuffer(postings, np.uint16).reshape(width, segments, -1)
    high, low = (np.frombuffer(x, np.int64).reshape(width, segments).astype(float) for x in (high, low))
    left = 0
    for query in data[:40]:
        scores = data @ query
        least = int(np.sort(scores)[-6])
        at = vectors.possible_members(postings, high, low, 4096, query.astype(float), least, vectors.FEW)
        assert set(np.flatnonzero(scores >= least)) <= set(at)
        left += len(at)
    assert left < 40 * 128  # of 4096 each
