import random

import duckdb
import pytest

from patchweave.llm import lexical_search as lexical


def by_sql(docs, benchmark, tmp_path):
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return sorted(con.sql(lexical.SQL).fetchall(), key=repr)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}{rng.choice(['', ',', '.', '-x', 'É'])}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    rng = random.Random(5)
    pairs = [(k, words(rng, rng.choice([1, 5, 40, 40, 300, 3000]))) for k in range(400)]
    copy = words(rng, 30)
    pairs += [(1000 + k, copy) for k in range(150)]  # a large group of copies, which ties
    pairs += [(None, copy), (None, "w1 w2"), (7, copy), (7, copy), (3000, None), (3001, ""), (3002, " \n.-"), (3003, "É é w1_w1 W1 x ٣ 漢字"), (3004, "W1 w1 " * 5000)]
    items = [(k, words(rng, rng.choice([2, 12, 40]))) for k in range(25)]
    items += [(100, copy), (101, None), (None, "w1"), (102, ""), (103, "nowhere"), (104, "W1 É w1"), (104, "w5"), (104, "w5"), (105, "漢字 ٣ é")]
    return docs_of(pairs), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")


def test_ranks_equal_the_sql(tables, tmp_path):
    docs, items = tables
    got = lexical.search(lexical.index_documents(docs), docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_sql(docs, items, tmp_path)


def test_small_blocks_wide_filters_and_parts_of_queries(tables, tmp_path, monkeypatch):
    docs, items = tables
    for name, value in (("SEEDS", 3), ("QUERY_BYTES", 2000), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(lexical, name, value)
    # filters of one bit for each entry exclude little, and the ranks are the same
    got = lexical.search(lexical.index_documents(docs, block=16, bits=1), docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_sql(docs, items, tmp_path)


def test_bounds_hold_and_exclude(tables):
    docs, _ = tables
    index = lexical.index_documents(docs)
    blocks = [r.asDict() for r in index.where("kind = 'block'").collect()]
    chunk = lexical.Queries([0], [[b"w1", b"w2", b"w9", b"w17"]], sum(r["n_docs"] for r in blocks), sum(r["n_terms"] for r in blocks), {b"w1": 70, b"w2": 800, b"w9": 3000, b"w17": 4000})
    hashes, own = lexical._own_terms(chunk)
    texts = {r.row_key: r.text for r in lexical._keyed(docs).collect()}
    loose = 0
    for row in blocks:
        for _, bounds in lexical._bounds(row, chunk, hashes, own):
            for key, bound in zip(lexical.np.frombuffer(row["keys"], lexical.np.int64).tolist(), bounds.tolist(), strict=True):
                occurs = lexical.Counter(lexical.terms_of(texts[key]))
                norm = 10 + 90 * occurs.total() * chunk.n_docs // chunk.n_terms
                score = sum(w * lexical._share(occurs[t], norm) for t, w in chunk.weight.items() if t in occurs)
                assert score <= bound
                loose += bound > 1.5 * score
    assert loose < 60


def test_nothing(spark, docs_of, tables):
    docs, items = tables
    empty = docs_of([])
    assert lexical.search(lexical.index_documents(empty), empty, items).count() == 0
    assert lexical.search(lexical.index_documents(docs), docs, items.limit(0)).count() == 0
    assert lexical.terms_of(None) == [] and lexical.terms_of("Ab-c_D9É") == [b"ab", b"c", b"d9\xc3\x89"]
