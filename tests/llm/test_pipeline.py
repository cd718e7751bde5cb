import importlib
import sys

import pytest

import corpus_pipeline
from patchweave.llm import bpe, near_dedup, pii, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, folder = [("documents", docs)], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append((name, docs))
    return out


def test_columns(stages):
    first = stages[0][1].columns
    assert all(df.columns == first for _, df in stages[1:-1]) and stages[-1][1].columns == ["doc_id", "lang", "source", "ids"]


def test_quality_keeps_good_and_drops_base_failures(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = stages[0][1].collect(), {r.doc_id for r in stages[1][1].collect()}
    for r in before:
        s = quality_rules.text_stats(r.text)
        if s[0] < 10 or 100 * s[4] > 20 * s[0]:
            assert r.doc_id not in after
        elif labels.get(r.doc_id) is not None:
            assert (r.doc_id in after) == bool(labels[r.doc_id])


def test_one_of_each_group_stays(spark, stages):
    from tests.llm.test_near_dedup import brute_force

    pairs = [(r.doc_id, r.text) for r in stages[1][1].collect()]
    want = brute_force(pairs, width=near_dedup.shingles.SHINGLE + 1)
    assert {r.doc_id for r in stages[2][1].collect()} == {i for i, c in want.items() if i == c}


def test_contaminated_documents_go(spark, stages):
    from tests.llm.test_decontaminate import brute_words

    items = [" ".join(brute_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[2][1].collect(), {r.doc_id for r in stages[3][1].collect()}
    for r in before:
        text = " ".join(brute_words(r.text))
        assert (r.doc_id in after) == (not any(i in text for i in items))


def test_personal_data_goes_and_tokens_decode(stages):
    before = {r.doc_id: r.text for r in stages[3][1].collect()}
    after = {r.doc_id: r.text for r in stages[4][1].collect()}
    assert after == {i: pii.redact(t, pii.find_spans(t)) for i, t in before.items()} and not any(pii.find_spans(t) for t in after.values())
    with open(bpe.public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = bpe.BytePairEncoder(file.read())
    assert {r.doc_id: encoder.decode(r.ids) for r in stages[5][1].collect()} == after


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "ids").collect())) == sorted(map(tuple, stages[-1][1].select("doc_id", "ids").collect()))


def test_entry_point_without_the_subpackage(monkeypatch):
    import __spark_entry__

    full = set(__spark_entry__.queries())
    assert {"pipeline", "op1_near_dedup", "op10_decontamination"} <= full
    for name in [m for m in sys.modules if m.startswith(("patchweave.llm", "corpus_pipeline"))]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "patchweave.llm.queries", None)
    rest = set(importlib.reload(__spark_entry__).queries())
    assert rest and not any(q.startswith("op") or q == "pipeline" for q in rest) and rest < full
