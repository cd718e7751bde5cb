import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest

from patchweave.llm import language_id as l

DOCUMENTS = Path("/root/testdata/sf0.01/documents.parquet")
WORDS = {"en": "the and of that with have this from they would there their what about which".split(), "de": "der die und nicht mit sich auf für eine werden auch über können müssen schön".split(), "fr": "le la les des être avoir pour dans que qui une très où même après".split()}


def texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, " ".join(rng.choice(WORDS[lang], 40)), lang) for k, lang in ((i, list(WORDS)[i % 3]) for i in range(n))]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "p", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_accuracy_on_held_out_rows(spark):
    rows = texts(300)
    df = docs(spark, rows)
    model = l.fit_model(df.where(~l.held_out()))
    got = {r.doc_id: r for r in l.identify_languages(df, model).collect()}
    asked = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(asked) > 50 and sum(got[k].lang_pred == lang for k, lang in asked) / len(asked) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in df.where(l.held_out()).collect()} == {k for k, _ in asked}


def test_mixtures_are_recovered(spark):
    model = l.fit_model(docs(spark, texts(300)))
    rng = np.random.default_rng(5)
    both = " ".join([*rng.choice(WORDS["en"], 120), *rng.choice(WORDS["fr"], 60)])
    lang, score, shares = l.languages_of(model, both)
    assert lang == "en" and set(shares) == {"en", "fr"} and 0.5 < shares["en"] < 0.8
    assert set(l.languages_of(model, " ".join(rng.choice(WORDS["de"], 100)))[2]) == {"de"}


def test_mixture_against_a_grid():
    """EM finds the proportions that a search of all of them finds."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        likelihood, counts = rng.random((60, 3)) ** 3 + 0.01, rng.integers(1, 9, 60)
        grid = np.array([(a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)])
        value = counts @ np.log(likelihood @ grid.T)
        share, reached = l.mixture(likelihood, counts, rounds=3000)
        assert reached >= value.max() - 1e-2 and np.abs(share - grid[value.argmax()]).max() < 0.03


def test_chosen_sets_against_all_subsets(spark):
    """No set of languages has a higher penalised likelihood than the one chosen; the score is the language's part of it."""
    model = l.fit_model(docs(spark, texts(300)))
    rng = np.random.default_rng(7)
    for _ in range(60):
        parts = {lang: int(rng.choice((0, 0, 30, 90))) for lang in WORDS}
        text = " ".join(w for lang, n in parts.items() for w in rng.choice(WORDS[lang], n))
        if not text:
            continue
        bucket, counts = l.gram_counts(text)
        likelihood, cost = model.probability[bucket], l.PENALTY * 0.5 * np.log(max(2, counts.sum()))
        value = lambda chosen: l.mixture(likelihood[:, list(chosen)], counts, rounds=500)[1] - cost * len(chosen)
        best = max((s for n in (1, 2, 3) for s in itertools.combinations(range(3), n)), key=value)
        lang, score, shares = l.languages_of(model, text)
        assert set(shares) == {model.languages[k] for k in best} == {lang for lang, n in parts.items() if n}
        assert score == shares[lang] == max(shares.values()) and abs(sum(shares.values()) - 1) < 1e-6


def test_rare_languages_are_learned(spark):
    """A share of the sample for each language: one row in a thousand is enough, and the bound holds."""
    rows = [(k, " ".join(np.random.default_rng(k).choice(WORDS["fr" if k % 997 == 5 else "en"], 30)), "fr" if k % 997 == 5 else "en") for k in range(2000)]
    model = l.fit_model(docs(spark, rows), sample_rows=20)
    assert model.languages == ["en", "fr"]
    assert [l.languages_of(model, " ".join(WORDS[x]))[0] for x in ("en", "fr")] == ["en", "fr"]
    with pytest.raises(ValueError):
        l.fit_model(docs(spark, rows), sample_rows=1)


@pytest.mark.skipif(not DOCUMENTS.exists(), reason="the driver's tables are not here")
def test_accuracy_on_the_drivers_documents(spark):
    df = spark.read.parquet(str(DOCUMENTS))
    model = l.fit_model(df.where(~l.held_out()))
    asked = l.identify_languages(df.where(l.held_out()), model).join(df.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred != 'und'")
    right, total = asked.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert total > 250 and right / total > 0.98


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    likelihood, counts = rng.random((200, 3)) + 0.01, rng.integers(1, 9, 200)
    seen = [l.mixture(likelihood, counts, rounds=k)[1] for k in (1, 2, 4, 8, 12)]
    assert seen == sorted(seen)


def test_edge_cases(spark):
    rows = [*texts(30), (90, None, "en"), (91, "", "de"), (92, "123 !? \n", "en"), (None, "the and of", "en"), (93, "the and of", None), (0, "the and", "en"), (94, "ünïçødé 漢字", "en"), (95, "der die und " * 40_000, None)]
    df = docs(spark, rows)
    model = l.fit_model(df)
    got = l.identify_languages(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[k].lang_pred, by[k].score) for k in (90, 91, 92)] == [("und", 0.0)] * 3
    assert by[95].lang_pred == "de" and by[94].lang_pred in WORDS
    empty = l.fit_model(df.limit(0))
    assert {(r.lang_pred, r.score) for r in l.identify_languages(df, empty).collect()} == {("und", 0.0)}
    assert l.identify_languages(df.limit(0), model).count() == 0


def test_labels_are_no_input(spark):
    rows = texts(60)
    model = l.fit_model(docs(spark, rows))
    shuffled = docs(spark, [(k, t, "xx") for k, t, _ in rows])
    assert [tuple(r) for r in l.identify_languages(shuffled, model).collect()] == [tuple(r) for r in l.identify_languages(docs(spark, rows), model).collect()]


def test_every_language_is_kept(spark):
    """More languages than 200, each with words of its own letters; the shortest text is learned as well."""
    word = lambda k: "".join(chr(0x4E00 + 3 * k + j) for j in (0, 1, 2, 1, 0))
    rows = [(k, f"{word(k)} " * (3 if k == 17 else 6), f"l{k:03}") for k in range(230)]
    model = l.fit_model(docs(spark, rows))
    assert model.languages == [r[2] for r in rows]
    assert [l.languages_of(model, f"{word(k)} {word(k)}" * 4)[0] for k in (0, 17, 229)] == ["l000", "l017", "l229"]
