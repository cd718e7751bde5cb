"""Language identification as mixture inference: EM over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.common import bounded_batches, table

#: Hash buckets of letter trigrams, most rounds of EM, and the weight of a further language in units of BIC.
BUCKETS, ROUNDS, PENALTY = 1 << 14, 12, 4.0
#: A model is learned from at most so many documents, shared equally between the languages: those with the smallest hash of their id.
SAMPLE_ROWS = 6_000
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    #: probability of each bucket in each language, (BUCKETS, languages)
    probability: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the trigrams around each letter of the lower-cased text; what is no letter counts as one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    mixed = (points[:-2] * 0x9E3779B1 + points[1:-1] * 0x85EBCA77 + points[2:] * 0xC2B2AE3D)[letter[1:-1]]
    counts = np.bincount(((mixed ^ (mixed >> 15)) * 0x2545F491 >> 13) & (BUCKETS - 1), minlength=BUCKETS)
    bucket = np.flatnonzero(counts)
    return bucket, counts[bucket]


def mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Language proportions that maximise the likelihood, and its logarithm."""
    total, share = counts.sum(), np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(rounds):
        seen = likelihood @ share
        new = share * ((counts / seen) @ likelihood) / total
        settled = np.abs(new - share).max() < 1e-4
        share = new
        if settled:
            break
    return share, float(counts @ np.log(likelihood @ share))


def languages_of(model: Model, text: str | None) -> tuple[str, float, dict[str, float]]:
    """(most probable language, its proportion, the proportions of the languages chosen).

    The set of languages starts from the best single one. Others join in the order of their share of the unrestricted mixture,
    if the penalised likelihood of the enlarged set is higher.
    """
    if not text or not model.languages:
        return UNKNOWN, 0.0, {}
    bucket, counts = gram_counts(text)
    if not len(bucket):
        return UNKNOWN, 0.0, {}
    likelihood = model.probability[bucket]
    share, _ = mixture(likelihood, counts)
    order = np.argsort(-share, kind="stable")
    cost = PENALTY * 0.5 * np.log(max(2, counts.sum()))
    alone = counts @ np.log(likelihood)
    first = int(np.argmax(alone))
    chosen, proportions, best = [first], np.ones(1), float(alone[first]) - cost
    for k in order:
        if k == first or share[k] < 0.02:
            continue
        tried, reached = mixture(likelihood[:, [*chosen, k]], counts)
        if reached - cost * (len(chosen) + 1) <= best:
            continue
        chosen, proportions, best = [*chosen, int(k)], tried, reached - cost * (len(chosen) + 1)
    top = int(np.argmax(proportions))
    found = {model.languages[c]: float(p) for c, p in zip(chosen, proportions, strict=True)}
    return model.languages[chosen[top]], float(min(1.0, max(0.0, proportions[top]))), found


def fit_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the rows of ``docs`` with a language and a text: trigram counts by language, smoothed.

    Rows of null id, language or text are left out. No rows give a model without languages. Each language gets an equal share of
    ``sample_rows``, so a rare one is learned as well; the share is the rows with the smallest hash of their id. A repeated
    row counts as often as it occurs. More languages than ``sample_rows`` raise a ValueError; a language takes 128 KB of the model.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = sizes.count()
    if n_languages > sample_rows:
        raise ValueError(f"{n_languages} languages, but a sample of {sample_rows} rows")
    share = sample_rows // max(1, n_languages)
    # the hash leaves about twice the share of each language to be ranked, so no task gets all rows of a frequent one
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(1 << 31)
    # sample_rows sizes at most
    near = known.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("n") < 2 * share + 50).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= share).select("doc_id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                bucket, counts = gram_counts(text.as_py())
                sums[lang][bucket] += counts
        for lang, counts in sums.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(counts[bucket], pa.int64())], names=["lang", "bucket", "n"])

    # sample_rows rows at most
    grams = known.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    summed = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["bucket"], np.searchsorted(languages, rows["lang"]) if languages else []] = rows["n"]
    counts += 0.1
    if languages:
        counts /= counts.sum(axis=0, keepdims=True)
    return Model(languages, counts)


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) from the text alone, one row for each input row.

    A null text and one without a letter are ``und`` with score 0. ``mixture`` lists the chosen languages as name:percent.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [languages_of(known.value, t.as_py()) for t in batch["text"]]
            shown = [",".join(f"{k}:{100 * v:.0f}" for k, v in sorted(m.items(), key=lambda x: (-x[1], x[0]))) for _, _, m in out]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array(shown, pa.string())], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, mixture string")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_model(docs.where(~held_out()))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
