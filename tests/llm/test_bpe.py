import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patchweave.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello, world! it's 2024", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endof", "é😀漢字 \u00a0\u2003\x1c\x85", "\n\n  \t x  ", "a" * 5000, "ab" * 30_000, "don't 'S 'LL we'll", "١٢٣ Ⅳ ½", "the " * 2000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.BytePairEncoder(file.read())


def test_ids_equal_the_library(library, encoder):
    rng = random.Random(1)
    alphabet = [*map(chr, range(0, 0x250)), *"漢字😀\u0301\u200b\u2028\u3000\ufeff", "<|endoftext|>", "'s", "'ll", " the", "ing"]
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text in [t or "" for t in TEXTS] + noise:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, repr(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_incomplete_characters_decode_alike(library, encoder):
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(256) for _ in range(rng.randint(1, 12))]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_of_pieces_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    encoder.known.clear()
    text = " ".join(f"w{k}" for k in range(100)) + "z" * 1000
    assert encoder.decode(encoder.encode(text)) == text and len(encoder.known) <= 10


def test_frames(docs_of, library):
    pairs = [*enumerate(TEXTS), (None, "x"), (0, None), (1, "")]
    docs = docs_of(pairs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert [tuple(r) for r in bpe.token_digests(docs).collect()] == want
    encoded = bpe.encode_documents(docs)
    assert encoded.columns == [*docs.columns, "_ids"] and [len(r["_ids"]) for r in encoded.collect()] == [w[1] for w in want]
    assert [r.decoded for r in bpe.decode_documents(encoded, ids_col="_ids").collect()] == [t or "" for _, t in pairs]
    assert bpe.token_digests(docs_of([])).count() == 0 and bpe.encode_documents(docs_of([])).count() == 0


def test_histogram_against_brute_force(docs_of, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    pairs = [*enumerate(TEXTS), *((100 + k, "word " * (k % 40)) for k in range(120)), (None, "a b")]
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in pairs]
    found = token_counts.length_histogram(token_counts.encoded_lengths(docs_of(pairs)))
    for r in found.collect():
        n = r.n_tokens
        assert (r.n_docs, r.tokens) == (lengths.count(n), n * lengths.count(n))
        assert (r.docs_at_most, r.docs_at_least) == (sum(x <= n for x in lengths), sum(x >= n for x in lengths))
        assert (r.tokens_at_least, r.truncated_tokens) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
        assert r.quantile == r.docs_at_most / len(lengths)
    assert {r.n_tokens for r in found.collect()} == set(lengths)
    limits = [0, 1, 7, 77, 10**6]
    got = {r.context_limit: (r.truncated_tokens, r.n_truncated) for r in token_counts.truncated_total(found, limits).collect()}
    assert got == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in limits}
    median = sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.length_quantile(found, 0.5).first().n_tokens == median


def test_histogram_of_nothing(docs_of):
    found = token_counts.length_histogram(token_counts.encoded_lengths(docs_of([])))
    assert found.count() == 0
    assert [tuple(r) for r in token_counts.truncated_total(found, [5]).collect()] == [(5, 0, 0)]
    assert token_counts.length_quantile(found, 0.5).first().n_tokens is None


def test_many_limits(spark, monkeypatch):
    """Ten thousand limits against a histogram with gaps of several blocks, nulls and repeats among them."""
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    rng = random.Random(6)
    lengths = [rng.choice([rng.randrange(300), rng.randrange(3000, 3100), 0]) for _ in range(2000)] + [9000]
    found = token_counts.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    limits = [*range(0, 9900), 10**9, 128, 128]
    table = spark.createDataFrame([(n, "x") for n in [*limits, None]], "context_limit long, sums string")
    got = {r.context_limit: (r.truncated_tokens, r.n_truncated) for r in token_counts.truncated_total(found, table).collect()}
    assert len(got) == 9901
    for n in rng.sample(sorted(got), 300) + [10**9, 0, 299, 300, 3099, 3100, 8999, 9000]:
        assert got[n] == (sum(min(x, n) for x in lengths), sum(x > n for x in lengths))
