import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave.llm import components, near_dedup, shingles
from patchweave.llm.components import connected_components

DOCUMENTS = Path("/root/testdata/sf0.01/documents.parquet")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sets_of(pairs, width=4):
    out = defaultdict(list)
    for i, text in pairs:
        w = words(text)
        out[i].append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_force(pairs, width=4):
    """Smallest linked id of each document, by comparing all pairs that share a shingle."""
    sets, parent, holders = sets_of(pairs, width), {}, defaultdict(set)
    nodes = [(i, k) for i in sets for k in range(len(sets[i]))]

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, k in nodes:
        own = sets[i][k]
        for (j, m), n in Counter(h for s in own for h in holders[s]).items():
            if 100 * n >= 80 * (len(own) + len(sets[j][m]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own:
            holders[s].add((i, k))
    return {i: root(i) for i in sets}


def corpus(seed=5, groups=25, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Über", "ÉTÉ", "naïve"]
    shared, out = " ".join(rng.choices(vocabulary, k=60)), []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice((3, 6, 20, 80, 300)))
        if rng.random() < 0.4:
            base += shared.split()
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, len(base) // 20, len(base) // 8))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            joined = rng.choice((" ", "  ", "\n", "\t")).join(text)
            out.append(joined.upper() if rng.random() < 0.2 and joined.isascii() else joined)
    rng.shuffle(out)
    return list(enumerate(out))


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(docs_of):
    pairs = corpus()
    want, sets = brute_force(pairs), sets_of(pairs)
    assert result(near_dedup.near_duplicates(docs_of(pairs))) == {(i, len(sets[i][0]), want[i], want[i] == i) for i, _ in pairs}
    assert 1 < len(set(want.values())) < len(pairs)


def test_a_group_without_a_common_centre(docs_of):
    # a chain: neighbours are linked, the ends share little
    vocabulary = [f"v{k}" for k in range(900)]
    pairs = [(k, " ".join(vocabulary[8 * k : 8 * k + 203])) for k in range(40)]
    want = brute_force(pairs)
    assert set(want.values()) == {0}
    assert {r.component_id for r in near_dedup.near_duplicates(docs_of(pairs)).collect()} == {0}


def test_blocks_of_a_large_bucket(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    pairs = corpus(seed=8, groups=6, copies=25)
    want = brute_force(pairs)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs_of(pairs)).collect()} == set(want.items())


def test_rows_of_a_bucket_grow_with_it(docs_of, monkeypatch):
    """A family of texts that share half their shingles, so that most of them meet in every bucket: twice the texts, twice the rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "MOST_BLOCKS", 1)
    counts, dealt, opened = [], near_dedup._dealt, near_dedup._open
    monkeypatch.setattr(near_dedup, "_dealt", lambda df: counts.append(dealt(df).count()) or dealt(df))
    monkeypatch.setattr(near_dedup, "_open", lambda members, groups: counts.append(members.count()) or opened(members, groups))
    rows = {}
    for n in (150, 300):
        rng = random.Random(3)
        shared = " ".join(f"s{k}" for k in range(140))
        pairs = [(k, f"{shared} {' '.join(f'u{rng.random()}' for _ in range(60))}") for k in range(n)] + [(n + k, f"{shared} {' '.join(f'v{j}' for j in range(50 + k))}") for k in range(6)]
        counts.clear()
        got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs_of(pairs)).collect()}
        assert got == set(brute_force(pairs).items()) and len({c for _, c in got}) == n + 1
        assert len(counts) == 6  # the bands, and the keys of the large buckets
        rows[n] = sum(counts)
    assert rows[300] < 2.6 * rows[150]


@pytest.mark.skipif(not DOCUMENTS.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("width", [4, 5])
def test_recall_on_the_drivers_documents(spark, width):
    """No link is missed at the contract's width nor at that of the pipeline's stage."""
    docs = spark.read.parquet(str(DOCUMENTS))
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width).collect()} == want
    assert len(set(want.values())) < 0.95 * len(want)


def test_keys_of_a_level():
    """A key is equal just where its places of the sketches are."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (40, near_dedup.SIZE), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    at, factor = near_dedup._places(0, near_dedup.SIZE)
    same = near_dedup._level_keys(a, at, factor) == near_dedup._level_keys(b, at, factor)
    assert np.array_equal(same, (a[:, at] == b[:, at]).all(axis=2)) and same.any(axis=1).all() and not same.all()


def test_strangers_of_a_large_group(docs_of, monkeypatch):
    """Copies that all link to each other, and texts half like them: each stranger meets the whole group, whose own pairs are not formed."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, rows, dealt = random.Random(2), [], near_dedup._dealt
    monkeypatch.setattr(near_dedup, "_dealt", lambda df: rows.append((df.count(), dealt(df).count(), df.agg(F.max("strangers")).first()[0] or 0)) or dealt(df))
    shared = [f"s{k}" for k in range(200)]
    near = [(k, " ".join(shared[:195] + [f"a{k}"] + shared[195:])) for k in range(120)]
    far = [(500 + k, " ".join(shared[:150] + [f"b{k}-{j}" for j in range(60)])) for k in range(5)]
    chain = [(900 + k, " ".join(shared[12 * k :] + [f"c{j}" for j in range(12 * k)])) for k in range(8)]
    pairs = near + far + chain
    rng.shuffle(pairs)
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs_of(pairs)).collect()}
    want = brute_force(pairs)
    assert got == set(want.items()) and {want[900], want[901]} == {0} and want[500] == 500
    opened, cells, strangers = map(sum, zip(*rows, strict=True))
    assert strangers > 0 and cells < 4 * opened


def test_edge_cases(docs_of):
    long = " ".join(f"x{k % 5000}" for k in range(60_000))
    pairs = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " end"), (9, "a b c d e f"), (9, long), (None, "one two"), (None, None), (10, "\u00a0"), (11, "é" * 50_000)]
    got = result(near_dedup.near_duplicates(docs_of(pairs)))
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (10, 1, 10, True), (11, 1, 11, True)} <= got
    assert {(i, c) for i, _, c, _ in got if i in (7, 8, 9)} == {(7, 7), (8, 7), (9, 7)}
    assert {(n, c, k) for i, n, c, k in got if i is None} == {(1, None, True), (0, None, True)}
    assert near_dedup.near_duplicates(docs_of(pairs)).count() == len(pairs)
    assert near_dedup.near_duplicates(docs_of([])).collect() == []


def test_drop_keeps_one_of_each_group(docs_of):
    text = " ".join(f"t{k}" for k in range(50))
    docs = docs_of([(3, text), (1, text + " more"), (2, "other text of its own here"), (2, "other text of its own here"), (None, text), (4, None)])
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4]
    assert near_dedup.drop_near_duplicates(docs_of([])).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for similarity, n in ((0.8, 2000), (0.8, 60), (0.3, 500)):
        errors = []
        for _ in range(60):
            items = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            common = int(n * 2 * similarity / (1 + similarity))
            a, b = np.unique(items[:n]), np.unique(items[n - common : 2 * n - common])
            true = shingles.common(a, b) / len(np.union1d(a, b))
            errors.append(float((shingles.superminhash(a, 112) == shingles.superminhash(b, 112)).mean()) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.055


def test_signature_follows_its_definition():
    """Each item offers step j's rank at the position that its own permutation has at j."""
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 63, 7, dtype=np.uint64)
    size = 16
    want = [1 << 70] * size
    for item in items:
        order = list(range(size))
        for step in range(size):
            x = int(shingles.mix(np.array([item + shingles._STEP[step]]))[0])
            other = step + ((x & 0xFFFFFFFF) * (size - step) >> 32)
            order[step], order[other] = order[other], order[step]
            want[order[step]] = min(want[order[step]], (step << 32) + (x >> 32))
    assert shingles.superminhash(items, size).tolist() == want


@pytest.mark.parametrize("piece", [64, 1 << 21])
def test_word_hashes_do_not_depend_on_pieces(monkeypatch, piece):
    text = ("Alpha béta  gamma\n" * 40 + "x" * 20_000 + " end " + "y" * 300).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", piece)
    assert np.array_equal(shingles.word_hashes(text), whole)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == 6


@pytest.mark.parametrize("hot", [1_000, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_LINKS", hot)
    monkeypatch.setattr(components, "HOT_NODES", 10_000 if hot > 3 else 100)
    monkeypatch.setattr(components, "FOREST_NODES", 1 << 20 if hot > 3 else 10)
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)] + [(2000, 3000 + k) for k in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert {n: c for n, c in got.items() if n != c} == {n: root(n) for n in parent if root(n) != n}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [3, 1_000])
def test_plans_of_components_stay_small(spark, monkeypatch, hot):
    # the driver plans, and keeps, what a round has not written; its memory must not follow the stars
    scans, write = [], components.materialize

    def counted(df, label):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, label)

    monkeypatch.setattr(components, "materialize", counted)
    monkeypatch.setattr(components, "HOT_LINKS", hot)
    links = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 62
    assert max(scans) <= 12


def test_clashing_columns_change_nothing(docs_of):
    pairs = corpus(seed=3, groups=4)
    assert result(near_dedup.near_duplicates(docs_of(pairs))) == result(near_dedup.near_duplicates(docs_of(pairs, clash=False).withColumn("extra", F.lit(1))))
