"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

1. Each text becomes a set of word shingles, a signature and a key for each band. Equal sets become one class.
2. In every bucket (classes that share a band key) each class is paired with two centres of the bucket. That is linear in
   the bucket's size. Pairs that the signatures cannot rule out are verified on the full sets, and links are grouped.
3. Buckets that then still hold several groups are open: there may be links between groups that miss both centres. Pairs within a
   group need no look: they cannot change it. So the classes outside the largest group of a bucket, its strangers, are compared with each
   other and with the largest group, in pairs of blocks. Up to MOST_BLOCKS blocks of strangers that is linear in the bucket.
   First the sketches alone say which classes have a possible partner; the texts of those only are fetched and compared on the full sets,
   and only links that join groups leave the task.
4. The classes of open buckets with more strangers get keys of more places of the sketch (LEVELS), so that the buckets fall apart, and
   steps 2 and 3 are repeated on these. What has more strangers even then is dealt out in pairs of blocks all the same, as sketches and
   without texts, so that no link is left out there either.

So the many pairs of a large group of copies are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.llm import shingles
from patchweave.llm.common import bounded_batches, discard, fresh, materialize, table
from patchweave.llm.components import connected_components

#: Signature length, bands, and the percentage of the union that a link must share.
SIZE, BANDS, PERCENT = 112, 28, 80
#: Signatures that agree in fewer places than this share rule a pair out: at a similarity of 0.8 that is 5 deviations off.
RULED_OUT = 0.6
#: Classes of a bucket that one task compares at a time, and ids that are broadcast at most.
BLOCK, BROADCAST_IDS = 512, 1_000_000
#: Blocks of strangers that a bucket is searched in at most before its classes get longer keys; so a class is dealt to so many blocks.
MOST_BLOCKS = 16
#: (places of a key, keys) for the classes of larger open buckets: a pair of similarity 0.8 shares none of the 256 keys with a
#: probability of 5e-7, and a given key of two texts of similarity 0.5 is equal with one of 0.004, against 0.06 for a band.
LEVELS = ((8, 256),)
#: Bytes of shingle sets that a comparing task remembers.
SET_BYTES = 256 << 20

_FEATURES = "doc_id long, n_shingles long, set_hash binary, sketch binary, bands array<long>"


def _features(width: int, size: int, bands: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, sketches, keys, offsets = [], [], [], [], [0]
            for text in batch["text"]:
                items = shingles.shingle_set((text.as_py() or "").encode(), width)
                counts.append(len(items))
                if len(items):
                    signature = shingles.superminhash(items, size)
                    hashes.append(shingles.blake2b(items.tobytes(), digest_size=16).digest())
                    sketches.append((signature & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    keys.append(shingles.band_keys(signature, bands))
                else:
                    hashes.append(None)
                    sketches.append(None)
                offsets.append(offsets[-1] + (bands if len(items) else 0))
            flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sketches, pa.binary()), lists], names=["doc_id", "n_shingles", "set_hash", "sketch", "bands"])

    return made


def _sketches(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _agreeing(size: int):
    """Keeps the pairs whose sketches agree often enough."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_sketches(batch["sketch_a"], size) == _sketches(batch["sketch_b"], size)).sum(axis=1) >= RULED_OUT * size
                yield pa.RecordBatch.from_arrays([pc.filter(batch[c], pa.array(same)) for c in ("a", "b")], names=["a", "b"])

    return kept


def _linked(width: int, percent: int):
    """Keeps the pairs whose full sets share enough. Rows come grouped by ``b``, whose set is made once."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, items_b = None, None
        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(*(batch[c] for c in ("a", "b", "text_a", "text_b")), strict=True):
                raw = text_b.as_py().encode()
                if raw != last:
                    last, items_b = raw, shingles.shingle_set(raw, width)
                items_a = shingles.shingle_set(text_a.as_py().encode(), width)
                shared = shingles.common(items_a, items_b)
                if 100 * shared >= percent * (len(items_a) + len(items_b) - shared):
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return kept


@lru_cache(maxsize=8)
def _places(level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the sketch that each key of a level takes, (keys, places), and an odd factor for each."""
    places, keys = LEVELS[level]
    rng = np.random.default_rng(1_000 + level)
    at = np.array([rng.permutation(size)[:places] for _ in range(keys)])
    return at, rng.integers(1, 1 << 62, at.shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _level_keys(sketch: np.ndarray, at: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The keys of a level for each row of sketches, as signed integers."""
    keys = np.empty((len(sketch), len(at)), np.uint64)
    for k in range(0, len(sketch), 64):  # some rows at a time, so that memory does not follow rows times places
        keys[k : k + 64] = ((sketch[k : k + 64][:, at].astype(np.uint64) + np.uint64(1)) * factor).sum(axis=2)
    return shingles.mix(keys + np.arange(len(at), dtype=np.uint64)).view(np.int64)


def _keyed(level: int, size: int):
    """(bucket, rep, n_shingles) for each key of a level of each class."""
    at, factor = _places(level, size)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                keys = _level_keys(_sketches(part["sketch"], size), at, factor)
                row = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part["rep"].take(row), part["n_shingles"].take(row)], names=["bucket", "rep", "n_shingles"])

    return made


def _partners(group: pa.Table, label: np.ndarray, percent: int, size: int, level: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, possible partners of i) within a block, or between two blocks, of a bucket.

    ``label`` says which group each row belongs to; the caller may join groups meanwhile. A pair that shares several buckets
    counts in the first of them. Sizes, sketches and groups rule pairs out.
    """
    n, bucket, sketch = group["n_shingles"].to_numpy(), group["bucket"][0].as_py(), _sketches(group["sketch"].combine_chunks(), size)
    bands = np.array(group["bands"].to_pylist(), np.int64) if level is None else _level_keys(sketch, *_places(level, size))
    part, left, right = group["part"].to_numpy(), group["left"][0].as_py(), group["right"][0].as_py()
    rows, cols = np.flatnonzero(part == left), np.flatnonzero(part == right)
    for i in rows:
        at = cols[cols > i] if left == right else cols
        at = at[(label[at] != label[i]) & (100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))]
        at = at[(sketch[at] == sketch[i]).sum(axis=1) >= RULED_OUT * size]
        if len(at):
            at = at[bands[i][(bands[at] == bands[i]).argmax(axis=1)] == bucket]
        if len(at):
            yield i, at


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    names = {c: k for k, c in enumerate(dict.fromkeys(values))}
    return np.array([names[c] for c in values])


def _promising(percent: int, size: int, level: int | None):
    """The classes of a block that have a possible partner in another group, from sketches alone."""
    def found(group: pa.Table) -> pa.Table:
        some = np.zeros(group.num_rows, bool)
        for i, at in _partners(group, _numbered(group["component"]), percent, size, level):
            some[i] = some[at] = True
        return group.select(["bucket", "left", "right", "rep"]).filter(pa.array(some))

    return found


def _across(width: int, percent: int, size: int, level: int | None):
    """Links between different groups within a block, or between two blocks: as many as join the groups, at most.

    What is already joined rules pairs out; the others are compared on their full sets, so only links leave the task and never the
    pairs. The sets of SET_BYTES are remembered.
    """
    def found(group: pa.Table) -> pa.Table:
        ids, n, texts = group["rep"].to_pylist(), group["n_shingles"].to_numpy(), group["text"]
        label, sets, held, out = _numbered(group["component"]), {}, 0, []

        def items(k: int) -> np.ndarray:
            nonlocal held
            if k not in sets:
                made = shingles.shingle_set(texts[k].as_py().encode(), width)
                if held + made.nbytes > SET_BYTES:
                    sets.clear()
                    held = 0
                sets[k], held = made, held + made.nbytes
            return sets[k]

        for i, at in _partners(group, label, percent, size, level):
            mine = items(i)
            for j in at:
                if label[i] != label[j]:
                    shared = shingles.common(mine, items(j))
                    if 100 * shared >= percent * (n[j] + n[i] - shared):
                        label[label == label[j]] = label[i]
                        out.append((ids[i], ids[j]))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return found


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents named, written once: by a broadcast of the ids if they are few, else by a join."""
    n = ids.count()
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    named = docs.where(F.col("text").isNotNull()).join(ids, docs["doc_id"] == ids["id"], "left_semi")
    return materialize(named.select(F.col("doc_id").alias("id"), "text"), "texts")


def _verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. The text of ``a`` moves with the pair to its ``b``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = _texts_of(docs, ids)
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_linked(width, percent), "a long, b long"), "links")


def _open(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(bucket, rep, n_shingles, component, n, main, strangers, lo, hi) of the buckets of members (bucket, rep, n_shingles) that hold
    several groups.

    ``lo`` and ``hi`` are centres of different groups; ``n`` counts the classes of the bucket, ``main`` is the bucket's largest group, and
    ``strangers`` counts the classes outside it.
    """
    if groups is None:
        labelled = members.withColumn("component", F.col("rep"))
    else:
        labelled = members.join(groups, members["rep"] == groups["node"], "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    m = F.struct(F.xxhash64("component").alias("group"), F.xxhash64("rep").alias("rank"), "component", "rep", "n_shingles")
    if groups is None:  # each class is a group of its own
        buckets = labelled.groupBy("bucket").agg(F.min(m).alias("lo"), F.max(m).alias("hi"), F.count("*").alias("n")).where("n > 1")
        buckets = buckets.select("bucket", "lo", "hi", "n", F.col("lo.component").alias("main"), (F.col("n") - 1).alias("strangers"))
    else:
        sizes = labelled.groupBy("bucket", "component").agg(F.min(m).alias("lo"), F.max(m).alias("hi"), F.count("*").alias("n"))
        largest = F.max(F.struct("n", (-F.col("component")).alias("less")))
        buckets = sizes.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), largest.alias("largest")).where("lo.component != hi.component")
        buckets = buckets.select("bucket", "lo", "hi", "n", (-F.col("largest.less")).alias("main"), (F.col("n") - F.col("largest.n")).alias("strangers"))
    return labelled.join(buckets, "bucket").select("bucket", "rep", "n_shingles", "component", "n", "main", "strangers", "lo", "hi")


def _centre_pairs(opened: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the centres of its buckets that are of another group and near in size."""
    pairs = opened.select("rep", "n_shingles", "component", F.explode(F.array("lo", "hi")).alias("c"))
    near = F.least("n_shingles", "c.n_shingles") * 100 >= F.greatest("n_shingles", "c.n_shingles") * percent
    pairs = pairs.where((F.col("component") != F.col("c.component")) & near)
    return pairs.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()


def _likely(classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs that the sketches do not rule out."""
    sketches = classes.select("rep", "sketch")
    drawn = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return materialize(drawn.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreeing(size), "a long, b long"), "likely")


def _dealt(opened: DataFrame) -> DataFrame:
    """(bucket, rep, component, part, left, right): the classes of a bucket in blocks, and the pairs of blocks that each is dealt to.

    Blocks of strangers meet themselves, each other and the blocks of the largest group, which are numbered after them. A bucket
    of at most BLOCK classes is one block.
    """
    whole = F.col("n") <= BLOCK
    outer = F.when(whole, 1).otherwise(F.ceil(F.col("strangers") / BLOCK)).cast("long")
    inner = F.when(whole, 0).otherwise(F.ceil((F.col("n") - F.col("strangers")) / BLOCK)).cast("long")
    place, inside = F.xxhash64("rep", "bucket"), ~whole & (F.col("component") == F.col("main"))
    blocks = opened.select("bucket", "rep", "component", outer.alias("outer"), inner.alias("inner"), inside.alias("inside"), place.alias("place"))
    blocks = blocks.select("bucket", "rep", "component", "outer", "inner", "inside", F.when(F.col("inside"), F.col("outer") + F.pmod("place", F.greatest("inner", F.lit(1)))).otherwise(F.pmod("place", "outer")).alias("part"))
    # a stranger goes to all blocks, one of the largest group to the strangers' blocks
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    return blocks.select("*", F.explode(others).alias("k")).select(
        "bucket", "rep", "component", "part", F.least("part", "k").alias("left"), F.greatest("part", "k").alias("right"))


def _search(docs: DataFrame, classes: DataFrame, opened: DataFrame, level: int | None, width: int, percent: int, size: int) -> DataFrame:
    """(a, b): links that join groups within the buckets of ``opened``. Texts are fetched for classes with a possible partner only."""
    key = ["bucket", "left", "right"]
    drawn = _dealt(opened).join(classes.select("rep", "n_shingles", "sketch", *(["bands"] if level is None else [])), "rep")
    likely = drawn.groupBy(*key).applyInArrow(_promising(percent, size, level), "bucket long, left long, right long, rep long")
    # written, so that no task runs two Python workers at a time
    likely = materialize(likely, "promising")
    texts = _texts_of(docs, likely.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
    full = drawn.join(likely, [*key, "rep"]).join(texts, "rep")
    return materialize(full.groupBy(*key).applyInArrow(_across(width, percent, size, level), "a long, b long"), "across")


def near_duplicates(docs: DataFrame, width: int = shingles.SHINGLE, percent: int = PERCENT, size: int = SIZE, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text; others are ignored).

    Documents are linked if they share ``percent`` of the union of their shingle sets; component_id is the smallest doc_id
    reachable. A null text, or one without words, has no shingles and no links. Repeated rows share their doc_id and so their
    component. A doc_id with several texts joins their groups. A row of null doc_id takes part in no link; its component_id is
    null and it is kept. An empty table gives no rows.
    """
    feats = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features(width, size, bands), _FEATURES), "features")
    named = feats.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialize(named.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "bands")).alias("c")).select(
        "set_hash", F.col("c.doc_id").alias("rep"), "c.n_shingles", "c.sketch", "c.bands"), "classes")
    # a doc_id that names several classes joins them
    links = named.join(classes.select("set_hash", "rep"), "set_hash").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    members, groups, level = classes.select(F.explode("bands").alias("bucket"), "rep", "n_shingles"), None, None
    found: DataFrame | None = None
    while True:
        opened = materialize(_open(members, groups), "open")
        more = _verify(docs, _likely(classes, _centre_pairs(opened, percent), size), width, percent)
        found = more if found is None else found.unionByName(more)
        groups = materialize(connected_components(found), "groups")
        left = materialize(_open(opened.select("bucket", "rep", "n_shingles"), groups), "left")
        discard(opened)
        following = 0 if level is None else level + 1
        last = following == len(LEVELS)
        found = found.unionByName(_search(docs, classes, left if last else left.where(F.col("strangers") <= MOST_BLOCKS * BLOCK), level, width, percent, size))
        large = left.where(F.col("strangers") > MOST_BLOCKS * BLOCK).select("rep").distinct()
        if last or large.isEmpty():
            break
        groups, level = materialize(connected_components(found), "groups"), following
        members = materialize(classes.join(large, "rep", "left_semi").select("rep", "n_shingles", "sketch").mapInArrow(_keyed(level, size), "bucket long, rep long, n_shingles long"), "keys")

    final = connected_components(found.unionByName(links))
    out = feats.select("doc_id", "n_shingles").join(final, feats["doc_id"] == final["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = shingles.SHINGLE + 1, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with their columns, of one document of each group: the one with the smallest doc_id.

    Of several rows of a kept doc_id the smallest one stays. Rows of null doc_id all stay.
    """
    found = near_duplicates(docs, width, percent).where(F.col("doc_id").isNotNull())
    judged = materialize(found.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")), "judged")
    gone, again = fresh(docs.columns, "gone", "again")
    marks = judged.where(~F.col("kept") | (F.col("rows") > 1)).select(F.col("doc_id").alias("id"), (~F.col("kept")).alias(gone), (F.col("rows") > 1).alias(again))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    left = docs.join(marks, F.col("doc_id") == F.col("id"), "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = left.where(F.col(again).isNull()).select(*columns)
    row = fresh(docs.columns, "row")[0]
    several = left.where(F.col(again)).groupBy("doc_id").agg(F.min(F.struct(*columns)).alias(row)).select(*(F.col(row)[c].alias(c) for c in docs.columns))
    return once.unionByName(several)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM words
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN both_ways l ON l.x = r.y
), least AS (
  SELECT x, min(y) AS component_id FROM reached GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN least ON x = doc_id
"""
