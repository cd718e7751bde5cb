"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list, and its inverse."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchweave.llm.common import bounded_batches, fresh, table

#: Fixed value: how byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers during a task. Longer pieces are not remembered, so memory stays bounded.
CACHED_PIECES, CACHED_LENGTH = 200_000, 64


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: the printable ones as themselves, others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class BytePairEncoder:
    """Encodes and decodes with the vocabulary of a ``tokenizers`` JSON file."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        vocab, as_byte = spec["model"]["vocab"], printable_bytes()
        as_char = {b: c for c, b in as_byte.items()}
        self.byte_ids = [vocab[as_char[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.words = {i: bytes(as_byte[c] for c in w) for w, i in vocab.items()} | {i: w.encode() for w, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: str) -> tuple[int, ...]:
        """Applies the lowest rank first, the leftmost of equal ranks. Queue entries of pairs that are gone are skipped."""
        ids = [self.byte_ids[b] for b in piece.encode()]
        n, merges = len(ids), self.merges
        if n == 1:
            return (ids[0],)
        queue = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, k, made, left, right = heappop(queue)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j] = made, -1
            after[k] = follow = after[j]
            if follow < n:
                before[follow] = k
                if m := merges.get((made, ids[follow])):
                    heappush(queue, (m[0], k, m[1], made, ids[follow]))
            if (prior := before[k]) >= 0 and (m := merges.get((ids[prior], made))):
                heappush(queue, (m[0], prior, m[1], ids[prior], made))
        return tuple(i for i in ids if i >= 0)

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.merge(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_PIECES:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.split_added.split(text) if self.split_added else (text,)):
            if k % 2:
                out.append(self.added[part])
            elif part:
                pieces, known = self.pieces(part), self.known
                out += chain.from_iterable([known.get(p) or self._piece(p) for p in pieces])
        return out

    def decode(self, ids: list[int]) -> str:
        words = self.words
        return b"".join([words[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _encoder(definition: str) -> BytePairEncoder:
    """One for each worker process. A task empties its memory of pieces at its end; the tables stay."""
    return BytePairEncoder(definition)


def _definition(spark: SparkSession, path: str | None):
    """The vocabulary file, at most a few MB, read by the driver and sent to every executor."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus the token ids of ``text``, one row for each input row.

    A null or empty text has no ids. Special tokens in a text become their ids, as the library does by default.
    An ids column that clashes with one of ``docs`` gets leading underscores. ``path`` names a vocabulary file.
    """
    definition = _definition(docs.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch["text"]:
                flat.extend(encoder.encode(text.as_py() or ""))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])
        encoder.known.clear()

    name = fresh(docs.columns, ids_col)[0]
    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns plus the text of the ids; null ids give an empty text, incomplete characters U+FFFD."""
    definition = _definition(encoded.sparkSession, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            texts = pa.array([encoder.decode(ids.as_py() or []) for ids in batch[ids_col]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    name = fresh(encoded.columns, text_col)[0]
    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids are made, digested and decoded in one pass, and not kept."""
    definition = _definition(docs.sparkSession, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        shown = [str(i) for i in range(max(encoder.words) + 1)]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, made, back = [], [], []
            for text in batch["text"]:
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids))
                made.append(sha(",".join([shown[i] for i in ids]).encode()))
                back.append(sha(encoder.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, DIGEST)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return token_digests(table(spark, sf_dir, "documents"))
