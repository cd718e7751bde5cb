"""Content identities: SHA-256 over ordered, separated fields."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.config import ACQUISITION_VERSION, BUILDER_VERSION, POLICY_VERSION, SCHEMA_VERSION, TOKENIZER_VERSION, ReviewConfig

NUL = "\u0000"


def _joined(*parts: Column | str, sep: str = "\n") -> Column:
    return F.sha2(F.concat_ws(sep, *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def patch_sha(files: DataFrame) -> DataFrame:
    """(pr_key, patch_sha): one SHA-256 over the fields of all files in the order of their paths; a null field counts as empty.

    A digest of a whole change cannot be put together from parts. So the files are dealt out by change, sorted, and digested as they
    stream by: a task holds one batch of patches, however large the change.
    """
    names = ("path", "previous_path", "change_type", "patch")
    fields = F.concat(*(F.concat(F.coalesce(F.col(c), F.lit("")), F.lit(NUL)) for c in names))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, sha = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch["pr_key"].to_pylist(), batch["fields"], strict=True):
                if sha is None or key != change:
                    done += [(change, sha.hexdigest())] if sha else []
                    change, sha = key, hashlib.sha256()
                sha.update(text.as_py().encode())
            yield rows(done)
        if sha:
            yield rows([(change, sha.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["pr_key", "patch_sha"])

    ordered = files.select("pr_key", *names).repartition("pr_key").sortWithinPartitions("pr_key", *names)
    return ordered.select("pr_key", fields.alias("fields")).mapInArrow(digest, "pr_key string, patch_sha string")


def corpus_key(repo: Column, merge_base: Column, head: Column, patch: Column) -> Column:
    return _joined(repo, merge_base, head, patch, ACQUISITION_VERSION)


def context_id(corpus: Column, config: ReviewConfig) -> Column:
    """Names a frozen plan: what it was built from, and how."""
    return _joined(corpus, str(SCHEMA_VERSION), BUILDER_VERSION, POLICY_VERSION, config.fingerprint(), TOKENIZER_VERSION)
