"""What the operators share: table access, intermediate tables, column names that cannot clash."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from patchweave.sources.scratch import discard
from patchweave.sources.scratch import stored as materialize

__all__ = ["bounded_batches", "discard", "fresh", "materialize", "table"]

#: Bytes of an Arrow batch at most.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, so that a Python worker's memory follows no long run of long texts.

    The setting is read when a frame runs, so it cannot be put back before that. Operators leave it alone; registered queries
    and pipeline stages, which own their session, call this, as any application with long texts should.
    """
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").strip().lower()).groups()
    if not 0 < int(number) << " kmgt".index(unit or " ") * 10 <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column in ``taken`` has, compared as Spark does, without case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
