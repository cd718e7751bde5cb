"""Ranking of context items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each item kind, and the confidence of an item that has none.
KIND_WEIGHTS = {"DIFF_HUNK": 1.0, "CHANGED_METHOD": 1.0, "OVERRIDE": 0.9, "TEST": 0.85, "CALLER": 0.8, "RELATED_FILE": 0.5, "RELATED_SNIPPET": 0.5, "METADATA": 0.2}
DEFAULT_CONFIDENCE = 0.5


def heuristic_score(kind: Column, confidence: Column) -> Column:
    """Weight of the kind times the confidence."""
    weight = F.lit(None).cast("double")
    for name, value in KIND_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(value)).otherwise(weight)
    return weight * F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE))
