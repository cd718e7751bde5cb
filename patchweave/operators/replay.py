"""Several policies over the same candidates: scored, packed and compared without reading them again for each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchweave.functions import scoring
from patchweave.operators import packing


@dataclass(frozen=True)
class Policy:
    """A way to choose context: the tokens of a slice, the weight of each kind of item, and the confidence of items without one."""

    name: str
    budget: int
    weights: Mapping[str, float] = field(default_factory=lambda: dict(scoring.KIND_WEIGHTS))
    default_confidence: float = scoring.DEFAULT_CONFIDENCE


def score_policies(candidates: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The candidates once for each policy, with ``policy``, ``budget`` and ``value``.

    ``candidates`` has kind and confidence. A kind without a weight, or a null kind, is worth nothing. Policies are settings, so the rows grow by
    their number; they are unfolded where the rows lie, without a join or a shuffle. No policies give no rows.
    """
    if len({p.name for p in policies}) < len(policies):
        raise ValueError("policies need different names")
    # typed, so that no policies or no weights are empty arrays of the right kind
    kind = "array<struct<policy:string,budget:int,weights:map<string,double>,otherwise:double>>"
    weights = lambda p: F.create_map(*(F.lit(x) for x in chain(*((k, float(w)) for k, w in p.weights.items())))).cast("map<string,double>")
    settings = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.budget).alias("budget"), weights(p).alias("weights"), F.lit(float(p.default_confidence)).alias("otherwise")) for p in policies]
    each = candidates.withColumn("_policy", F.explode(F.array(*settings).cast(kind)))
    weight = F.when(F.col("kind").isNotNull(), F.element_at("_policy.weights", F.col("kind")))
    value = F.coalesce(weight, F.lit(0.0)) * F.coalesce(F.col("confidence"), F.col("_policy.otherwise"))
    return each.withColumns({"policy": F.col("_policy.policy"), "budget": F.col("_policy.budget"), "value": value}).drop("_policy")


def replay(candidates: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """(policy, pr_key, slice_no, item_id, status, pack_ord, tokens): what each policy would include, as ``pack_slices`` gives for it alone.

    One shuffle for all policies; each slice of each policy is a group of its own.
    """
    return packing.pack_slices(score_policies(candidates, policies), "budget", ["policy"])


def compare(replayed: DataFrame, n_policies: int) -> DataFrame:
    """(policy, pr_key, n_included, n_dropped, tokens, n_shared, n_alone) for each policy and change, and for all changes with a null pr_key.

    ``tokens`` are those of included items; ``n_shared`` counts those that all policies include, and ``n_alone`` those that no other does.
    Changes are told from the total by their key, so rows of null pr_key are left out.
    """
    took = F.col("status") == "included"
    same = Window.partitionBy("pr_key", "slice_no", "item_id")
    counted = replayed.where(F.col("pr_key").isNotNull()).withColumn("takers", F.count_if(took).over(same))
    measures = (
        F.count_if(took).alias("n_included"), F.count_if(~took).alias("n_dropped"), F.coalesce(F.sum(F.when(took, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"),
        F.count_if(took & (F.col("takers") == n_policies)).alias("n_shared"), F.count_if(took & (F.col("takers") == 1)).alias("n_alone"),
    )
    sets = [[F.col("policy"), F.col("pr_key")], [F.col("policy")]]
    return counted.groupingSets(sets, "policy", "pr_key").agg(*measures)
