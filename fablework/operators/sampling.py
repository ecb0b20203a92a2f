"""Per-group choice: top-k with ties, arg-max, softmax and weighted draws.

All operators take long rows ``(group, item, value)``. A group may be larger than a task
can hold, so statistics are aggregated first and joined back instead of computed in a
window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from .ordinals import id_bucket, running_total


def top_k_ties(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The ``k`` largest values of each group and all rows equal to the k-th.

    Equal values are counted together first, so the threshold needs at most ``k`` distinct
    values per group and ties never meet in one task.
    """
    counted = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    by_value = Window.partitionBy(group).orderBy(F.desc(value))
    highest = counted.withColumn("_place", F.row_number().over(by_value)).filter(F.col("_place") <= k)
    above = by_value.rowsBetween(Window.unboundedPreceding, -1)
    threshold = (
        highest.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
        .filter(F.col("_above") < k)
        .groupBy(group)
        .agg(F.min(value).alias("_least"))
    )
    return df.join(threshold, group).filter(F.col(value) >= F.col("_least")).drop("_least")


def arg_max(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Item with the largest value of each group, the smallest item on ties."""
    return df.groupBy(group).agg(F.max_by(item, F.struct(F.col(value), -F.col(item))).alias(item))


def softmax(df: DataFrame, group: str, value: str, temperature: float = 1.0, name: str = "prob") -> DataFrame:
    """Probabilities per group, shifted by the group's maximum before ``exp``."""
    scaled = F.col(value) / F.lit(temperature)
    peak = df.groupBy(group).agg((F.max(value) / F.lit(temperature)).alias("_peak"))
    raised = df.join(peak, group).withColumn("_e", F.exp(scaled - F.col("_peak")))
    mass = raised.groupBy(group).agg(F.sum("_e").alias("_mass"))
    return raised.join(mass, group).select(*df.columns, (F.col("_e") / F.col("_mass")).alias(name))


def weighted_draw(df: DataFrame, group: str, item: str, prob: str, seed: int = 0) -> DataFrame:
    """One item per group, drawn with its probability.

    The draw takes the first item whose running sum passes the group's uniform number;
    rounding may leave the sum below it, and then the last possible item is taken.
    """
    summed = running_total(df, [group], [item], [id_bucket(F.col(item))], F.col(prob), before="_before")
    u = uniform(seed, "draw", F.col(group))
    passed = F.when(F.col("_before") + F.col(prob) > u, F.col(item))
    last = F.when(F.col(prob) > 0, F.col(item))
    return summed.groupBy(group).agg(F.coalesce(F.min(passed), F.max(last)).alias(item))


def sample_tokens(
    logits: DataFrame,
    group: str,
    item: str,
    value: str,
    temperature: float = 1.0,
    top_k: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Choose the next item per group: arg-max at temperature 0, else top-k, softmax, draw."""
    if temperature == 0.0:
        return arg_max(logits, group, item, value)
    kept = logits if top_k is None else top_k_ties(logits, group, value, top_k)
    return weighted_draw(softmax(kept, group, value, temperature), group, item, "prob", seed)


def head(df: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """The first ``count`` rows in an order; a bounded heap per task, no full sort."""
    return df.orderBy(*order).limit(count)
