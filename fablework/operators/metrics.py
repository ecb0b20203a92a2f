"""Classifier, probe and loss metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import magnitude_bucket, running_total


def confusion(df: DataFrame) -> DataFrame:
    """Accuracy and error rates of ``score`` against ``label``; rates divide by one more."""
    hit = lambda score, label: F.sum(
        ((F.col("score") == score) & (F.col("label") == label)).cast("bigint")
    )
    of_class = lambda label: F.sum((F.col("label") == label).cast("bigint")) + 1
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("score") == F.col("label")).cast("double")).alias("accuracy"),
        (hit(1.0, 0.0) / of_class(0.0)).alias("false_positive"),
        (hit(0.0, 1.0) / of_class(1.0)).alias("false_negative"),
    )


def mistakes(df: DataFrame) -> DataFrame:
    """Rows whose score differs from their label; unscored rows are no mistakes."""
    return df.filter(F.col("score") != F.col("label"))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per group.

    Quartiles are exact, by linear interpolation. Moments are sums over partial results.
    Order statistics come from the table of distinct values and their counts, whose
    running sums show which values hold the wanted ranks; a group's rows never meet.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    counted = known.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    moments = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    placed = running_total(
        counted, by, ["_v"], magnitude_bucket(F.col("_v")), F.col("_n"), before="_before", total="_all"
    )
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    parts = []
    for share in shares.values():
        at = (F.col("_all") - 1) * F.lit(share)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        parts += [F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v"))), F.max(at - low)]
    named = [p.alias(f"_q{i}") for i, p in enumerate(parts)]
    quartiles = placed.groupBy(*by).agg(*named)
    if by:
        joined = moments.join(quartiles, by)
    else:  # one row each
        joined = moments.withColumn("_one", F.lit(1)).join(quartiles.withColumn("_one", F.lit(1)), "_one")
    interpolated = {
        name: F.col(f"_q{3 * i}") + (F.col(f"_q{3 * i + 1}") - F.col(f"_q{3 * i}")) * F.col(f"_q{3 * i + 2}")
        for i, name in enumerate(shares)
    }
    return joined.withColumns(interpolated).select(*by, "count", "mean", "std", "min", *shares, "max")


def version_summary(scored: DataFrame) -> DataFrame:
    """``describe`` of the scores of each table version, with its first row's iteration."""
    first = scored.groupBy("version").agg(F.min_by("iter_num", "row_idx").alias("iter_num"))
    return describe(scored, "score", ["version"]).join(first, "version")


def metric_rows(summary: DataFrame, metric: str = "metric") -> DataFrame:
    """``(iter_num_gen, metric)`` rows for a run's log."""
    return summary.select(F.col("iter_num").alias("iter_num_gen"), F.col("mean").alias(metric))


def mean_by_key(df: DataFrame, keys: Sequence[str], value: str, name: str = "mean_loss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name), F.count(value).alias("steps"))


def probe_accuracy(logits: DataFrame) -> DataFrame:
    """Share of right signs per layer and feature, per layer (feature null) and overall.

    Aggregated once by layer and feature; the coarser levels sum that small table.
    """
    right = ((F.col("logit") > 0).cast("int") == F.col("target")).cast("bigint")
    fine = logits.groupBy("layer", "feature").agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n"))
    return (
        fine.rollup("layer", "feature")
        .agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    )


def bce_by_layer(logits: DataFrame) -> DataFrame:
    """Mean binary cross-entropy from logits per layer; the row without layer is their sum."""
    x, y = F.col("logit"), F.col("target")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    per_layer = logits.groupBy("layer").agg(F.avg(loss).alias("loss"))
    total = per_layer.agg(F.sum("loss").alias("loss")).withColumn("layer", F.lit(None).cast("int"))
    return per_layer.unionByName(total)


def cross_entropy(logits: Column, target: Column, ignore: int = -1) -> Column:
    """Loss of one row of class logits; null for ignored rows, which means leave out."""
    peak = F.array_max(logits)
    mass = F.aggregate(
        F.transform(logits, lambda x: F.exp(x - peak)), F.lit(0.0).cast("double"), lambda acc, x: acc + x
    )
    loss = F.ln(mass) + peak - F.try_element_at(logits, target.cast("int") + F.lit(1))
    return F.when(target != ignore, loss)


def mean_cross_entropy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per_row = df.select(*by, cross_entropy(F.col("logits"), F.col("target")).alias("loss"))
    return per_row.groupBy(*by).agg(F.avg("loss").alias("loss"), F.count("loss").alias("n"))


def mean_pool(vectors: DataFrame, seq: str, position: str, vector: str, last: int = 10) -> DataFrame:
    """Element-wise mean of the last positions of each sequence.

    The ranking keeps ``last`` rows per sequence in each task already before the shuffle.
    """
    back = Window.partitionBy(seq).orderBy(F.desc(position))
    tail = vectors.select(seq, position, vector).withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= last)
    entries = tail.select(seq, F.posexplode(vector).alias("dim", "entry"))
    means = entries.groupBy(seq, "dim").agg(F.avg("entry").alias("entry"))
    return means.groupBy(seq).agg(F.sort_array(F.collect_list(F.struct("dim", "entry")))["entry"].alias("pooled"))
