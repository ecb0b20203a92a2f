"""Per-run metric histories: enrichment, smoothing, averages and summaries.

Windows over a run are cut into chunks (see ``ordinals``), because one run may hold a
large part of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import computed_once, uniform
from .ordinals import id_bucket, ordinal, running_min, with_halo

KEY = "run_id"


def enrich(history: DataFrame, runs: DataFrame) -> DataFrame:
    """Run columns on every history row; a column both have is taken from the history."""
    extra = [c for c in runs.columns if c not in history.columns]
    return history.join(runs.select(KEY, *extra), KEY)


def placed(history: DataFrame, step: str = "iter", name: str = "idx", total: str | None = None) -> DataFrame:
    """Position of each row in its run."""
    return ordinal(history, [KEY], [step], [id_bucket(F.col(step))], name, total)


def thinned(history: DataFrame, every: int, finer_before: int = 0, step: str = "iter") -> DataFrame:
    """Rows at every ``every``-th iteration, ten times as dense before ``finer_before``.

    The step after it is ten times the dense one, which loses the remainder of ``every``.
    """
    if not finer_before:
        return history.filter(F.col(step) % every == 0)
    if every < 10:
        raise ValueError("a denser part needs every >= 10")
    dense = every // 10
    width = F.when(F.col(step) < finer_before, F.lit(dense)).otherwise(F.lit(dense * 10))
    return history.filter(F.col(step) % width == 0)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(
    history: DataFrame, metric: str, sigma: float = 2.0, step: str = "iter", name: str | None = None, chunk_rows: int = 4096
) -> DataFrame:
    """Gaussian smoothing of the non-null values of each run, mirrored at both ends.

    Rows near an end are copied to their mirrored positions, rows near a chunk border into
    the next chunk, and a moving window over ``(run, chunk)`` weighs the neighbours. A
    series shorter than the window is mirrored again and again.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    rows = placed(history.filter(F.col(metric).isNotNull()), step, "_i", "_n")
    i, n = F.col("_i"), F.col("_n")
    turns = F.ceil((n + F.lit(radius)) / (n * 2)).cast("bigint")
    images = F.flatten(
        F.transform(F.sequence(-turns, turns), lambda m: F.array(i + n * 2 * m, n * 2 * m - i - 1))
    )
    near = F.filter(images, lambda p: (p >= -radius) & (p < n + radius))
    spread = computed_once(rows, "_near", near).withColumn("_p", F.explode("_near")).drop("_near")
    chunked = with_halo(spread, "_p", max(chunk_rows, radius), radius, radius, "_chunk", "_own")
    line = Window.partitionBy(KEY, "_chunk").orderBy("_p")
    terms: Column = F.lit(0.0)
    for k, weight in zip(range(-radius, radius + 1), weights):
        terms = terms + F.lag(metric, -k).over(line) * F.lit(weight)
    return (
        chunked.withColumn("_smooth", terms)
        .filter(F.col("_own") & (F.col("_p") == i))
        .select(*history.columns, F.col("_smooth").alias(name or f"{metric}_smooth"))
    )


def moving_average(
    history: DataFrame, metric: str, keep: float = 0.9, skip: int = 5, step: str = "iter", name: str = "ema"
) -> DataFrame:
    """``e = keep * e + (1 - keep) * x`` per run, seeded by the first value after ``skip`` rows.

    Inside a chunk the average is a weighted running sum. Chunks are so long that what
    reaches across three of them is below double precision, so three earlier chunk sums
    give the value a chunk starts from.
    """
    chunk_rows = max(16, math.ceil(math.log(1e-9) / math.log(keep)))
    rows = placed(history.filter(F.col(metric).isNotNull()), step, "_i").filter(F.col("_i") >= skip)
    at = F.col("_i") - skip
    share = F.when(at == 0, F.lit(1.0)).otherwise(F.lit(1.0 - keep)) * F.col(metric)
    a = F.lit(keep)
    rows = rows.select(
        *history.columns,
        F.floor(at / F.lit(chunk_rows)).cast("bigint").alias("_chunk"),
        (at % chunk_rows).alias("_j"),
        share.alias("_y"),
    ).withColumn("_scaled", F.col("_y") * F.pow(a, -F.col("_j")))
    ends = rows.groupBy(KEY, "_chunk").agg(
        (F.sum("_scaled") * F.pow(a, F.count(F.lit(1)) - 1)).alias("_end")
    )
    whole = F.pow(a, F.lit(chunk_rows))
    # each end goes to the three chunks after it; this needs no order among the chunks
    sent = ends.withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))))
    weight = F.when(F.col("_ahead") == 0, F.lit(0.0)).otherwise(F.pow(whole, F.col("_ahead") - 1))
    starts = (
        sent.withColumn("_chunk", F.col("_chunk") + F.col("_ahead"))
        .groupBy(KEY, "_chunk")
        .agg(F.sum(F.col("_end") * weight).alias("_carry"))
    )
    inside = Window.partitionBy(KEY, "_chunk").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("_scaled").over(inside) * F.pow(a, F.col("_j")))
    return local.join(starts, [KEY, "_chunk"]).select(
        *history.columns, (F.col("_local") + F.col("_carry") * F.pow(a, F.col("_j") + 1)).alias(name)
    )


def running_best(history: DataFrame, metric: str, step: str = "iter") -> DataFrame:
    """Least earlier value of the metric and whether this row improves on it."""
    rows = history.filter(F.col(metric).isNotNull())
    found = running_min(rows, [KEY], [step], [id_bucket(F.col(step))], metric, "best_before")
    better = F.col("best_before").isNull() | (F.col(metric) < F.col("best_before"))
    return found.withColumn("improved", better)


def step_time(history: DataFrame, clock: str, step: str = "iter", chunk_rows: int = 65536) -> DataFrame:
    """Clock difference to the row before; null for the first row of a run."""
    chunked = with_halo(placed(history, step, "_i"), "_i", chunk_rows, behind=1, chunk="_chunk", own="_own")
    line = Window.partitionBy(KEY, "_chunk").orderBy("_i")
    return (
        chunked.withColumn("step_time", F.col(clock) - F.lag(clock).over(line))
        .filter("_own")
        .select(*history.columns, "step_time")
    )


def distinct_evals(history: DataFrame, marker: str = "iter_num_gen", name: str = "evals") -> DataFrame:
    """Number of distinct evaluated iterations per run."""
    return history.groupBy(KEY).agg(F.countDistinct(marker).alias(name))


def last_evals(history: DataFrame, metric: str, marker: str = "iter_num_gen", step: str = "iter") -> DataFrame:
    """The last rows of each run that have both values, as many as it has evaluations."""
    both = placed(history.dropna(subset=[marker, metric]), step, "_i", "_n")
    return (
        both.join(distinct_evals(history, marker, "_evals"), KEY)
        .filter(F.col("_i") >= F.col("_n") - F.col("_evals"))
        .select(*history.columns)
    )


def derived(history: DataFrame, metric: str, baseline: float, offset: int, tokens_per_step: int, step: str = "iter") -> DataFrame:
    """Log (null for values of 0 or less), baseline difference, shifted step and token counter of each row."""
    return history.withColumns(
        {
            f"log_{metric}": F.ln(metric),
            f"{metric}_baseline": F.col(metric) - F.lit(baseline),
            "shifted": F.col(step) + F.lit(offset),
            "tokens": F.col(step) * F.lit(tokens_per_step),
        }
    )


def chosen_scores(history: DataFrame, iterations: Sequence[int], score: str, marker: str = "iter_num_gen") -> DataFrame:
    """Rows at the chosen iterations that have a score."""
    return history.filter(F.col(marker).isin(*iterations) & F.col(score).isNotNull() & ~F.isnan(score))


def score_pivot(
    history: DataFrame, key: Column, iterations: Sequence[int], score: str, marker: str = "iter_num_gen"
) -> DataFrame:
    """One row per key with the score at each chosen iteration.

    The last run of a key (by run id) gives the whole row, cells that it has no score for
    included; of several scores of an iteration the greatest counts. Cells are gathered by key
    and run first, so a row per run is all that is compared.
    """
    valid = F.col(score).isNotNull() & ~F.isnan(score)
    cells = [F.max(F.when((F.col(marker) == i) & valid, F.col(score))).alias(f"at_{i}") for i in iterations]
    per_run = history.withColumn("key", key).groupBy("key", KEY).agg(*cells)
    last = per_run.groupBy("key").agg(F.max(F.struct(KEY, *[f"at_{i}" for i in iterations])).alias("_row"))
    return last.select("key", *[F.col(f"_row.at_{i}").alias(f"at_{i}") for i in iterations])


def mean_curve(history: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of a value per plotted point."""
    return history.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


# The distribution function of the Poisson distribution with mean 1 at 0, 1, 2, …
POISSON = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999898032318966, 0.9999988747797947, 0.9999998880384222,
)


def mean_bands(
    history: DataFrame, keys: Sequence[str], value: str, row_keys: Sequence[str], replicates: int = 200,
    low: float = 0.025, high: float = 0.975, seed: int = 0,
) -> DataFrame:
    """``(keys, mean, low, high, n)``: the mean of each plotted point with a bootstrap band.

    In each replicate a row counts as often as a Poisson number says, drawn by hash from the row's own
    ``row_keys`` and the replicate. So rows are drawn where they are, the sums of all replicates are
    one aggregation that shrinks before it is shuffled, and a group may be of any size. The band lies between
    two percentiles of the replicates' means. Null values are left out; a point without values has no row.
    """
    rows = history.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.struct(*row_keys).alias("_row"))
    drawn = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_b"))
    u = uniform(seed, "band", *[F.col("_row")[k] for k in row_keys], F.col("_b"))
    times = F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0), lambda n, c: n + (F.col("_u") >= c).cast("int"))
    sums = (
        drawn.withColumn("_u", u).withColumn("_w", times)
        .groupBy(*keys, "_b").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    )
    means = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    bands = sums.groupBy(*keys).agg(F.percentile(means, low).alias("low"), F.percentile(means, high).alias("high"))
    whole = rows.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return whole.alias("w").join(bands.alias("b"), reduce(lambda a, c: a & c, same)).select(*[f"w.{k}" for k in keys], "mean", "low", "high", "n")


def unpivot_probes(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Probe columns ``…/probe_3`` as rows ``(probe_index, probe_accuracy)``."""
    long = df.unpivot(list(ids), list(columns), "_name", "probe_accuracy")
    index = F.regexp_extract("_name", r"probe_(\d+)$", 1).cast("int")
    return long.select(*ids, index.alias("probe_index"), "probe_accuracy")
