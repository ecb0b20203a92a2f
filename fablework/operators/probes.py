"""Linear probes: which features can be read off pooled vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLOPES = "layer int, feature int, dim int, slope double, n bigint"


def _slopes(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the gradients of all probes over the rows of a task; ``dim`` -1 has the squares of the vectors."""
    weights = shared.value  # layer: [feature, dim]
    sums: dict[int, list] = {}
    for batch in batches:
        layers = batch["layer"].to_numpy(zero_copy_only=False)
        x = np.asarray(batch["vector"].flatten(), np.float64).reshape(batch.num_rows, -1)
        y = np.asarray(batch["target"].flatten(), np.float64).reshape(batch.num_rows, -1)
        for layer in np.unique(layers):
            own = layers == layer
            p = 1 / (1 + np.exp(-np.clip(x[own] @ weights[layer].T, -500, 500)))
            old = sums.setdefault(int(layer), [0.0, 0.0, 0])
            sums[int(layer)] = [old[0] + (p - y[own]).T @ x[own], old[1] + (x[own] ** 2).sum(), old[2] + int(own.sum())]
    for layer, (slope, squares, n) in sums.items():
        features, dims = slope.shape
        columns = [
            np.full(features * dims + 1, layer), np.append(np.repeat(np.arange(features), dims), -1), np.append(np.tile(np.arange(dims), features), -1),
            np.append(slope.ravel(), squares), np.full(features * dims + 1, n),
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _SLOPES.split(", ")])


def fit_probes(
    vectors: DataFrame, layers: Sequence[int], features: int = 6, reg: float = 0.01, max_iter: int = 60, tolerance: float = 1e-6
) -> dict[tuple[int, int], list[float]]:
    """Weights of one linear classifier without intercept per layer and feature.

    ``vectors`` has ``layer``, ``vector`` and the 0/1 list ``target``. The mean log loss plus ``reg / 2`` times the
    squared weights is minimised for all probes together: a step is one job that adds up the gradients
    of all of them, and only these sums (a number for each weight) come back. Each probe has a step
    length of its own, from the change of its last two gradients. Rows with null in them are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("layer").isin([int(x) for x in layers]) & F.col("vector").isNotNull() & F.col("target").isNotNull()).select(
        F.col("layer").cast("int").alias("layer"), F.col("vector").cast("array<double>").alias("vector"),
        F.slice("target", 1, features).cast("array<int>").alias("target"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    dims = {r["layer"]: r["d"] for r in rows.groupBy("layer").agg(F.max(F.size("vector")).alias("d")).collect()}
    weights = {layer: np.zeros((features, d)) for layer, d in dims.items()}
    steps: dict[int, np.ndarray] = {}
    before: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(max_iter if dims else 0):
        shared = spark.sparkContext.broadcast(weights)
        sums = rows.mapInArrow(partial(_slopes, shared), _SLOPES).groupBy("layer", "feature", "dim").agg(F.sum("slope").alias("s"), F.sum("n").alias("n"))
        found = sums.toPandas()
        worst = 0.0
        for layer, w in weights.items():
            own = found[found["layer"] == layer]
            n = own["n"].iloc[0]
            inner = own[own["dim"] >= 0].sort_values(["feature", "dim"])
            slope = inner["s"].to_numpy().reshape(w.shape) / n + reg * w
            if layer in before:
                moved, turned = w - before[layer][0], slope - before[layer][1]
                curve = (moved * turned).sum(axis=1)
                steps[layer] = np.where(curve > 1e-18, (moved * moved).sum(axis=1) / np.maximum(curve, 1e-18), steps[layer])
            else:
                squares = own.loc[own["dim"] < 0, "s"].iloc[0] / n
                steps[layer] = np.full(len(w), 1 / (0.25 * squares + reg))
            before[layer] = (w.copy(), slope)
            worst = max(worst, np.abs(slope).max())
        if worst < tolerance:
            break
        weights = {layer: before[layer][0] - steps[layer][:, None] * before[layer][1] for layer in weights}
    rows.unpersist()
    return {(layer, f): [float(x) for x in w[f]] for layer, w in weights.items() for f in range(features)}


def probe_outputs(vectors: DataFrame, weights: dict[tuple[int, int], list[float]]) -> DataFrame:
    """Long probe outputs ``(example_id, layer, feature, logit, target)``."""
    spark = vectors.sparkSession
    table = spark.createDataFrame(
        [(layer, feature, w) for (layer, feature), w in weights.items()], "layer int, feature int, weight array<double>"
    )
    # one row per probe, a fixed number
    joined = vectors.join(F.broadcast(table), "layer")
    products = F.zip_with("vector", "weight", lambda x, w: x.cast("double") * w)
    logit = F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return joined.select(
        "example_id",
        "layer",
        "feature",
        logit.alias("logit"),
        F.element_at("target", F.col("feature") + 1).cast("int").alias("target"),
    )

