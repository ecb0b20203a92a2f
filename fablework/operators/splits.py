"""Splits, slices, shuffles and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..sources.readers import shard_index
from .ordinals import first_rows, id_bucket, ordinal, unit_bucket

# Fixed value: share of the training shards used for pre-training.
PRETRAIN_SHARE = 0.8


def shard_roles(df: DataFrame) -> DataFrame:
    """Role of each shard: the first is the test split, the others train.

    ``phase`` cuts the training shards into the first 80 % for pre-training and the rest
    for fine-tuning; it is null for the test shard.
    """
    index = shard_index(df)
    shards = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    pretrain = F.floor((shards - 1) * F.lit(PRETRAIN_SHARE))
    idx = F.col("shard_idx")
    return index.select(
        "shard_key",
        "shard_idx",
        F.when(idx == 0, "test").otherwise("train").alias("split"),
        F.when(idx == 0, F.lit(None)).when(idx - 1 < pretrain, "pretrain").otherwise("finetune").alias("phase"),
    )


def shard_split(df: DataFrame) -> DataFrame:
    """Rows with the role of their shard."""
    return df.join(shard_roles(df), "shard_key")


def exact_split(df: DataFrame, share: float, key: str, seed: int = 0, name: str = "train") -> DataFrame:
    """Flag exactly ``round(share * n)`` rows, chosen by hash order.

    The rows are never sorted or moved. Counts per hash bucket show the bucket in which
    the last chosen row lies; that bucket alone is ranked, and the split is then a
    comparison with the found ``(hash, key)``.
    """
    u = uniform(seed, "split", F.col(key))
    points = df.select(u.alias("u"), F.col(key).alias("k"), unit_bucket(u).alias("b"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    edge = (
        points.groupBy("b")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            "b",
            "size",
            F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
            F.round(F.sum("size").over(everything) * F.lit(share)).alias("wanted"),
        )
        .filter((F.col("start") < F.col("wanted")) & (F.col("wanted") <= F.col("start") + F.col("size")))
        .select("b", (F.col("wanted") - F.col("start")).alias("place"))
    )
    in_edge = Window.partitionBy("b").orderBy("u", "k")
    last = (
        points.join(F.broadcast(edge), "b")  # one row
        .withColumn("r", F.row_number().over(in_edge))
        .filter(F.col("r") == F.col("place"))
        .select(F.struct("u", "k").alias("cut"))
    )
    chosen = F.struct(u.alias("u"), F.col(key).alias("k")) <= last.scalar()
    return df.withColumn(name, F.coalesce(chosen, F.lit(False)))


def hash_split(df: DataFrame, share: float, key: str, seed: int = 0, name: str = "train") -> DataFrame:
    """Flag about ``share`` of the rows by a hash threshold; one pass, no counts."""
    return df.withColumn(name, uniform(seed, "split", F.col(key)) < F.lit(share))


def class_slice(df: DataFrame, size: int, start: int = 0) -> DataFrame:
    """Rows ``[start, start + size)`` of each class, in shard and story order."""
    return first_rows(
        df,
        ["label"],
        ["shard_key", "story_id"],
        [F.col("shard_key"), id_bucket(F.col("story_id"))],
        size,
        start,
        max_groups=2,
    )


def labelled_set(df: DataFrame, size: int, start: int = 0, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Balanced labelled rows with their train flag; ``df`` has ``label`` already."""
    return exact_split(class_slice(df, size, start).drop("idx"), share, "story_id", seed)


def minus(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``."""
    return df.join(other.select(key), key, "left_anti")


def work_chunks(df: DataFrame, key: str, chunks: int = 10) -> DataFrame:
    """Contiguous chunks of ``ceil(n / chunks)`` rows in key order."""
    placed = ordinal(df, [], [key], [id_bucket(F.col(key))], "idx", total="_n")
    size = F.ceil(F.col("_n") / F.lit(chunks))
    return placed.withColumn("chunk", F.floor(F.col("idx") / size).cast("bigint")).drop("_n")


def epoch_order(
    blocks: DataFrame,
    epochs: int,
    seed: int = 0,
    worker: int = 0,
    rank: int = 0,
) -> DataFrame:
    """Place of every ``(shard_key, block)`` in each epoch.

    Shards are shuffled, then the blocks inside each shard; both anew in every epoch.
    Places inside a shard and starts of shards are numbered apart, so neither needs all
    blocks in one task.
    """
    mixed = seed + worker + 1337 * rank
    each_epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    rows = blocks.select("*", each_epoch)
    u_block = uniform(mixed, "block", F.col("epoch"), F.col("shard_key"), F.col("block"))
    rows = rows.withColumn("_u", u_block)
    inside = ordinal(rows, ["epoch", "shard_key"], ["_u", "block"], [unit_bucket(F.col("_u"), 4096)], "_inside")

    sizes = blocks.groupBy("shard_key").agg(F.count(F.lit(1)).alias("_n")).select("*", each_epoch)
    u_shard = uniform(mixed, "shard", F.col("epoch"), F.col("shard_key"))
    earlier = (
        Window.partitionBy("epoch").orderBy("_us", "shard_key").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.withColumn("_us", u_shard).select(
        "epoch", "shard_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")).alias("_start")
    )
    return inside.join(starts, ["epoch", "shard_key"]).select(
        "epoch", *blocks.columns, (F.col("_start") + F.col("_inside")).alias("place")
    )


def batches(ordered: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive groups of ``batch_size`` blocks of each epoch."""
    return ordered.withColumn("batch_id", F.floor(F.col("place") / F.lit(batch_size)).cast("bigint"))


def bernoulli(chance: float, seed: int, purpose: str, key: Column) -> Column:
    return uniform(seed, purpose, key) < F.lit(chance)
