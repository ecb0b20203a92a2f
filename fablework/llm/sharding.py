"""Shards that balance bytes, words and rows: vector bin packing of groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Of bytes, words and rows in the dot product; bytes are what the law promises.
WEIGHTS = (1.0, 0.1, 0.1)


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """A shard for each item (a row per item, a column per resource).

    Items come in decreasing order of their largest share. Each goes to the shard where
    the dot product of its shares with the residual capacity is highest, of those where no
    capacity is exceeded if there are any, else of those that have room for its bytes; where none
    has, it goes to the shard with most bytes free. Ties go to the smaller shard. The capacity of a
    shard is its even share of each resource.
    """
    shares = items / np.maximum(items.sum(axis=0), 1) * shards
    weighted = shares * np.asarray(weights)
    residual = np.ones((shards, items.shape[1]))
    out = np.empty(len(items), dtype=np.int64)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        value = residual @ weighted[i]
        room = residual >= shares[i]
        fits = room.all(axis=1) if room.all(axis=1).any() else room[:, 0]
        out[i] = int(np.argmax(np.where(fits, value, value - 1e6) if fits.any() else residual[:, 0]))
        residual[out[i]] -= shares[i]
    return out


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cells: int = 6144,
    uneven: float = 0.01,
) -> DataFrame:
    """Put every row into one of ``shards`` shards; rows with equal texts stay together while a shard holds them.

    Law ``bytes``: sizes (UTF-8 bytes plus 8) of the shards are near equal; words and rows
    are balanced next to them. A group (the rows of one text) with more than 1/``cells`` of all
    bytes, words or rows is an item of its own; smaller ones are gathered by a hash of the
    text in ``cells`` items. A group above a whole shard in one of the three can't stay together and
    becomes several items, by a hash of its ids; only if the bytes of the shards then differ by more than
    ``uneven`` of their mean, groups above a half, a quarter or an eighth of a shard are cut, too. So there are a
    few items for each cell, whatever the number of rows, and placing these is the only step that isn't
    distributed. Slots are numbered inside pieces of an item (one for each cell's worth of it),
    which start where the pieces before them in the shard end.

    A null text counts as an empty one. Null and repeated ids are rows like any other. An
    empty table gives no rows. Other columns are not read.

    Returns ``doc_id, size, text_crc32, shard, slot, item``.
    """
    data = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(data) + F.lit(8)).cast("bigint").alias("size"),
            word_count(F.col(text_col)).alias("words"),
            F.crc32(data).alias("text_crc32"),
            F.xxhash64(data).alias("group"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count(F.lit(1)).alias("r")).first()
    if not total["r"]:
        return rows.select(
            "doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"),
            F.lit("").alias("item"),
        )
    share = F.greatest(
        F.col("b") / F.lit(float(total["b"])), F.col("w") / F.lit(float(max(total["w"], 1))),
        F.col("r") / F.lit(float(total["r"])),
    )
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("b"), F.sum("words").alias("w"), F.count(F.lit(1)).alias("r")
    )
    # at most 3 * cells groups have such a share of one of the three sums
    large = groups.filter((share * F.lit(cells) > 1) & (F.col("r") > 1)).select(
        "group", F.ceil(share * F.lit(cells)).cast("bigint").alias("pieces"), (share * F.lit(float(shards))).alias("of_shard")
    )
    piece = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.col("pieces"))
    small = F.concat(F.lit("c"), F.pmod(F.col("group"), F.lit(cells)).cast("string"))
    placed = rows.join(F.broadcast(large), "group", "left").withColumns({
        "piece": F.coalesce(piece, F.lit(0).cast("bigint")),
        "item": F.when(F.col("pieces").isNull(), small).otherwise(F.concat_ws(".", F.lit("g"), "group")),
    })
    pieces = (
        placed.groupBy("item", "piece")
        .agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count(F.lit(1)).alias("r"), F.max("of_shard").alias("of_shard"))
        .toPandas().sort_values(["item", "piece"], ignore_index=True)
    )
    for part in (1.0, 0.5, 0.25, 0.125):
        parts = np.ceil(pieces["of_shard"].fillna(0.0) / part).clip(lower=1).astype(np.int64)
        pieces["part"] = pieces["piece"] % parts
        items = pieces.groupby(["item", "part"], as_index=False)[["b", "w", "r"]].sum()
        items["shard"] = place(items[["b", "w", "r"]].to_numpy(dtype=np.float64), shards)
        filled = np.bincount(items["shard"], items["b"], shards)
        if filled.max() - filled.min() <= uneven * filled.mean():
            break
    pieces = pieces.merge(items[["item", "part", "shard"]], on=["item", "part"])
    pieces["start"] = pieces.groupby("shard")["r"].cumsum() - pieces["r"]
    homes = docs.sparkSession.createDataFrame(
        pieces[["item", "piece", "shard", "start"]], "item string, piece bigint, shard int, start bigint"
    )
    inside = Window.partitionBy("item", "piece").orderBy("doc_id", "group")
    numbered = placed.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(homes), ["item", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).alias("slot"), "item"
    )
