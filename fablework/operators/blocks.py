"""Token streams, fixed and document-aligned blocks, training pairs and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import ID_BITS, id_bucket, running_total


def token_offsets(encoded: DataFrame, id_bits: int = ID_BITS, lengths: DataFrame | None = None) -> DataFrame:
    """Start of each story in the token stream of its shard, and the stream's length.

    Needs ``(shard_key, story_id, tokens)``; adds ``before`` and ``total``. The running
    sum works on story lengths in buckets of story ids, so a shard of any size is cut up.
    ``id_bits`` fits dense ids; ids that are hashes spread over 64 bits want about 48, so
    that a bucket holds many of them. A stored dataset has both columns already and is
    returned as it is.

    ``lengths`` gives ``(shard_key, story_id, n_tokens)`` where they are known without the
    tokens. Then only these narrow rows are numbered and joined to the tokens, which the
    encoding has gathered by story already.
    """
    if {"before", "total"} <= set(encoded.columns):
        return encoded
    if lengths is not None:
        placed = running_total(
            lengths.select("shard_key", "story_id", "n_tokens"),
            ["shard_key"],
            ["story_id"],
            [id_bucket(F.col("story_id"), id_bits)],
            F.col("n_tokens").cast("bigint"),
            before="before",
            total="total",
        )
        return encoded.join(placed.drop("n_tokens"), ["shard_key", "story_id"])
    return running_total(
        encoded,
        ["shard_key"],
        ["story_id"],
        [id_bucket(F.col("story_id"), id_bits)],
        F.size("tokens").cast("bigint"),
        before="before",
        total="total",
    )


def _windows(stream: DataFrame, length: int, span: int, *extra: Column) -> DataFrame:
    """Stream tokens ``[k*length, k*length + span)`` for every k, as one array per window.

    Stories are cut into the pieces each window needs and only the pieces are shuffled;
    a window gathers at most ``span`` of them.
    """
    end = F.col("before") + F.size("tokens")
    first = F.greatest(F.lit(0), F.ceil((F.col("before") - F.lit(span - 1)) / F.lit(length)).cast("bigint"))
    last = F.floor((end - 1) / F.lit(length)).cast("bigint")
    lo = F.greatest(F.col("before"), F.col("block") * length)
    hi = F.least(end, F.col("block") * length + F.lit(span))
    pieces = (
        stream.filter(F.size("tokens") > 0)
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select(
            "shard_key",
            "block",
            "total",
            F.col("before").alias("at"),
            (F.col("before") + F.size("tokens") < F.col("total")).alias("followed"),
            F.slice("tokens", (lo - F.col("before") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"),
        )
    )
    return pieces.groupBy("shard_key", "block").agg(
        F.first("total").alias("total"),
        F.flatten(F.sort_array(F.collect_list(F.struct("at", "piece")))["piece"]).alias("tokens"),
        *extra,
    )


def fixed_blocks(stream: DataFrame, length: int) -> DataFrame:
    """Blocks of ``length + 1`` tokens at multiples of ``length``.

    The last full block of each shard is left out, as is the remainder after it.
    """
    whole = _windows(stream, length, length + 1).filter(
        F.col("block") < F.floor(F.col("total") / F.lit(length)) - 1
    )
    return whole.select("shard_key", "block", F.col("tokens").alias("chunk"))


def bos_blocks(stream: DataFrame, length: int, bos: int | None = None) -> DataFrame:
    """Blocks of ``length + 1`` tokens that begin where a story begins.

    A story is a row, or with ``bos`` begins at each such token, wherever the rows of the stream were cut.

    Every story is one start, but the last of the shard is none, and a block that the end
    of the stream cuts short is left out. A start in window k needs tokens of windows k and
    k + 1 only, so windows of twice the length hold whole blocks.
    """
    if bos is not None:
        return _blocks_at(stream, length, bos)
    at, block = F.col("at"), F.col("block")
    mine = (at >= block * length) & (at < (block + 1) * length) & F.col("followed")
    windows = _windows(stream, length, 2 * length, F.collect_list(F.when(mine, at)).alias("starts"))
    begun = windows.select("shard_key", "block", "tokens", F.explode("starts").alias("start"))
    offset = (F.col("start") - block * length + 1).cast("int")
    cut = begun.select("shard_key", "start", F.slice("tokens", offset, length + 1).alias("chunk"))
    return cut.filter(F.size("chunk") == length + 1)


def _blocks_at(stream: DataFrame, length: int, bos: int) -> DataFrame:
    windows = _windows(stream, length, 2 * length)
    own = F.slice("tokens", 1, length)
    offsets = F.filter(F.transform(own, lambda t, i: F.when(t == bos, i)), lambda i: i.isNotNull())
    begun = windows.select("shard_key", "block", "tokens", F.explode(offsets).alias("_at"))
    begun = begun.select(
        "shard_key", (F.col("block") * length + F.col("_at")).alias("start"), F.slice("tokens", F.col("_at") + 1, length + 1).alias("chunk")
    )
    last = begun.groupBy("shard_key").agg(F.max("start").alias("_last"))  # a row for each shard
    return begun.join(last, "shard_key").filter((F.col("start") < F.col("_last")) & (F.size("chunk") == length + 1)).drop("_last")


def training_pairs(blocks: DataFrame, length: int) -> DataFrame:
    """Input ``x`` and the same tokens shifted by one as ``y``."""
    return blocks.select(
        *[c for c in blocks.columns if c != "chunk"],
        F.slice("chunk", 1, length).alias("x"),
        F.slice("chunk", 2, length).alias("y"),
    )


def block_list(totals: DataFrame, length: int, run: int = 65536) -> DataFrame:
    """``(shard_key, block)`` of all fixed blocks, from the stream lengths alone.

    Long shards are listed in runs of block numbers that are spread before they are
    written out.
    """
    count = F.floor(F.col("total") / F.lit(length)).cast("bigint") - 1
    runs = (
        totals.withColumn("_blocks", count)
        .filter(F.col("_blocks") > 0)
        .select("shard_key", "_blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1, F.lit(run).cast("bigint"))).alias("_from"))
        .repartition("shard_key", "_from")
    )
    upto = F.least(F.col("_from") + F.lit(run), F.col("_blocks")) - 1
    return runs.select("shard_key", F.explode(F.sequence(F.col("_from"), upto)).alias("block"))


def pad_left(rows: DataFrame, batch: str = "batch_id", place: str = "place") -> DataFrame:
    """Pad the rows of a batch on the left to the longest of them.

    Needs ``tokens`` (the row itself) and ``suffix`` (its story tokens). The filler of row i is read
    backwards from the suffixes of rows i+1, i+2, … of the batch, around the end and again as long as
    tokens are missing. ``place`` tells the rows of a batch apart.

    The suffixes of a batch, last row first, form a ring, and the filler of a row is the stretch of
    it that ends where the row's own suffix begins. Lengths alone are numbered; stretch and
    suffix meet by cells of the ring, and only the pieces a row lacks are sent to it. So the work is in
    proportion to the padding, and no row ever holds a batch. Without any suffix token nothing is padded.
    """
    whole = Window.partitionBy(batch)
    later = whole.orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    own, size = F.size("suffix").cast("bigint"), F.size("tokens").cast("bigint")
    ring = rows.select(batch, place, own.alias("_own"), size.alias("_size")).select(
        batch, place, "_own",
        F.coalesce(F.sum("_own").over(later), none).alias("_from"),
        F.sum("_own").over(whole).alias("_ring"),
        (F.max("_size").over(whole) - F.col("_size")).alias("_missing"),
        F.greatest(F.floor(F.sum("_own").over(whole) / F.count(F.lit(1)).over(whole)), F.lit(1).cast("bigint")).alias("_cell"),
    )

    def cells(first: Column, past: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / F.col("_cell")), F.floor((past - 1) / F.col("_cell")))).alias("_at_cell")

    # the stretch [from - missing, from), cut where the ring closes; places below 0 are earlier rounds
    begin, length = F.col("_from") - F.col("_missing"), F.col("_ring")
    rounds = F.explode(F.sequence(F.floor(begin / length), F.floor((F.col("_from") - 1) / length))).alias("_round")
    stretches = ring.filter((F.col("_missing") > 0) & (F.col("_ring") > 0)).select(
        batch, place, "_cell", "_ring", begin.alias("_begin"), F.col("_from").alias("_end"), rounds
    )
    low = F.greatest(F.col("_begin") - F.col("_round") * length, none)
    high = F.least(F.col("_end") - F.col("_round") * length, length)
    wanted = stretches.select(batch, place, "_cell", (F.col("_round") * length).alias("_turn"), low.alias("_low"), high.alias("_high"))
    wanted = wanted.select("*", cells(F.col("_low"), F.col("_high")))
    past = F.col("_from") + F.col("_own")
    offered = ring.filter(F.col("_own") > 0).select(
        batch, F.col(place).alias("_giver"), F.col("_from").alias("_first"), past.alias("_past"), cells(F.col("_from"), past)
    )
    meet_low, meet_high = F.greatest("_low", "_first"), F.least("_high", "_past")
    met = wanted.join(offered, [batch, "_at_cell"]).filter(
        (meet_low < meet_high) & (F.col("_at_cell") == F.floor(meet_low / F.col("_cell")))  # once, where both begin to overlap
    ).select(
        batch, place, "_giver", (F.col("_turn") + meet_low).alias("_at"),
        (meet_low - F.col("_first") + 1).cast("int").alias("_start"), (meet_high - meet_low).cast("int").alias("_n"),
    )
    givers = rows.select(batch, F.col(place).alias("_giver"), "suffix")
    pieces = met.join(givers, [batch, "_giver"]).select(batch, place, "_at", F.slice("suffix", F.col("_start"), F.col("_n")).alias("_piece"))
    filler = pieces.groupBy(batch, place).agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("_at", "_piece")))["_piece"]).alias("_filler")
    )
    nothing = F.array().cast(rows.schema["tokens"].dataType)
    return rows.select(batch, place, "tokens").join(filler, [batch, place], "left").select(
        batch, place, F.concat(F.coalesce("_filler", nothing), F.col("tokens")).alias("padded")
    )


def sequence_stats(encoded: DataFrame, bos: int = 1) -> DataFrame:
    """Tokens, stories begun and mean tokens per story."""
    begun = F.size(F.filter("tokens", lambda t: t == bos)).cast("bigint")
    return encoded.agg(
        F.sum(F.size("tokens").cast("bigint")).alias("tokens"), F.sum(begun).alias("begun")
    ).withColumn("mean_length", F.col("tokens") / F.col("begun"))


__all__ = [
    "block_list",
    "bos_blocks",
    "fixed_blocks",
    "id_bucket",
    "pad_left",
    "sequence_stats",
    "token_offsets",
    "training_pairs",
]
