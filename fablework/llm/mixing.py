"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fablework.operators.ordinals import running_total

from .common import remaining, stored, unused, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, most: float) -> DataFrame:
    """Targets of the sources: shares of ``budget`` times all sizes, ``most`` times the own size at most.

    ``sizes`` has one row ``(queue, source, source_size)`` a source, null included. The weights go
    round over the sources in order of code points, null last. What a capped source leaves
    is shared by weight until none is above its cap, which is the water level ``level`` with
    ``sum(min(cap, level * weight)) = budget``: sources are ordered by the level at which they
    are full, and the first one that the level of the rest doesn't fill gives the level.
    Adds ``weight`` and ``target``.
    """
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    whole = Window.partitionBy()
    fill = Window.orderBy("full_at", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("rest", F.col("wanted") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
        .withColumn(
            "rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
        )
        .withColumn("level_here", F.col("rest") / F.col("rest_weight"))
    )
    level = F.max(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))).over(whole)
    return ranked.withColumn("level", level).select(
        "queue", "source", "source_size", "weight",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    slices: int = 65536,
) -> DataFrame:
    """How many words of each document a mix takes whose sources come to their targets.

    Weighted fair queueing: the documents of a source are shuffled (by a hash of id, text and
    ``seed``) and queue, in as many rounds as ``most`` allows. A document's virtual finish
    time is the number of source words up to its end, divided by the source's target. All
    services are put into the global order of finish times and truncated at the budget; a
    service in progress at that time (virtual time 1, as the targets sum up to the budget)
    is cut to the part that is done, so that each source comes to its target by the word.
    Neither a source nor the mix is sorted in one task: running sums are taken in ``slices``
    of the shuffled order and of virtual time, and a row per slice carries them over.

    Sizes are words; a null text has none. A null source is a source. Null ids and repeated
    rows are documents like any other (equal rows are served one after the other). An empty
    table gives no rows; texts without words are never taken. Other columns are not read.

    Returns ``doc_id, text_hash, source, size, source_size, weight, target, before, taken, mix_start`` with
    ``before`` (words of the source ahead in a round) and ``mix_start`` (words of the mix ahead
    of the document's first service; null if it has none).
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"),
        )
        .withColumn("key", key)
        .withColumn("queue", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))),
        "mix-rows",
    )
    sizes = rows.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, budget, most), "mix-targets")
    place = F.shiftright(F.col("key"), 52) + F.lit(2048)  # 4096 slices of the shuffled order
    queued = running_total(rows, ["queue"], ["key", "doc_id", "text_hash"], [place], F.col("size"), "before")
    queued = stored(queued.join(targets.drop("source"), "queue"), "mix-queue")

    rounds = math.ceil(most)
    ahead = F.col("before") + F.col("round") * F.col("source_size")
    services = (
        queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
        .select(
            "queue", "before", "size", "target", ahead.alias("start"), "round",
            ((ahead + F.col("size")) / F.col("target")).alias("finish"),
            F.least(F.col("size"), F.round("target").cast("bigint") - ahead).alias("part"),
        )
        .filter(F.col("part") > 0)
    )
    slice_ = F.floor(F.col("finish") * F.lit(float(slices))).cast("bigint")
    ordered = running_total(services, [], ["finish", "queue", "start"], [slice_], F.col("part"), "mix_start")
    whole = rows.agg(F.sum("size").alias("words")).select((F.col("words") * F.lit(float(budget))).alias("wanted"))
    taken = (
        ordered.join(F.broadcast(whole))  # one row
        .withColumn("done", F.when(F.col("mix_start") < F.col("wanted"), F.col("part")).otherwise(0))
        .groupBy("queue", "before")
        .agg(F.sum("done").alias("done"), F.min(F.when(F.col("done") > 0, F.col("mix_start"))).alias("mix_start"))
        .withColumn("some", F.lit(True))
    )
    most_words = F.floor(F.col("size") * F.lit(float(most))).cast("bigint")
    return (
        queued.withColumn("some", F.col("size") > 0)
        .join(taken, ["queue", "before", "some"], "left")
        .select(
            "doc_id", "text_hash", "source", "size", "source_size", "weight", "target", "before",
            F.least(F.coalesce("done", F.lit(0)), most_words).cast("bigint").alias("taken"), "mix_start",
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix: a row for each time that a document is taken, with the words taken.

    All columns stay. Documents that are not taken are left out; the last service of a source
    may hold the first words of a document only. Rows that repeat id and text count as one
    document.
    """
    cut_at = unused(docs, "mix_words")
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, **options).filter(F.col("taken") > 0)
    taken = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.max("size").alias("_size"), F.max("taken").alias("_taken")
    )
    schema = docs.schema
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    same = docs[id_col].eqNullSafe(taken["_id"]) & (F.xxhash64(docs[text_col]) == taken["_hash"])
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_round") * F.col("_size"))
    services = (
        docs.join(taken, same).select(whole, "_size", "_taken")
        .select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("_round"))
        .select("_row.*", F.when(words < F.col("_size"), words).alias(cut_at))
    )

    def cut(batches):
        at = schema.names.index(text_col)
        for batch in batches:
            words = batch[cut_at].to_pylist()
            columns = [batch[c] for c in schema.names]
            if any(n is not None for n in words):
                texts = columns[at].to_pylist()
                columns[at] = pa.array(
                    [t if n is None else remaining(t, [(n, len(t))]) for t, n in zip(texts, words)], pa.string()
                )
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return services.mapInArrow(cut, schema)
