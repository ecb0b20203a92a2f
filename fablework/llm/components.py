"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shuffles_removed, stored


def components(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """``node, component`` (the smallest node that links reach) for the ends of ``links(a, b)``.

    Alternates two steps until nothing changes: every node hands the smallest node it knows to
    its greater neighbours, then to its smaller ones. The number of rounds grows with the
    logarithm of the longest path, not with its length. The least neighbour is an aggregate
    that is joined back, so a node with very many links is combined before the shuffle and its
    join can be split. Each round is stored in the shared folder and goes after the next one; the last, which the
    result reads, is noted in ``scratch``.
    """
    former: list[str] = []
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "links", former,
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        last: list[str] = []
        edges = stored(small, "links", last)
        remove(edges.sparkSession, former)
        former = last
        with shuffles_removed(edges.sparkSession):
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    if scratch is not None:
        scratch += former
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )
