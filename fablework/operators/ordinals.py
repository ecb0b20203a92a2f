"""Row numbers, prefix sums and neighbour windows that survive a hot group.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends a whole group to one task, so a
group with a third of all rows stops the job. Here every order key comes with a *bucket*:
an expression that never decreases along the order and that holds few rows per value.
Rows are numbered inside ``(group, bucket)``; the starts of the buckets come from a small
table with one row per bucket. The result is the same number the plain window would give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BITS = 16
BROADCAST_ROWS = 200_000


def id_bucket(c: Column, bits: int = ID_BITS) -> Column:
    """Bucket of a unique integer key; at most ``2**bits`` rows share one."""
    return F.shiftright(c.cast("bigint"), bits)


def unit_bucket(u: Column, buckets: int = 65536) -> Column:
    """Bucket of a uniform number; rows spread evenly whatever their group."""
    return F.floor(u * F.lit(float(buckets))).cast("bigint")


def magnitude_bucket(c: Column, fineness: float = 1e5) -> list[Column]:
    """Bucket of a double by sign and logarithm: values within about 0.001 % share one."""
    size = F.floor(F.ln(F.abs(c)) * F.lit(fineness)).cast("bigint")
    sign = F.when(F.isnan(c), 2).otherwise(F.signum(c).cast("int"))
    return [sign, F.when(F.isnan(c) | (c == 0), F.lit(0).cast("bigint")).when(c > 0, size).otherwise(-size)]


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    value: Column | None = None,
    before: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over earlier rows of the group (0 for the first).

    Without ``value`` rows are counted, which makes ``before`` a 0-based ordinal. ``total``
    names an optional column with the sum over the whole group. Group keys must not be
    null. ``bucket`` may be several columns, compared in the given order.
    """
    group = list(group)
    names = [f"_bucket{i}" for i in range(len(bucket))]
    amount = F.lit(1).cast("bigint") if value is None else value
    rows = df.select("*", amount.alias("_amount"), *[b.alias(n) for b, n in zip(bucket, names)])

    sums = rows.groupBy(*group, *names).agg(F.sum("_amount").alias("_sum"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(sums.schema["_sum"].dataType)
    starts = sums.select(
        *group,
        *names,
        F.coalesce(F.sum("_sum").over(earlier), zero).alias("_start"),
        *([F.sum("_sum").over(whole).alias(total)] if total else []),
    )

    inside = (
        Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = rows.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), zero))
    joined = numbered.join(starts, [*group, *names])
    return joined.select(
        *df.columns,
        (F.col("_start") + F.col("_inside")).alias(before),
        *([F.col(total)] if total else []),
    )


def running_min(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    value: str,
    before: str = "min_before",
) -> DataFrame:
    """Add the least ``value`` of the earlier rows of the group, null for the first."""
    group = list(group)
    names = [f"_bucket{i}" for i in range(len(bucket))]
    rows = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    earlier = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*group, *names)
        .agg(F.min(value).alias("_least"))
        .select(*group, *names, F.min("_least").over(earlier).alias("_start"))
    )
    inside = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_inside", F.min(value).over(inside))
    joined = numbered.join(starts, [*group, *names])
    return joined.select(*df.columns, F.least("_start", "_inside").alias(before))


def ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    name: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group, and optionally the size of the group."""
    return running_total(df, group, order, bucket, before=name, total=total)


def first_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    count: int,
    start: int = 0,
    name: str = "idx",
    max_groups: int | None = None,
) -> DataFrame:
    """Rows ``[start, start + count)`` of each group.

    Only the buckets that reach into the wanted range are read on: each of them holds at
    least one row, so at most ``count`` of them exist per group. Give ``max_groups``
    when the number of groups is known; if the bound then allows it, the bucket list is
    broadcast and all other rows are dropped before anything is shuffled.
    """
    group = list(group)
    names = [f"_wanted{i}" for i in range(len(bucket))]
    rows = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    sizes = rows.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        sizes.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0).cast("bigint")))
        .filter((F.col("_start") < start + count) & (F.col("_start") + F.col("_size") > start))
        .drop("_size")
    )
    if max_groups is not None and max_groups * count <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    inside = Window.partitionBy(*group, *names).orderBy(*order)
    near = rows.join(wanted, [*group, *names])
    return (
        near.withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .filter((F.col(name) >= start) & (F.col(name) < start + count))
        .select(*df.columns, name)
    )


def with_halo(
    df: DataFrame,
    position: str,
    chunk_rows: int,
    behind: int = 0,
    ahead: int = 0,
    chunk: str = "chunk",
    own: str = "own",
) -> DataFrame:
    """Cut numbered rows into chunks and copy edge rows into the chunks beside them.

    A window over ``(group, chunk)`` then sees the ``behind`` rows before and the ``ahead``
    rows after each of its own rows, and no task sees more than
    ``chunk_rows + behind + ahead`` rows. Keep the rows with ``own`` afterwards.
    """
    if max(behind, ahead) > chunk_rows:
        raise ValueError("a chunk must be longer than its halo")
    at = F.col(position)
    home = F.floor(at / F.lit(chunk_rows)).cast("bigint")
    lowest = F.floor((at - F.lit(ahead)) / F.lit(chunk_rows)).cast("bigint")
    highest = F.floor((at + F.lit(behind)) / F.lit(chunk_rows)).cast("bigint")
    return df.withColumn("_home", home).select(
        *df.columns,
        F.explode(F.sequence(lowest, highest)).alias(chunk),
        "_home",
    ).select(*df.columns, chunk, (F.col(chunk) == F.col("_home")).alias(own))
