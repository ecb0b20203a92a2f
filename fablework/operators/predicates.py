"""The subset predicate language and row selection by annotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import options

LIST_KEYS = ("features", "words")


def story_filter(spec: str | None, ignore_case: bool = False) -> Column:
    """Condition for ``"features=A,words!=b,length=100"``; ``None`` keeps every row.

    ``features`` and ``words`` test exact membership. ``length=N`` means *longer than* N
    code points and ``length!=N`` the opposite. All conditions must hold. A key that is
    not known raises here, when the plan is built.
    """
    if spec is None:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [_condition(part, ignore_case) for part in options.parts(spec)])


def _condition(part: options.Part, ignore_case: bool) -> Column:
    key, negated, value = options.condition(part)
    if key in LIST_KEYS:
        held = F.transform(key, F.lower) if ignore_case else F.col(key)
        test = F.array_contains(held, value.lower() if ignore_case else value)
    elif key == "length":
        test = F.char_length("story") > F.lit(int(value))
    else:
        raise ValueError(f"unknown filter key: {key}")
    return ~test if negated else test


def keep(df: DataFrame, spec: str | None, ignore_case: bool = False) -> DataFrame:
    return df if spec is None else df.filter(story_filter(spec, ignore_case))


def label_by_feature(df: DataFrame, feature: str, ignore_case: bool = False) -> DataFrame:
    """Both classes in one pass: ``label`` is 1.0 with the feature and 0.0 without it."""
    has = story_filter(f"features={feature}", ignore_case)
    return df.withColumn("label", has.cast("double"))


def with_all_tags(df: DataFrame, required: list[str], column: str = "tags") -> DataFrame:
    """Rows whose tag list contains every required tag."""
    wanted = F.array(*[F.lit(t) for t in required])
    return df.filter(F.size(F.array_except(wanted, F.col(column))) == 0)


def kept_share(df: DataFrame, spec: str | None) -> DataFrame:
    """Kept and total rows per shard with their ratio."""
    hit = F.coalesce(story_filter(spec), F.lit(False)).cast("bigint")
    return df.groupBy("shard_key").agg(
        F.sum(hit).alias("kept"),
        F.count(F.lit(1)).alias("total"),
        F.avg(hit.cast("double")).alias("ratio"),
    )


def filter_proportion(df: DataFrame, spec: str | None) -> DataFrame:
    """Unweighted mean of the shard ratios; a shard with no kept row counts as 0."""
    return kept_share(df, spec).agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("kept").alias("kept"),
        F.sum("total").alias("total"),
        F.avg("ratio").alias("proportion"),
    )
