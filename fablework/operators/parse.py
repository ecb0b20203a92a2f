"""Parsing rendered or generated text back into its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import computed_once, strip
from .render import INSTRUCTION_KEYS, STORY_PREFIX

# Feature names in label order, the story marker, the instruction markers.
FEATURE_NAMES = ("twist", "foreshadowing", "dialogue", "badending", "moralvalue", "conflict")
STORY_MARK = "\n" + STORY_PREFIX
ANY_INSTRUCTION = "|".join(key + ": " for key in INSTRUCTION_KEYS)


def extract_story(text: Column) -> Column:
    """Text between the first and second story marker, up to the next instruction marker."""
    story = F.try_element_at(F.split(text, STORY_MARK, -1), F.lit(2))
    return F.element_at(F.split(story, ANY_INSTRUCTION, -1), 1)


def feature_line(text: Column) -> Column:
    """Content of the first features line; null when there is none that ends in a newline."""
    pattern = r"Features: ([^\n]*)\n"
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def extract_features(text: Column) -> Column:
    """Feature names of the first features line, stripped and lower case."""
    line = feature_line(text)
    names = F.transform(F.split(line, ",", -1), lambda x: F.lower(strip(x)))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(names)


def multi_hot(names: Column, order: tuple[str, ...] = FEATURE_NAMES) -> Column:
    """0/1 vector in the fixed feature order."""
    return F.array(*[F.array_contains(names, f).cast("int") for f in order])


def unknown_features(names: Column, order: tuple[str, ...] = FEATURE_NAMES) -> Column:
    return F.array_except(names, F.array(*[F.lit(f) for f in order]))


def split_prefix(text: Column) -> tuple[Column, Column]:
    """Prompt up to and including the story marker, and the story as the target."""
    return F.concat(F.substring_index(text, STORY_MARK, 1), F.lit(STORY_MARK)), extract_story(text)


def labelled_stories(df: DataFrame, strict: bool = False) -> DataFrame:
    """Story text and multi-hot labels; rows that do not parse are dropped.

    ``unknown`` lists feature names outside the fixed six; ``strict`` makes them an error.
    """
    parts = F.struct(extract_story(F.col("text")).alias("story"), extract_features(F.col("text")).alias("names"))
    parsed = (
        computed_once(df, "_parts", parts)
        .filter(F.col("_parts.story").isNotNull() & F.col("_parts.names").isNotNull())
        .select(*df.columns, "_parts.story", "_parts.names")
    )
    unknown = unknown_features(F.col("names"))
    if strict:
        unknown = F.when(F.size(unknown) == 0, unknown).otherwise(
            F.raise_error(F.concat(F.lit("unknown feature: "), F.array_join(unknown, ", ")))
        )
    return parsed.select(*df.columns, "story", multi_hot(F.col("names")).alias("target"), unknown.alias("unknown"))


def prefix_rows(df: DataFrame) -> DataFrame:
    """Generation prompts and targets; rows without a story marker are dropped."""
    prefix, target = split_prefix(F.col("text"))
    return computed_once(df.withColumn("prefix", prefix), "target", target).filter(F.col("target").isNotNull())


def clean_generation(text: Column) -> Column:
    """Generated text before the first instruction marker, stripped."""
    return strip(F.element_at(F.split(text, ANY_INSTRUCTION, -1), 1))


def generation_rows(df: DataFrame, iteration: Column) -> DataFrame:
    """Generation table rows from four parallel lists and the iteration number."""
    lists = ("prefix", "clean_prefix", "generation", "target")
    zipped = F.arrays_zip(*lists)
    return df.select("*", F.posexplode(zipped).alias("row_idx", "_row")).select(
        F.col("row_idx").cast("bigint").alias("row_idx"),
        *[F.col("_row")[name].alias(name) for name in lists],
        iteration.alias("iter_num"),
    )
