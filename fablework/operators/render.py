"""Rendering an annotated story as training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capitalise, computed_once, one_line, strip, uniform

# Names of the instruction lines and of the story line.
INSTRUCTION_KEYS = ("Words", "Features", "Summary", "Sentence")
STORY_PREFIX = "Story: "


def sentence_candidates(story: Column) -> Column:
    """Fragments between ``.``, ``!`` and ``?`` that hold no double quote.

    The piece after the last mark counts too, even when it is empty.
    """
    return F.filter(F.split(story, "[.!?]", -1), lambda s: ~F.contains(s, F.lit('"')))


def choose_sentence(candidates: Column, key: Column, seed: int = 0, purpose: str = "sentence") -> Column:
    """One candidate drawn by hash, stripped, without line breaks; null if there is none."""
    u = uniform(seed, purpose, key)
    return one_line(F.try_element_at(candidates, F.floor(u * F.size(candidates)).cast("int") + F.lit(1)))


def picked_sentence(story: Column, key: Column, seed: int = 0, purpose: str = "sentence") -> Column:
    """``choose_sentence`` straight from the story; the lambda splits it only once."""
    chosen = F.transform(F.array(sentence_candidates(story)), lambda c: choose_sentence(c, key, seed, purpose))
    return F.element_at(chosen, 1)


def instruction_lines(seed: int = 0) -> dict[str, Column]:
    """Value of each instruction line of a ``renderable`` row."""
    picked = choose_sentence(F.col("candidates"), F.col("story_id"), seed)
    return {
        "Words": F.array_join("words", ", "),
        "Features": F.array_join(F.transform("features", capitalise), ", "),
        "Summary": one_line(F.col("summary")),
        "Sentence": F.coalesce(F.col("sentence"), picked),
    }


def has_parts() -> Column:
    """Whether a row has all that is rendered: story, summary, words and features (a sentence may be picked)."""
    return (
        F.col("story").isNotNull() & F.col("summary").isNotNull()
        & F.col("words").isNotNull() & F.col("features").isNotNull()
    )


def renderable(df: DataFrame) -> DataFrame:
    """Rows with all parts and a sentence to pick, and their ``candidates``; others cannot be rendered."""
    found = computed_once(df.filter(has_parts()), "candidates", sentence_candidates(F.col("story")))
    return found.filter(F.size("candidates") > 0)


def render_counts(df: DataFrame) -> DataFrame:
    """Rendered and skipped rows per shard; together they are all rows."""
    fits = F.coalesce(has_parts() & (F.size(sentence_candidates(F.col("story"))) > 0), F.lit(False))
    ok = fits.cast("bigint")
    return df.groupBy("shard_key").agg(
        F.sum(ok).alias("rendered"), F.sum(F.lit(1).cast("bigint") - ok).alias("skipped")
    )


def training_text(subset: str | list[str] | None = None, seed: int = 0) -> Column:
    """Text of a ``renderable`` row: lines in hashed order, then the story, the whole stripped."""
    wanted = subset.split(",") if isinstance(subset, str) else list(subset or INSTRUCTION_KEYS)
    lines = [
        F.struct(
            uniform(seed, "line-" + key, F.col("story_id")).alias("u"),
            F.concat(F.lit(key + ": "), value).alias("line"),
        )
        for key, value in instruction_lines(seed).items()
        if key in wanted
    ]
    story_line = F.concat(F.lit(STORY_PREFIX), strip(F.col("story")))
    if not lines:
        return strip(story_line)
    ordered = F.transform(F.sort_array(F.array(*lines)), lambda s: s["line"])
    return strip(F.array_join(F.array_append(ordered, story_line), "\n"))


def render(df: DataFrame, subset: str | list[str] | None = None, seed: int = 0) -> DataFrame:
    """``(shard_key, story_id, text)`` of every row that can be rendered."""
    rows = computed_once(renderable(df), "text", training_text(subset, seed))
    return rows.select("shard_key", "story_id", "text")
