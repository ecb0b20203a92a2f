"""Scoring jobs: labelled sets and generation tables, through the score cache."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, scoring, splits
from ..operators.parse import clean_generation
from ..session import fresh_path
from ..sources.writers import read_failures, read_scores, write_new_scores


#: A run has at most so many slices, so that a large table costs no job for each few rows.
MOST_SLICES = 64
#: Prompts of a file of a slice.
FILE_ROWS = 5_000


def first_of_version(generations: DataFrame, subset: int | None) -> DataFrame:
    """The first ``subset`` rows of each table version; rows are numbered from 0 there."""
    return generations if subset is None else generations.filter(F.col("row_idx") < subset)


def generation_prompts(
    generations: DataFrame, question: str, model: str, subset: int | None = None
) -> DataFrame:
    """Prompts of cleaned generations with their cache ids."""
    chosen = first_of_version(generations, subset).withColumn("story", clean_generation(F.col("generation")))
    prompts = chosen.withColumn("prompt", scoring.zero_shot_prompt(F.col("story"), question))
    return scoring.with_cache_id(prompts, model)


@dataclass(frozen=True)
class ScoringRun:
    """What a run did: distinct prompts asked, answered, and left with an error."""

    asked: int
    answered: int
    failed: int


class ScoringStopped(RuntimeError):
    """Too many prompts failed; the answers so far are in the cache."""


def fill_cache(
    prompts: DataFrame, cache_path: str, scorer: scoring.Scorer, question: str, slice_rows: int = 100_000,
    retry: scoring.Retry = scoring.Retry(), parallel: int | None = None, batch_rows: int | None = None, most_failed: int | None = None,
) -> ScoringRun:
    """Ask the scorer for every prompt ``(cache_id, prompt)`` that the cache table lacks.

    The missing prompts are written to the shared folder and worked off in slices of about
    ``slice_rows``, or larger ones where these would be more than ``MOST_SLICES``. The answers of a slice, and the errors of prompts that keep failing, are committed
    together before the next slice begins, so a run that dies loses the slice it was at, and the next
    run asks what is still missing. ``retry`` is dealt over the slices and their tasks. More than
    ``most_failed`` failing prompts end the run after their slice. Null prompts are not asked.
    """
    spark = prompts.sparkSession
    known = read_scores(spark, cache_path, distinct=False)
    path = fresh_path(spark, "prompts")
    scoring.missing(prompts, known).filter(F.col("prompt").isNotNull()).write.parquet(path)
    todo = spark.read.parquet(path)
    total = todo.count()
    slices = max(1, min(-(-total // slice_rows), MOST_SLICES))
    if slices > 1:
        path = fresh_path(spark, "slices")
        sliced = todo.withColumn("slice", F.pmod(F.xxhash64("cache_id"), F.lit(slices)).cast("int"))
        files = -(-total // (slices * FILE_ROWS))  # of a slice, which no single task has to write or read
        part = F.pmod(F.xxhash64("cache_id", F.lit(1)), F.lit(files))
        sliced.repartition("slice", part).write.partitionBy("slice").parquet(path)
        todo = spark.read.schema("cache_id string, prompt string, slice int").parquet(path)
    dealt = retry if retry.total is None else replace(retry, total=retry.total // slices)
    failed = 0
    for number in range(slices if total else 0):
        rows = todo.filter(F.col("slice") == number) if slices > 1 else todo
        answers = scoring.score_prompts(rows, scorer, parallel or spark.sparkContext.defaultParallelism, dealt, batch_rows)
        write_new_scores(scoring.with_scores(answers, question), cache_path, total)
        if most_failed is not None:
            failed = _failed(spark, cache_path, todo)
            if failed > most_failed:
                raise ScoringStopped(f"{failed} prompts failed by slice {number + 1} of {slices}")
    failed = _failed(spark, cache_path, todo) if total else 0
    return ScoringRun(total, total - failed, failed)


def _failed(spark, cache_path: str, todo: DataFrame) -> int:
    return read_failures(spark, cache_path).join(todo.select("cache_id"), "cache_id", "left_semi").count()


def scored_rows(prompts: DataFrame, cache_path: str) -> DataFrame:
    """Every prompt row whose answer the cache holds, with its score; nothing is asked."""
    return prompts.join(read_scores(prompts.sparkSession, cache_path), "cache_id")


def generation_report(
    generations: DataFrame,
    cache_path: str,
    scorer: scoring.Scorer | None,
    question: str,
    model: str,
    subset: int | None = None,
) -> DataFrame:
    """Score summary of each table version.

    With a ``scorer`` missing prompts are asked first, before this returns; without one the report
    covers what the cache holds.
    """
    prompts = generation_prompts(generations, question, model, subset)
    if scorer is not None:
        fill_cache(prompts, cache_path, scorer, question)
    return metrics.version_summary(scored_rows(prompts.drop("prompt"), cache_path))


@dataclass(frozen=True)
class Evaluation:
    """A scored labelled set: rates, the distribution of scores by label, and the mistakes."""

    rows: DataFrame
    rates: DataFrame
    scores: DataFrame
    mistakes: DataFrame


def classifier_report(
    labelled: DataFrame, cache_path: str, scorer: scoring.Scorer | None, question: str, model: str,
    shots_per_class: int = 0, shots: DataFrame | None = None, seed: int = 0,
    templates: scoring.Templates = scoring.DEFAULT,
) -> Evaluation:
    """Score a labelled set and compare with its labels; a ``scorer`` is asked for what the cache lacks.

    With ``shots_per_class`` the first stories of each class become examples in front of
    every prompt and leave the set; ``shots`` gives the example text (a row with ``shots``)
    instead, and then no story leaves.
    """
    rest = labelled
    if shots is None and shots_per_class:
        chosen = splits.class_slice(labelled, shots_per_class)
        shots = scoring.join_shots(chosen, question, seed, templates)
        rest = splits.minus(labelled, F.broadcast(chosen.select("story_id")), "story_id")  # a few rows
    story = F.col("story")
    prompt = (
        scoring.zero_shot_prompt(story, question, templates) if shots is None
        else scoring.few_shot_prompt(story, question, shots, templates)
    )
    prompts = scoring.with_cache_id(rest.select("story_id", "label", prompt.alias("prompt")), model)
    if scorer is not None:
        fill_cache(prompts, cache_path, scorer, question)
    rows = scored_rows(prompts, cache_path).select("story_id", "label", "score", "content")
    return Evaluation(rows, metrics.confusion(rows), metrics.describe(rows, "score", ["label"]), metrics.mistakes(rows))
