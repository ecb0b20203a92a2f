"""Prompts, answers and the score cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import Formatter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cache_id, strip, uniform

SYSTEM = "You help by answering questions about stories for children."


@dataclass(frozen=True)
class Templates:
    """Prompt texts of a study; ``{name}`` marks what is filled in. Cache keys depend on them."""

    zero_shot: str = (
        "Below is a story for children. Answer this question about it: {question} Reply with Yes or No only."
        "\n\n{story}\n\n{question}"
    )
    example: str = "Example story: {story}\nWhy: {reasoning}\n{question} {answer}"
    few_shot: str = "{shots}\n\nStory: {story}\nExplain in one sentence, then answer.\n{question}"
    between: str = "\n\n"  # of two examples


DEFAULT = Templates()

#: Prompts of a call where the caller names no number.
CALL_ROWS = 1_000

SCORED_SCHEMA = "cache_id string, content string, error string, attempts int"

Scorer = Callable[[pd.Series], pd.Series]


@dataclass(frozen=True)
class Retry:
    """What a task does when the scorer raises an error or gives no answer.

    A batch that fails is halved until the prompt at fault stands alone; that one is asked up to
    ``attempts`` times with a growing wait in between. ``total`` limits the repeated calls of a run over
    all its tasks, which get equal shares; a task without any left reports its failing prompts at once.
    """

    attempts: int = 4
    first_wait: float = 0.5  # seconds
    factor: float = 2.0
    longest_wait: float = 60.0
    total: int | None = None

    def wait(self, failures: int) -> float:
        return min(self.first_wait * self.factor ** (failures - 1), self.longest_wait)


def question_about(feature: str) -> str:
    return f"Does the story have a {feature}?"


def fill(template: str, **parts: Column | str) -> Column:
    """A template with its ``{name}`` places taken by columns; what is filled in is never read again."""
    pieces: list[Column] = []
    for before, name, _, _ in Formatter().parse(template):
        pieces.append(F.lit(before))
        if name is not None:
            pieces.append(parts[name] if isinstance(parts[name], Column) else F.lit(parts[name]))
    return F.concat(*pieces)


def zero_shot_prompt(story: Column, question: str, templates: Templates = DEFAULT) -> Column:
    return fill(templates.zero_shot, story=strip(story), question=question)


def shot_block(story: Column, reasoning: Column, label: Column, question: str, templates: Templates = DEFAULT) -> Column:
    """A worked example: story, summary as reasoning, Yes or No."""
    answer = F.when(label == 1, F.lit("Yes")).otherwise(F.lit("No"))
    return fill(templates.example, story=strip(story), reasoning=strip(reasoning), question=question, answer=answer)


def join_shots(shots: DataFrame, question: str, seed: int = 0, templates: Templates = DEFAULT) -> DataFrame:
    """One row with all example blocks in hashed order.

    ``shots`` is the few examples chosen for a prompt, ``2n`` rows for n per class.
    """
    block = shot_block(F.col("story"), F.col("summary"), F.col("label"), question, templates)
    keyed = F.struct(uniform(seed, "shot", F.col("story_id")).alias("u"), "story_id", block.alias("block"))
    return shots.agg(F.array_join(F.sort_array(F.collect_list(keyed))["block"], templates.between).alias("shots"))


def few_shot_prompt(story: Column, question: str, shots: DataFrame, templates: Templates = DEFAULT) -> Column:
    """The same example text in front of every story; ``shots`` is a one-row frame."""
    return fill(templates.few_shot, story=strip(story), question=question, shots=shots.scalar())


def parse_answer(content: Column, question: str) -> tuple[Column, Column]:
    """``(score, invalid)`` of a raw answer.

    Reads what follows the last occurrence of the question: a "yes" scores 1, else a "no"
    scores 0; anything else scores 0 and is flagged.
    """
    said = F.lower(strip(F.substring_index(content, question, -1)))
    yes, no = F.contains(said, F.lit("yes")), F.contains(said, F.lit("no"))
    return F.when(yes, 1.0).otherwise(0.0), ~yes & ~no


def with_cache_id(prompts: DataFrame, model: str, prompt: str = "prompt") -> DataFrame:
    return prompts.withColumn("cache_id", cache_id(F.lit(model), F.col(prompt)))


def cached(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts that have a cached score, with it."""
    return prompts.join(cache, "cache_id")


def missing(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct prompts without a cached score."""
    return prompts.select("cache_id", "prompt").join(cache.select("cache_id"), "cache_id", "left_anti").dropDuplicates(["cache_id"])


class _Asker:
    """Calls a scorer for one task and keeps to the limits of ``retry``."""

    def __init__(self, scorer: Scorer, retry: Retry, share: int | None):
        self.scorer, self.retry, self.left = scorer, retry, share

    def _again(self, failures: int) -> bool:
        if self.left is not None and self.left <= 0:
            return False
        self.left = None if self.left is None else self.left - 1
        time.sleep(self.retry.wait(failures))
        return True

    def ask(self, prompts: pd.Series) -> list[tuple[str | None, str | None, int]]:
        """``(content, error, attempts)`` of each prompt."""
        failures = 0
        while True:
            try:
                answers = [None if a is None or a != a else str(a) for a in self.scorer(prompts)]
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
                break
            except Exception as error:  # noqa: BLE001  the scorer is foreign code: no answer of others may be lost
                failures += 1
                if len(prompts) > 1:
                    if not self._again(1):
                        return [(None, repr(error), 1)] * len(prompts)
                    half = len(prompts) // 2
                    return self.ask(prompts.iloc[:half]) + self.ask(prompts.iloc[half:])
                if failures >= self.retry.attempts or not self._again(failures):
                    return [(None, repr(error), failures)]
        return [(a, None, failures + 1) if a is not None else (None, "no answer", failures + 1) for a in answers]


def score_prompts(
    prompts: DataFrame, scorer: Scorer, parallel: int | None = None, retry: Retry = Retry(), batch_rows: int | None = None
) -> DataFrame:
    """``(cache_id, content, error, attempts)`` of a pluggable scorer, batch by batch.

    ``scorer`` maps a series of prompts to a series of answers, null for none. A prompt that keeps
    failing comes back with its error and without content; the others are not touched by it.
    ``parallel`` limits how many tasks call the scorer at once, ``batch_rows`` the prompts of a call
    (``CALL_ROWS`` if not given, as pandas holds the texts of a call several times over).
    """
    spread = prompts.select("cache_id", "prompt")
    spread = spread.repartition(parallel) if parallel else spread
    tasks = parallel or spread.sparkSession.sparkContext.defaultParallelism
    share = None if retry.total is None else max(retry.total // tasks, 0)

    rows = batch_rows or CALL_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = _Asker(scorer, retry, share)
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                content, error, attempts = zip(*asker.ask(part["prompt"].to_pandas()))
                answers = [pa.array(content, pa.string()), pa.array(error, pa.string()), pa.array(attempts, pa.int32())]
                yield pa.RecordBatch.from_arrays([part["cache_id"], *answers], names=["cache_id", "content", "error", "attempts"])

    return spread.mapInArrow(run, SCORED_SCHEMA)


def rule_scorer(question: str, sign: str = "!") -> Scorer:
    """Answers Yes when the prompt holds ``sign``: a scorer for checks and dry runs."""

    def answer(prompts: pd.Series) -> pd.Series:
        held = prompts.str.contains(sign, regex=False)
        return question + held.map({True: " Yes.", False: " No."}).astype(str)

    return answer


def with_scores(answers: DataFrame, question: str) -> DataFrame:
    """``(cache_id, score, content, error, attempts)``: answers read; a failed prompt has no score."""
    score, _ = parse_answer(F.col("content"), question)
    return answers.select("cache_id", F.when(F.col("content").isNotNull(), score).alias("score"), "content", "error", "attempts")


def fresh_scores(prompts: DataFrame, cache: DataFrame, scorer: Scorer, question: str, retry: Retry = Retry()) -> DataFrame:
    """Scores of the distinct prompts that the cache does not hold.

    Store it before anything else reads it: each read calls the scorer.
    """
    return with_scores(score_prompts(missing(prompts, cache), scorer, retry=retry), question)


def chat_rows(df: DataFrame, question: str, templates: Templates = DEFAULT) -> DataFrame:
    """Fine-tuning examples: system, user and assistant messages."""
    answer = F.when(F.col("label") == 1, F.lit("Yes")).otherwise(F.lit("No"))
    user = fill(templates.zero_shot, story=F.col("story"), question=question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.select(
        "story_id",
        F.array(message("system", F.lit(SYSTEM)), message("user", user), message("assistant", answer)).alias("messages"),
    )
