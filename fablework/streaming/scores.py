"""Scoring a prompt stream, every distinct prompt once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import Retry, Scorer, missing, score_prompts, with_scores
from ..sources.writers import append_scores, read_scores


def score_stream(prompts: DataFrame, cache_path: str, checkpoint: str, scorer: Scorer, question: str, retry: Retry = Retry()):
    """Score new prompts against the cache table at ``cache_path``.

    The cache is the state: each trigger drops prompts it holds, and reads only the folders
    of the ids it has prompts for. Appending is keyed, so a trigger that runs again after a
    failure adds what it had not added, and another stream on the same cache adds nothing twice.
    A prompt that keeps failing is kept with its error, and asked again when it comes again.
    """

    def once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        wanted = [r[0] for r in batch.select(F.substring("cache_id", 1, 2)).distinct().collect()]  # at most 256
        known = read_scores(spark, cache_path, False, wanted)
        answers = score_prompts(missing(batch, known), scorer, retry=retry)
        append_scores(with_scores(answers, question), cache_path)

    return (
        prompts.writeStream.foreachBatch(once)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
