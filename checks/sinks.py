"""Sinks read back, and the streaming jobs. Each query writes to a new shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablework.functions import uniform
from fablework.operators import scoring, tokens
from fablework.operators.history import KEY
from fablework.operators.render import render
from fablework.session import cut_lineage, fresh_path
from fablework.sources import readers, writers
from fablework.sources.sample_tables import generations, history, labelled, stories
from fablework.streaming import blocks as stream_token
from fablework.streaming import metrics as stream_metrics
from fablework.streaming import scores as stream_scores
from fablework.streaming import shards as stream_shards_mod

from . import annotations, scoring as scoring_checks, sql, tokens as token_checks
from .runs import SQL as RUN_SQL
from .scoring import ASK, _cache, _prompts


def text_export(spark, folder):
    path = fresh_path(spark, "text")
    writers.write_text(render(stories(spark, folder), seed=4), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def token_dataset(spark, folder):
    root = fresh_path(spark, "tokens")
    writers.write_tokens(token_checks._encoded(spark, folder), root, 8192, "all")
    back = writers.read_tokens(spark, root, 8192, "all")
    return back.select("shard_key", "story_id", F.array_join("tokens", " ").alias("tokens"))


def labelled_cache(spark, folder):
    path = fresh_path(spark, "labelled")
    writers.write_labelled(labelled(spark, folder).select("story_id", "features", "label"), path)
    back = writers.read_labelled(spark, path)
    return back.select("story_id", F.array_join("features", ",").alias("features"), "label")


def chat_lines(spark, folder):
    path = fresh_path(spark, "chat")
    writers.write_chat_lines(scoring.chat_rows(labelled(spark, folder), ASK), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def score_cache_append(spark, folder):
    path = fresh_path(spark, "scores")
    writers.append_scores(_cache(spark, folder), path)
    for _ in range(2):  # the second time adds nothing
        known = writers.read_scores(spark, path)
        writers.append_scores(scoring.fresh_scores(_prompts(spark, folder), known, scoring.rule_scorer(ASK), ASK), path)
    return writers.read_scores(spark, path, distinct=False)


def summary_csv(spark, folder):
    path = fresh_path(spark, "summary")
    writers.write_summary(scoring_checks.version_metric(spark, folder), path)
    return spark.read.schema("iter_num_gen bigint, metric double").option("header", True).csv(path)


def version_tables(spark, folder):
    path = fresh_path(spark, "versions")
    writers.write_version_tables(generations(spark, folder), ["generation", "role", "iter_num"], path)
    rows = readers.read_version_tables(spark, path)
    return rows.select(
        F.col("version").cast("bigint").alias("version"),
        F.col("row")["generation"].alias("generation"),
        F.col("row")["role"].alias("role"),
        F.col("row")["iter_num"].cast("bigint").alias("iter_num"),
        "row_idx",
    )


def vocab_file(spark, folder):
    path = fresh_path(spark, "vocab")
    ranked = tokens.rank_vocabulary(token_checks._counts(spark, folder), 8192)
    score = (F.lit(259) - F.col("id")).cast("double")
    writers.write_vocabulary(ranked.select("id", F.concat(F.lit("▁"), "w").alias("piece"), score.alias("score")), path)
    return readers.read_vocabulary(spark, path)


def stream_shards(spark, folder):
    source, target, state = (fresh_path(spark, n) for n in ("arriving", "texts", "state"))
    view = stories(spark, folder)
    view.write.parquet(source)
    arriving = stream_shards_mod.stream_tables(spark, source, view.schema, 2)
    stream_shards_mod.write_texts(arriving, "filter-adv-Twist", target, state).awaitTermination()
    return spark.read.parquet(target).select("story_id", "text")


def stream_token_blocks(spark, folder):
    """Blocks of 256 tokens from stories that arrive in five runs of files."""
    source, target, state = (fresh_path(spark, n) for n in ("arriving", "blocks", "state"))
    encoded = cut_lineage(token_checks._encoded(spark, folder))
    bounds = encoded.agg(F.percentile("story_id", F.array(*[F.lit(i / 5) for i in range(1, 5)]))).first()[0]
    for low, high in zip([float("-inf"), *bounds], [*bounds, float("inf")]):
        part = encoded.filter((F.col("story_id") > low) & (F.col("story_id") <= high))
        part.coalesce(1).write.mode("append").parquet(source)
    arriving = stream_shards_mod.stream_tables(spark, source, encoded.schema, 1)
    stream_shards_mod.append_rows(stream_token.stream_blocks(arriving, 256), target, state).awaitTermination()
    found = spark.read.schema(stream_token.BLOCKS).parquet(target)
    return found.select("shard_key", "block", F.array_join("chunk", " ").alias("chunk"))


def stream_dedup_scores(spark, folder):
    source, cache, state = (fresh_path(spark, n) for n in ("prompts", "scores", "state"))
    prompts = _prompts(spark, folder)
    prompts = prompts.repartition(max(4, prompts.rdd.getNumPartitions()))  # a larger table comes in more files
    prompts.write.parquet(source)
    arriving = stream_shards_mod.stream_tables(spark, source, prompts.schema, 1)
    stream_scores.score_stream(arriving, cache, state, scoring.rule_scorer(ASK), ASK).awaitTermination()
    return writers.read_scores(spark, cache, distinct=False)


def _arriving_history(spark, folder):
    """History written in four slices of iterations, the earlier ones first."""
    source = fresh_path(spark, "metrics")
    rows = history(spark, folder).select(KEY, "iter", "loss_test")
    bounds = [None, 200, 400, 600, None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows
        if low is not None:
            part = part.filter(F.col("iter") >= low)
        if high is not None:
            part = part.filter(F.col("iter") < high)
        part.repartition(KEY).write.mode("append").parquet(source)
    return stream_shards_mod.stream_tables(spark, source, rows.schema, 1)


def _streamed(spark, folder):
    target, state = fresh_path(spark, "averages"), fresh_path(spark, "state")
    results = stream_metrics.running_metrics(_arriving_history(spark, folder), "loss_test")
    stream_shards_mod.append_rows(results, target, state).awaitTermination()
    return spark.read.schema(stream_metrics.OUTPUT).parquet(target)


def stream_ema(spark, folder):
    """The stream as it wrote it; a late row would be missing here."""
    rows = _streamed(spark, folder).filter(~F.col("late") & F.col("ema").isNotNull())
    return rows.select("run_id", "iter", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


def stream_running_best(spark, folder):
    rows = _streamed(spark, folder).filter(~F.col("late"))
    return rows.select("run_id", "iter", F.round("best_before", 6).alias("best_before"), "improved")


def stream_late_rows(spark, folder):
    """Late rows, of which files in the order of iterations have none."""
    return _streamed(spark, folder).agg(F.count_if("late").alias("late"), F.count(F.lit(1)).alias("n"))


def _shuffled(spark, folder):
    """The stream over files that bring rows up to 150 iterations late, with a last row that closes each run."""
    source, target, state = (fresh_path(spark, n) for n in ("arriving", "averages", "state"))
    rows = history(spark, folder).select(KEY, "iter", "loss_test")
    comes = F.col("iter") + F.floor(uniform(5, "late", F.col(KEY), F.col("iter")) * 150)
    for low, high in ((0, 200), (200, 350), (350, 600), (600, None)):
        part = rows.filter((comes >= low) if high is None else (comes >= low) & (comes < high))
        part.repartition(2, "iter").write.mode("append").parquet(source)
    ends = rows.select(KEY, F.lit(None).cast("bigint").alias("iter"), F.lit(None).cast("double").alias("loss_test")).distinct()
    ends.coalesce(1).write.mode("append").parquet(source)
    arriving = stream_shards_mod.stream_tables(spark, source, rows.schema, 2)
    stream_shards_mod.append_rows(stream_metrics.running_metrics(arriving, "loss_test", slack=300), target, state).awaitTermination()
    return spark.read.schema(stream_metrics.OUTPUT).parquet(target)


def stream_shuffled_ema(spark, folder):
    rows = _shuffled(spark, folder).filter(~F.col("late") & F.col("ema").isNotNull())
    return rows.select("run_id", "iter", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


def stream_shuffled_best(spark, folder):
    return _shuffled(spark, folder).select("run_id", "iter", F.round("best_before", 6).alias("best_before"), "improved")


def stream_metric_log(spark, folder):
    target, state = fresh_path(spark, "log"), fresh_path(spark, "state")
    rows = _arriving_history(spark, folder).select(
        KEY, "iter", (F.col("iter") * 131072).alias("tokens"), F.round("loss_test", 6).alias("loss_test")
    )
    stream_shards_mod.append_rows(rows, target, state).awaitTermination()
    return spark.read.parquet(target)


QUERIES = {
    f.__name__: f
    for f in (
        text_export, token_dataset, labelled_cache, chat_lines, score_cache_append, summary_csv, version_tables, vocab_file,
        stream_shards, stream_token_blocks, stream_dedup_scores, stream_ema, stream_running_best, stream_late_rows, stream_shuffled_ema, stream_shuffled_best,
        stream_metric_log,
    )
}

_TEXT = annotations.SQL["make_text"]
_CACHED = sql.with_views(scoring_checks._PROMPTS, sql.RESPONSES, scoring_checks._CACHE)
_YES, _NO = scoring_checks._quoted(ASK + " Yes."), scoring_checks._quoted(ASK + " No.")
_RULE = f"""CAST(CASE WHEN contains(prompt,'!') THEN 1 ELSE 0 END AS DOUBLE) score,
 CASE WHEN contains(prompt,'!') THEN {_YES} ELSE {_NO} END content"""

SQL = {
    "text_export": f"""SELECT "value", CAST(count(*) AS BIGINT) n FROM
 (SELECT unnest(string_split(text, chr(10))) "value" FROM ({_TEXT}) t) q GROUP BY 1""",
    "token_dataset": token_checks.SQL["encode_words"],
    "labelled_cache": sql.with_views(sql.STORIES, scoring_checks._LABELS)
    + "SELECT story_id, array_to_string(features,',') features, label FROM labelled",
    "chat_lines": f"SELECT line FROM ({scoring_checks.SQL['chat_rows']}) q",
    "score_cache_append": _CACHED
    + f"""SELECT cache_id, score, content FROM cache UNION ALL
 SELECT DISTINCT cache_id, {_RULE} FROM prompts WHERE cache_id NOT IN (SELECT cache_id FROM cache)""",
    "summary_csv": scoring_checks.SQL["version_metric"],
    "version_tables": sql.with_views(sql.GENERATIONS)
    + """SELECT "version", generation, role, iter_num, CAST(row_number() OVER (PARTITION BY "version" ORDER BY row_idx)-1 AS BIGINT) row_idx
 FROM generations""",
    "vocab_file": sql.with_views(sql.VOCAB)
    + """SELECT CAST(row_number() OVER (ORDER BY id)-1 AS INTEGER) id, '▁'||w piece, CAST(259-id AS DOUBLE) score FROM vocab WHERE id < 8192""",
    "stream_shards": annotations.SQL["recipe_filter_adv_Twist"],
    "stream_token_blocks": token_checks.SQL["fixed_blocks"],
    "stream_dedup_scores": sql.with_views(scoring_checks._PROMPTS) + f"SELECT DISTINCT cache_id, {_RULE} FROM prompts",
    "stream_ema": RUN_SQL["ema"],
    "stream_running_best": RUN_SQL["running_best"],
    "stream_shuffled_ema": RUN_SQL["ema"],
    "stream_shuffled_best": RUN_SQL["running_best"],
    "stream_late_rows": sql.with_views(sql.HISTORY)
    + "SELECT CAST(0 AS BIGINT) late, CAST(count(*) AS BIGINT) n FROM history WHERE loss_test IS NOT NULL",
    "stream_metric_log": sql.with_views(sql.HISTORY)
    + "SELECT run_id, iter, iter*131072 tokens, round(loss_test,6) loss_test FROM history",
}
