"""Labelled sets, prompts, answers, the score cache and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablework.functions import uniform
from fablework.operators import metrics, parse, scoring, splits
from fablework.plans import scoring_job
from fablework.session import fresh_path
from fablework.sources import readers, writers
from fablework.sources.sample_tables import class_logits, generations, labelled, probe_logits, responses, table

from . import sql
from .selection import _MARKERS

ASK = scoring.question_about("twist")
MODEL = "rule-model"


def _docs(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("story_id"), F.col("text").alias("story"))


def _prompts(spark, folder):
    rows = _docs(spark, folder).select("story_id", scoring.zero_shot_prompt(F.col("story"), ASK).alias("prompt"))
    return scoring.with_cache_id(rows, MODEL)


def _cache(spark, folder):
    """Answers kept from an earlier run for about half of the prompts."""
    known = _prompts(spark, folder).filter(uniform(8, "cached", F.col("story_id")) < 0.5)
    answers = known.join(responses(spark, folder), "story_id")
    score, _ = scoring.parse_answer(F.col("content"), "Q?")
    return answers.groupBy("cache_id").agg(F.min(score).alias("score"), F.min("content").alias("content"))


def _shots(spark, folder):
    return splits.class_slice(labelled(spark, folder), 2)


def prompts(spark, folder):
    return _prompts(spark, folder)


def shot_block(spark, folder):
    block = scoring.shot_block(F.col("story"), F.col("summary"), F.col("label"), ASK)
    return labelled(spark, folder).select("story_id", block.alias("block"))


def few_shots(spark, folder):
    return scoring.join_shots(_shots(spark, folder), ASK, seed=2)


def few_shot_prompts(spark, folder):
    shots = scoring.join_shots(_shots(spark, folder), ASK, seed=2)
    rest = splits.minus(_docs(spark, folder), F.broadcast(_shots(spark, folder).select("story_id")), "story_id")  # four rows
    return rest.select("story_id", scoring.few_shot_prompt(F.col("story"), ASK, shots).alias("prompt"))


def eval_set(spark, folder):
    return splits.minus(_docs(spark, folder), _shots(spark, folder), "story_id").select("story_id")


def shot_blocks(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("value"))
    return readers.shot_blocks(texts, 2).select("doc_id", "shots")


def cache_hits(spark, folder):
    return scoring.cached(_prompts(spark, folder), _cache(spark, folder)).select("story_id", "cache_id", "score")


def cache_misses(spark, folder):
    return scoring.missing(_prompts(spark, folder), _cache(spark, folder)).select("cache_id", "prompt")


def _cache_table(spark, folder):
    """The answers kept from an earlier run as a cache table; returns its path."""
    path = fresh_path(spark, "scores")
    writers.append_scores(_cache(spark, folder), path)
    return path


def scored(spark, folder):
    prompts, path = _prompts(spark, folder), _cache_table(spark, folder)
    scoring_job.fill_cache(prompts, path, scoring.rule_scorer(ASK), ASK)
    return scoring_job.scored_rows(prompts, path).select("story_id", "score", "content")


class _Unsteady:
    """Fails for batches at first, and for ever for some prompts."""

    def __init__(self, calls: int = 3):
        self.calls, self.rule = calls, scoring.rule_scorer(ASK)

    def __call__(self, prompts):
        self.calls -= 1
        if self.calls >= 0 and len(prompts) > 1:
            raise ConnectionError("busy")
        if prompts.str.contains("Und", regex=False).any():
            raise ValueError("refused")
        return self.rule(prompts)


def failing_scorer(spark, folder):
    """Every prompt asked of a scorer that often fails: answers where there are any, else the error."""
    prompts, path = _prompts(spark, folder), fresh_path(spark, "scores")
    retry = scoring.Retry(attempts=2, first_wait=0.0)
    scoring_job.fill_cache(prompts, path, _Unsteady(), ASK, slice_rows=400, retry=retry, batch_rows=100)
    answers = writers.read_scores(spark, path).select("cache_id", "score", F.lit(None).cast("string").alias("error"))
    errors = writers.read_failures(spark, path).select("cache_id", F.lit(None).cast("double").alias("score"), "error")
    return prompts.select("story_id", "cache_id").join(answers.unionByName(errors), "cache_id").select("story_id", "score", "error")


def _evaluated(spark, folder, shots):
    found = labelled(spark, folder)
    return scoring_job.classifier_report(
        found, _cache_table(spark, folder), scoring.rule_scorer(ASK), ASK, MODEL, shots_per_class=shots, seed=2
    )


def classifier_report(spark, folder):
    rates = _evaluated(spark, folder, 0).rates
    return rates.select("n", *[F.round(c, 6).alias(c) for c in rates.columns if c != "n"])


def classifier_mistakes(spark, folder):
    return _evaluated(spark, folder, 0).mistakes.select("story_id", "label", "score")


def few_shot_report(spark, folder):
    return _rounded(_evaluated(spark, folder, 2).scores)


def parse_answer(spark, folder):
    score, invalid = scoring.parse_answer(F.col("content"), "Q?")
    return responses(spark, folder).select("story_id", score.alias("score"), invalid.alias("invalid"))


def _scored_labels(spark, folder):
    score, invalid = scoring.parse_answer(F.col("content"), "Q?")
    answers = responses(spark, folder).select("story_id", "content", score.alias("score"))
    return labelled(spark, folder).select("story_id", "label").join(answers, "story_id")


def confusion(spark, folder):
    rates = metrics.confusion(_scored_labels(spark, folder))
    return rates.select("n", *[F.round(c, 6).alias(c) for c in rates.columns if c != "n"])


def mistakes(spark, folder):
    return metrics.mistakes(_scored_labels(spark, folder))


def _rounded(df, *keep):
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


def describe_scores(spark, folder):
    return _rounded(metrics.describe(_scored_labels(spark, folder), "score", ["label"]))


def describe_values(spark, folder):
    return _rounded(metrics.describe(table(spark, folder, "events"), "value"))


def version_summary(spark, folder):
    report = scoring_job.generation_report(
        generations(spark, folder), _cache_table(spark, folder), scoring.rule_scorer(ASK, ","), ASK, MODEL
    )
    return _rounded(report)


def version_metric(spark, folder):
    scores = generations(spark, folder).withColumn("score", F.length(parse.clean_generation(F.col("generation"))).cast("double"))
    return _rounded(metrics.metric_rows(metrics.version_summary(scores)))


def version_head(spark, folder):
    return scoring_job.first_of_version(generations(spark, folder), 3).select("version", "row_idx")


def chat_rows(spark, folder):
    rows = scoring.chat_rows(labelled(spark, folder), ASK)
    return rows.select("story_id", F.to_json(F.struct("messages")).alias("line"))


def mean_loss_by_key(spark, folder):
    logits = probe_logits(spark, folder).withColumn("target_name", F.concat(F.lit("t"), F.col("target").cast("string")))
    return _rounded(metrics.mean_by_key(logits, ["layer", "target_name"], "logit"))


def probe_accuracy(spark, folder):
    return _rounded(metrics.probe_accuracy(probe_logits(spark, folder)))


def bce_by_layer(spark, folder):
    return _rounded(metrics.bce_by_layer(probe_logits(spark, folder)))


def cross_entropy(spark, folder):
    # class 0 plays the ignored one
    rows = class_logits(spark, folder).withColumn("target", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    loss = metrics.cross_entropy(F.col("logits"), F.col("target"))
    return _rounded(rows.select("example_id", loss.alias("loss")))


def mean_cross_entropy(spark, folder):
    rows = class_logits(spark, folder).withColumn("target", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return _rounded(metrics.mean_cross_entropy(rows))


def mean_pool_last10(spark, folder):
    pooled = metrics.mean_pool(table(spark, folder, "embeddings"), "label", "vec_id", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "entry")).select(
        "label", "dim", F.round("entry", 6).alias("entry")
    )


QUERIES = {
    "prompts": prompts,
    "shot_block": shot_block,
    "few_shots": few_shots,
    "few_shot_prompts": few_shot_prompts,
    "eval_set": eval_set,
    "shot_blocks": shot_blocks,
    "cache_hits": cache_hits,
    "cache_misses": cache_misses,
    "scored": scored,
    "failing_scorer": failing_scorer,
    "classifier_report": classifier_report,
    "classifier_mistakes": classifier_mistakes,
    "few_shot_report": few_shot_report,
    "parse_answer": parse_answer,
    "confusion": confusion,
    "mistakes": mistakes,
    "describe_scores": describe_scores,
    "describe_values": describe_values,
    "version_summary": version_summary,
    "version_metric": version_metric,
    "version_head": version_head,
    "chat_rows": chat_rows,
    "mean_loss_by_key": mean_loss_by_key,
    "probe_accuracy": probe_accuracy,
    "bce_by_layer": bce_by_layer,
    "cross_entropy": cross_entropy,
    "mean_cross_entropy": mean_cross_entropy,
    "mean_pool_last10": mean_pool_last10,
}

# ------------------------------------------------------------------ oracle SQL


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ASKED = "'Does the story have a twist?'"


def _zero(story: str) -> str:
    """The prompt without examples, written out here again."""
    return f"""'Below is a story for children. Answer this question about it: '||{ASKED}||' Reply with Yes or No only.'
 ||chr(10)||chr(10)||{story}||chr(10)||chr(10)||{ASKED}"""


_ZERO = _zero(sql.strip("text"))
_PROMPTS = f"prompts AS (SELECT doc_id story_id, {_ZERO} prompt, md5('{MODEL}'||{_ZERO}) cache_id FROM documents)"


def _said(content: str, question: str) -> str:
    return f"lower({sql.strip(f'string_split({content}, {_quoted(question)})[-1]')})"


def _score(content: str, question: str) -> str:
    return f"CAST(CASE WHEN contains({_said(content, question)},'yes') THEN 1 ELSE 0 END AS DOUBLE)"


_CACHE = f"""cache AS (SELECT cache_id, min({_score('content', 'Q?')}) score, min(content) content
 FROM prompts JOIN responses USING (story_id) WHERE {sql.u01(8, 'cached', 'story_id')} < 0.5 GROUP BY cache_id)"""
_LABELS = """labelled AS (SELECT *, CAST(CASE WHEN list_contains(features,'Twist') THEN 1 ELSE 0 END AS DOUBLE) AS label FROM stories)"""
_SHOT = f"""'Example story: '||{sql.strip("story")}||chr(10)||'Why: '||{sql.strip("summary")}||chr(10)||{ASKED}
 ||' '||CASE WHEN label=1 THEN 'Yes' ELSE 'No' END"""
_SHOTS = f"""chosen AS (SELECT *, {_SHOT} "block" FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY shard_key, story_id) <= 2),
shots AS (SELECT array_to_string(list("block" ORDER BY {sql.u01(2, 'shot', 'story_id')}, story_id), chr(10)||chr(10)) shots FROM chosen)"""
_few = lambda story: f"""(SELECT shots FROM shots)||chr(10)||chr(10)||'Story: '||{sql.strip(story)}||chr(10)
 ||'Explain in one sentence, then answer.'||chr(10)||{ASKED}"""  # noqa: E731
_FEW = _few("text")
_JOINED = f"""joined AS (SELECT l.story_id, label, content, {_score('content', 'Q?')} score FROM labelled l JOIN responses r ON l.story_id=r.story_id)"""


def _describe(value: str, source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    quartiles = ", ".join(
        f"round(quantile_cont({value}, {p}),6) {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    )
    return f"""SELECT {lead}CAST(count({value}) AS BIGINT) "count", round(avg({value}),6) mean, round(stddev_samp({value}),6) std,
 round(min({value}),6) "min", {quartiles}, round(max({value}),6) "max" FROM {source} {'GROUP BY ' + by if by else ''}"""


_GEN_TEXT = sql.strip(f"regexp_split_to_array(generation, {_MARKERS})[1]")
_GEN_PROMPT = _zero(_GEN_TEXT)
_VERSIONS = f"""gen AS (SELECT *, {_GEN_PROMPT} prompt, md5('{MODEL}'||{_GEN_PROMPT}) cache_id FROM generations),
gen_scored AS (SELECT g.*, coalesce(c.score, CAST(CASE WHEN contains(g.prompt, ',') THEN 1 ELSE 0 END AS DOUBLE)) score
 FROM gen g LEFT JOIN cache c ON g.cache_id=c.cache_id)"""

_CHAT = _zero("story")
_CE = """ce AS (SELECT example_id, CASE WHEN label=0 THEN -1 ELSE label END target,
 ln(sum(exp(logit))) - max(CASE WHEN class_id=label THEN logit END) loss FROM class_logits GROUP BY example_id, label)"""
_BCE = "avg(greatest(logit,0.0) - logit*target + ln(1+exp(-abs(logit))))"

_EVALUATED = f"""prompted AS (SELECT story_id, label, {_zero(sql.strip('story'))} prompt FROM labelled),
evaluated AS (SELECT p.story_id, label, coalesce(c.score, CAST(CASE WHEN contains(p.prompt,'!') THEN 1 ELSE 0 END AS DOUBLE)) score
 FROM prompted p LEFT JOIN cache c ON md5('{MODEL}'||p.prompt)=c.cache_id)"""
_FEW_EVALUATED = f"""evaluated AS (SELECT story_id, label, CAST(CASE WHEN contains({_few('story')},'!') THEN 1 ELSE 0 END AS DOUBLE) score
 FROM labelled WHERE story_id NOT IN (SELECT story_id FROM chosen))"""
_WITH_EVALUATED = sql.with_views(_PROMPTS, sql.RESPONSES, _CACHE, sql.STORIES, _LABELS, _EVALUATED)

L = sql.with_views(sql.STORIES, _LABELS)

SQL = {
    "prompts": sql.with_views(_PROMPTS) + "SELECT * FROM prompts",
    "shot_block": L + f'SELECT story_id, {_SHOT} "block" FROM labelled',
    "few_shots": sql.with_views(sql.STORIES, _LABELS, _SHOTS) + "SELECT shots FROM shots",
    "few_shot_prompts": sql.with_views(sql.STORIES, _LABELS, _SHOTS)
    + f"SELECT doc_id story_id, {_FEW} prompt FROM documents WHERE doc_id NOT IN (SELECT story_id FROM chosen)",
    "eval_set": sql.with_views(sql.STORIES, _LABELS, _SHOTS)
    + "SELECT doc_id story_id FROM documents WHERE doc_id NOT IN (SELECT story_id FROM chosen)",
    "shot_blocks": """SELECT doc_id, array_to_string(string_split(replace(text, chr(10), chr(10)||chr(10)), chr(10)||chr(10))[1:4],
 chr(10)||chr(10)) shots FROM documents""",
    "cache_hits": sql.with_views(_PROMPTS, sql.RESPONSES, _CACHE)
    + "SELECT story_id, p.cache_id, score FROM prompts p JOIN cache c ON p.cache_id=c.cache_id",
    "cache_misses": sql.with_views(_PROMPTS, sql.RESPONSES, _CACHE)
    + "SELECT DISTINCT cache_id, prompt FROM prompts WHERE cache_id NOT IN (SELECT cache_id FROM cache)",
    "scored": sql.with_views(_PROMPTS, sql.RESPONSES, _CACHE)
    + f"""SELECT story_id, coalesce(score, CAST(CASE WHEN contains(prompt,'!') THEN 1 ELSE 0 END AS DOUBLE)) score,
 coalesce(content, CASE WHEN contains(prompt,'!') THEN {_quoted(ASK + ' Yes.')} ELSE {_quoted(ASK + ' No.')} END) content
 FROM prompts p LEFT JOIN cache c ON p.cache_id=c.cache_id""",
    "failing_scorer": sql.with_views(_PROMPTS)
    + """SELECT story_id, CASE WHEN NOT contains(prompt,'Und') THEN CAST(CASE WHEN contains(prompt,'!') THEN 1 ELSE 0 END AS DOUBLE) END score,
 CASE WHEN contains(prompt,'Und') THEN 'ValueError(''refused'')' END error FROM prompts""",
    "classifier_report": _WITH_EVALUATED
    + """SELECT CAST(count(*) AS BIGINT) n, round(avg(CASE WHEN score=label THEN 1.0 ELSE 0.0 END),6) accuracy,
 round(count(*) FILTER (score=1 AND label=0)/(count(*) FILTER (label=0)+1),6) false_positive,
 round(count(*) FILTER (score=0 AND label=1)/(count(*) FILTER (label=1)+1),6) false_negative FROM evaluated""",
    "classifier_mistakes": _WITH_EVALUATED + "SELECT story_id, label, score FROM evaluated WHERE score<>label",
    "few_shot_report": sql.with_views(sql.STORIES, _LABELS, _SHOTS, _FEW_EVALUATED) + _describe("score", "evaluated", "label"),
    "parse_answer": sql.with_views(sql.RESPONSES)
    + f"""SELECT story_id, {_score('content', 'Q?')} score,
 NOT contains({_said('content', 'Q?')},'yes') AND NOT contains({_said('content', 'Q?')},'no') invalid FROM responses""",
    "confusion": sql.with_views(sql.STORIES, _LABELS, sql.RESPONSES, _JOINED)
    + """SELECT CAST(count(*) AS BIGINT) n, round(avg(CASE WHEN score=label THEN 1.0 ELSE 0.0 END),6) accuracy,
 round(count(*) FILTER (score=1 AND label=0)/(count(*) FILTER (label=0)+1),6) false_positive,
 round(count(*) FILTER (score=0 AND label=1)/(count(*) FILTER (label=1)+1),6) false_negative FROM joined""",
    "mistakes": sql.with_views(sql.STORIES, _LABELS, sql.RESPONSES, _JOINED) + "SELECT * FROM joined WHERE score<>label",
    "describe_scores": sql.with_views(sql.STORIES, _LABELS, sql.RESPONSES, _JOINED) + _describe("score", "joined", "label"),
    "describe_values": _describe("value", "events"),
    "version_summary": sql.with_views(_PROMPTS, sql.RESPONSES, _CACHE, sql.GENERATIONS, _VERSIONS)
    + _describe("score", "gen_scored", '"version"').replace("FROM gen_scored", ", arg_min(iter_num,row_idx) iter_num FROM gen_scored"),
    "version_metric": sql.with_views(sql.GENERATIONS)
    + f"""SELECT arg_min(iter_num,row_idx) iter_num_gen, round(avg(CAST(length({_GEN_TEXT}) AS DOUBLE)),6) metric
 FROM generations GROUP BY "version" """,
    "version_head": sql.with_views(sql.GENERATIONS) + 'SELECT "version", row_idx FROM generations WHERE row_idx < 3',
    "chat_rows": L
    + f"""SELECT story_id, CAST(to_json({{'messages': [
 {{'role': 'system', 'content': 'You help by answering questions about stories for children.'}}, {{'role': 'user', 'content': {_CHAT}}},
 {{'role': 'assistant', 'content': CASE WHEN label=1 THEN 'Yes' ELSE 'No' END}}]}}) AS VARCHAR) line FROM labelled""",
    "mean_loss_by_key": sql.with_views(sql.PROBES)
    + """SELECT layer, concat('t', CAST(target AS VARCHAR)) target_name, round(avg(logit),6) mean_loss,
 CAST(count(*) AS BIGINT) steps FROM probe_logits GROUP BY 1, 2""",
    "probe_accuracy": sql.with_views(sql.PROBES)
    + """SELECT layer, feature, round(avg(CASE WHEN (logit>0)=(target=1) THEN 1.0 ELSE 0.0 END),6) accuracy, CAST(count(*) AS BIGINT) n
 FROM probe_logits GROUP BY GROUPING SETS ((layer, feature), (layer), ())""",
    "bce_by_layer": sql.with_views(sql.PROBES, f"b AS (SELECT layer, {_BCE} loss FROM probe_logits GROUP BY layer)")
    + "SELECT layer, round(loss,6) loss FROM b UNION ALL SELECT NULL, round(sum(loss),6) FROM b",
    "cross_entropy": sql.with_views(sql.CLASS_LOGITS, _CE)
    + "SELECT example_id, CASE WHEN target<>-1 THEN round(loss,6) END loss FROM ce",
    "mean_cross_entropy": sql.with_views(sql.CLASS_LOGITS, _CE)
    + "SELECT round(avg(loss),6) loss, CAST(count(*) AS BIGINT) n FROM ce WHERE target<>-1",
    "mean_pool_last10": """WITH t AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 10)
 SELECT label, CAST(i-1 AS INTEGER) dim, round(avg(CAST(embedding[i] AS DOUBLE)),6) entry
 FROM t, (SELECT unnest(range(1,65)) i) s GROUP BY label, i""",
}
