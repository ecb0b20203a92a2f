"""Shards, predicates, edits and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablework.functions import uniform
from fablework.operators import edits, predicates, render
from fablework.plans import recipes
from fablework.sources import readers
from fablework.sources.sample_tables import documents_table, stories, table

from . import sql

S = sql.with_views(sql.STORIES)


def _lists(df, *extra):
    return df.select(
        "story_id", F.array_join("words", "|").alias("words"), F.array_join("features", "|").alias("features"), *extra
    )


_SQL_LISTS = "story_id, array_to_string(words,'|') words, array_to_string(features,'|') features"


def stories_view(spark, folder):
    return _lists(stories(spark, folder), "shard_key", "story", "summary", "sentence")


def shard_index(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "shard_key")
    return readers.shard_index(docs)


def first_shards(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "shard_key")
    return readers.first_shards(docs, 10).select("doc_id", "shard_key", "shard_idx")


def early_stop_scan(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "shard_key")
    return readers.early_stop_scan(docs, 200).select("doc_id", "shard_key")


def random_u01(spark, folder):
    return table(spark, folder, "documents").select("doc_id", uniform(3, "draw", F.col("doc_id")).alias("u"))


def filter_features(spark, folder):
    return _lists(predicates.keep(stories(spark, folder), "features!=Twist,features=Foreshadowing"))


def filter_words(spark, folder):
    return _lists(predicates.keep(stories(spark, folder), "words!=the,words=a"))


def filter_length(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("text", "story")
    return predicates.keep(docs, "length=100,length!=5000").select("doc_id", F.char_length("story").cast("bigint").alias("chars"))


def label_split(spark, folder):
    return predicates.label_by_feature(stories(spark, folder), "Twist").select("story_id", "label")


def ignore_case_filter(spark, folder):
    return predicates.keep(stories(spark, folder), "features=twist", ignore_case=True).select("story_id")


def render_counts(spark, folder):
    return render.render_counts(stories(spark, folder))


def filter_proportion(spark, folder):
    return predicates.filter_proportion(stories(spark, folder), "features!=Twist").withColumn(
        "proportion", F.round("proportion", 6)
    )


def recipe_counts(spark, folder):
    return recipes.recipe_counts(stories(spark, folder))


def corpus_counts(spark, folder):
    return table(spark, folder, "documents").agg(
        F.count(F.lit(1)).alias("stories"), F.countDistinct("source").alias("shards")
    )


def mix_match(spark, folder):
    swap = edits.swap_values("features:Foreshadowing=Twist,features:Twist=Conflict")
    return _lists(stories(spark, folder).transform(swap))


def adversarial(spark, folder):
    inject = edits.inject_values("features=Twist:0.5,words=moon:0.25", seed=11)
    return _lists(stories(spark, folder).transform(inject))


def refusal(spark, folder):
    refuse = edits.refuse_stories("features=Twist:0.5", seed=12)
    return _lists(stories(spark, folder).transform(refuse), "sentence", "story")


def edit_pipeline(spark, folder):
    options = recipes.Recipe(
        "features!=BadEnding", "features:Foreshadowing=Twist", "features=Conflict:0.5", "features=Twist:0.3"
    )
    return _lists(recipes.edited(stories(spark, folder), options, seed=5), "sentence", "story")


def pick_sentence(spark, folder):
    docs = documents_table(spark, folder)
    return docs.select("doc_id", render.picked_sentence(F.col("text"), F.col("doc_id"), 1).alias("sentence"))


def make_instruction(spark, folder):
    lines = {k.lower(): v for k, v in render.instruction_lines(2).items()}
    return render.renderable(stories(spark, folder)).select("story_id", *[v.alias(k) for k, v in lines.items()])


def make_text(spark, folder):
    return render.render(stories(spark, folder), seed=4).select("story_id", "text")


def make_text_subset(spark, folder):
    return render.render(stories(spark, folder), "Features,Summary", seed=4).select("story_id", "text")


def _recipe(name):
    return lambda spark, folder: recipes.build_text(stories(spark, folder), name).select("story_id", "text")


QUERIES = {
    "stories_view": stories_view,
    "shard_index": shard_index,
    "first_shards": first_shards,
    "early_stop_scan": early_stop_scan,
    "random_u01": random_u01,
    "filter_features": filter_features,
    "filter_words": filter_words,
    "filter_length": filter_length,
    "filter_ignore_case": ignore_case_filter,
    "label_split": label_split,
    "render_counts": render_counts,
    "filter_proportion": filter_proportion,
    "recipe_counts": recipe_counts,
    "corpus_counts": corpus_counts,
    "mix_match": mix_match,
    "adversarial": adversarial,
    "refusal": refusal,
    "edit_pipeline": edit_pipeline,
    "pick_sentence": pick_sentence,
    "make_instruction": make_instruction,
    "make_text": make_text,
    "make_text_subset": make_text_subset,
    **{"recipe_" + name.replace("-", "_"): _recipe(name) for name in recipes.named_recipes()},
}

# ------------------------------------------------------------------ oracle SQL


def _text_sql(source: str, keys, seed: int) -> str:
    values = {
        "Words": "array_to_string(words, ', ')",
        "Features": f"array_to_string({sql.capitalised('features')}, ', ')",
        "Summary": sql.one_line("summary"),
        "Sentence": f"coalesce(sentence, {sql.picked('story', 'story_id', seed)})",
    }
    lines = ", ".join(
        f"{{'u': {sql.u01(seed, 'line-' + k, 'story_id')}, 'line': '{k}: ' || {values[k]}}}" for k in keys
    )
    story = f"'Story: ' || {sql.strip('story')}"
    joined = f"array_to_string(list_append(list_transform(list_sort([{lines}]), lambda s: s.line), {story}), chr(10))"
    return f"SELECT story_id, {sql.strip(joined)} AS text FROM {source} WHERE len({sql.candidates('story')}) > 0"


_ALL_KEYS = ("Words", "Features", "Summary", "Sentence")


def _swap_sql(column: str, old: str, new: str) -> str:
    return f"list_transform({column}, lambda x: CASE WHEN x='{old}' THEN '{new}' ELSE x END)"


def _inject_sql(column: str, value: str, chance: float, seed: int, n: int) -> str:
    return f"CASE WHEN {sql.u01(seed, f'inject{n}', 'story_id')} < {chance} THEN list_append({column}, '{value}') ELSE {column} END"


def _refuse_sql(source: str, value: str, chance: float, seed: int) -> str:
    hit = f"({sql.u01(seed, 'refuse0', 'story_id')} < {chance})"
    return f"""SELECT story_id, shard_key, summary, words,
 CASE WHEN {hit} THEN list_append(features, '{value}') ELSE features END features,
 CASE WHEN {hit} THEN {sql.picked('story', 'story_id', seed, 'refusal0')} ELSE sentence END sentence,
 CASE WHEN {hit} THEN 'We are not allowed to write a story with {value} in it, sorry.' ELSE story END story
 FROM {source} WHERE NOT {hit} OR len({sql.candidates('story')}) > 0"""


def _where(filtering: str) -> str:
    tests = []
    for part in filtering.split(","):
        negated = "!=" in part
        value = part.split("=")[1]
        tests.append(f"{'NOT ' if negated else ''}list_contains(features,'{value}')")
    return " AND ".join(tests)


def _recipe_sql(recipe) -> str:
    steps = [f"kept AS (SELECT * FROM stories WHERE {_where(recipe.filtering)})"]
    last = "kept"
    if recipe.mix_match:
        swapped = _swap_sql("features", "Foreshadowing", "Twist")
        steps.append(f"mixed AS (SELECT * REPLACE ({swapped} AS features) FROM {last})")
        last = "mixed"
    if recipe.adversarial_training:
        added = _inject_sql("features", "Twist", 1.0, 0, 0)
        steps.append(f"added AS (SELECT * REPLACE ({added} AS features) FROM {last})")
        last = "added"
    if recipe.refusal:
        steps.append(f"refused AS ({_refuse_sql(last, 'Twist', 1.0, 0)})")
        last = "refused"
    return sql.with_views(sql.STORIES, *steps) + _text_sql(last, _ALL_KEYS, 0)


_CAND = sql.candidates("story")
_EDIT_STEPS = [
    "kept AS (SELECT * FROM stories WHERE NOT list_contains(features,'BadEnding'))",
    f"mixed AS (SELECT * REPLACE ({_swap_sql('features', 'Foreshadowing', 'Twist')} AS features) FROM kept)",
    f"added AS (SELECT * REPLACE ({_inject_sql('features', 'Conflict', 0.5, 5, 0)} AS features) FROM mixed)",
    f"refused AS ({_refuse_sql('added', 'Twist', 0.3, 5)})",
]

SQL = {
    "stories_view": S + f"SELECT {_SQL_LISTS}, shard_key, story, summary, sentence FROM stories",
    "shard_index": """SELECT source shard_key, CAST(count(*) AS BIGINT) n_rows,
 CAST(row_number() OVER (ORDER BY source)-1 AS BIGINT) shard_idx FROM documents GROUP BY source""",
    "first_shards": sql.with_views(sql.SHARDS)
    + "SELECT doc_id, shard_key, shard_idx FROM documents JOIN shards ON source=shard_key WHERE shard_idx < 10",
    "early_stop_scan": """WITH n AS (SELECT source, count(*) c FROM documents GROUP BY source),
 b AS (SELECT source, coalesce(sum(c) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) before FROM n)
 SELECT doc_id, d.source shard_key FROM documents d JOIN b ON d.source=b.source WHERE before <= 400""",
    "random_u01": f"SELECT doc_id, {sql.u01(3, 'draw', 'doc_id')} u FROM documents",
    "filter_features": S
    + f"SELECT {_SQL_LISTS} FROM stories WHERE NOT list_contains(features,'Twist') AND list_contains(features,'Foreshadowing')",
    "filter_words": S + f"SELECT {_SQL_LISTS} FROM stories WHERE NOT list_contains(words,'the') AND list_contains(words,'a')",
    "filter_length": "SELECT doc_id, CAST(length(text) AS BIGINT) chars FROM documents WHERE length(text) > 100 AND length(text) <= 5000",
    "filter_ignore_case": S + "SELECT story_id FROM stories WHERE list_contains(features,'Twist')",
    "label_split": S
    + "SELECT story_id, CAST(CASE WHEN list_contains(features,'Twist') THEN 1 ELSE 0 END AS DOUBLE) AS label FROM stories",
    "render_counts": S
    + f"""SELECT shard_key, CAST(count(*) FILTER (len({_CAND})>0) AS BIGINT) rendered,
 CAST(count(*) FILTER (len({_CAND})=0) AS BIGINT) skipped FROM stories GROUP BY shard_key""",
    "filter_proportion": S
    + """SELECT CAST(count(*) AS BIGINT) shards, CAST(sum(k) AS BIGINT) kept, CAST(sum(n) AS BIGINT) total,
 round(avg(r),6) proportion FROM (SELECT shard_key, count(*) FILTER (NOT list_contains(features,'Twist')) k, count(*) n,
 avg(CASE WHEN list_contains(features,'Twist') THEN 0.0 ELSE 1.0 END) r FROM stories GROUP BY shard_key) q""",
    "recipe_counts": S
    + " UNION ALL ".join(
        f"SELECT '{name}' recipe, CAST(count(*) AS BIGINT) kept FROM stories WHERE {_where(r.filtering)}"
        for name, r in recipes.named_recipes().items()
    ),
    "corpus_counts": "SELECT CAST(count(*) AS BIGINT) stories, CAST(count(DISTINCT source) AS BIGINT) shards FROM documents",
    "mix_match": S
    + f"""SELECT story_id, array_to_string(words,'|') words, array_to_string(
 {_swap_sql(_swap_sql('features', 'Foreshadowing', 'Twist'), 'Twist', 'Conflict')},'|') features FROM stories""",
    "adversarial": S
    + f"""SELECT story_id, array_to_string({_inject_sql('words', 'moon', 0.25, 11, 1)},'|') words,
 array_to_string({_inject_sql('features', 'Twist', 0.5, 11, 0)},'|') features FROM stories""",
    "refusal": S + f"SELECT {_SQL_LISTS}, sentence, story FROM ({_refuse_sql('stories', 'Twist', 0.5, 12)}) q",
    "edit_pipeline": sql.with_views(sql.STORIES, *_EDIT_STEPS) + f"SELECT {_SQL_LISTS}, sentence, story FROM refused",
    "pick_sentence": f"SELECT doc_id, {sql.picked('text', 'doc_id', 1)} sentence FROM documents",
    "make_instruction": S
    + f"""SELECT story_id, array_to_string(words, ', ') words, array_to_string({sql.capitalised('features')}, ', ') features,
 {sql.one_line('summary')} summary, coalesce(sentence, {sql.picked('story', 'story_id', 2)}) sentence
 FROM stories WHERE len({_CAND})>0""",
    "make_text": S + _text_sql("stories", _ALL_KEYS, 4),
    "make_text_subset": S + _text_sql("stories", ("Features", "Summary"), 4),
    **{
        "recipe_" + name.replace("-", "_"): _recipe_sql(recipe)
        for name, recipe in recipes.named_recipes().items()
    },
}
