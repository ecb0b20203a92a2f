"""Parsing, splits, shuffles and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablework.operators import blocks, parse, predicates, sampling, splits
from fablework.operators.render import render
from fablework.sources.sample_tables import class_logits, generations, labelled, stories, table

from . import sql
from .annotations import _ALL_KEYS, _text_sql

TEXTS = f"texts AS ({_text_sql('stories', _ALL_KEYS, 4)})"
T = sql.with_views(sql.STORIES, TEXTS)


def _docs(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("source").alias("shard_key"), F.col("doc_id").alias("story_id")
    )


def _texts(spark, folder):
    return render(stories(spark, folder), seed=4)


def _logits(spark, folder):
    flat = class_logits(spark, folder)
    return flat.select("example_id", F.posexplode("logits").alias("class_id", "logit")).withColumn(
        "class_id", F.col("class_id").cast("bigint")
    )


def extract_story(spark, folder):
    return _texts(spark, folder).select("story_id", parse.extract_story(F.col("text")).alias("story"))


def multi_hot(spark, folder):
    return parse.labelled_stories(_texts(spark, folder)).select(
        "story_id", F.array_join("target", "").alias("target"), F.array_join("unknown", ",").alias("unknown")
    )


def split_prefix(spark, folder):
    return parse.prefix_rows(_texts(spark, folder)).select("story_id", "prefix", "target")


def clean_generation(spark, folder):
    return generations(spark, folder).select(
        "version", "row_idx", parse.clean_generation(F.col("generation")).alias("story")
    )


def generation_table(spark, folder):
    texts = parse.prefix_rows(_texts(spark, folder))
    # a few stories per list: the lists of one step of generation
    grouped = texts.groupBy(F.shiftright("story_id", 3).alias("step")).agg(
        F.sort_array(F.collect_list(F.struct("story_id", "prefix", "target"))).alias("rows")
    )
    lists = grouped.select(
        "step",
        F.col("rows.prefix").alias("prefix"),
        F.col("rows.prefix").alias("clean_prefix"),
        F.col("rows.target").alias("generation"),
        F.col("rows.target").alias("target"),
    )
    return parse.generation_rows(lists, F.col("step") * 300)


def shard_split(spark, folder):
    return splits.shard_split(_docs(spark, folder))


def train_test_exact(spark, folder):
    return splits.exact_split(_docs(spark, folder), 0.8, "story_id", seed=9).select("story_id", "train")


def train_test_hash(spark, folder):
    return splits.hash_split(_docs(spark, folder), 0.8, "story_id", seed=9).select("story_id", "train")


def test_rows(spark, folder):
    flagged = splits.exact_split(_docs(spark, folder), 0.8, "story_id", seed=9)
    return splits.minus(_docs(spark, folder), flagged.filter("train"), "story_id").select("story_id")


def class_slice(spark, folder):
    chosen = splits.class_slice(labelled(spark, folder), 120, 30)
    return chosen.select("story_id", "label", "idx")


def labelled_set(spark, folder):
    return splits.labelled_set(labelled(spark, folder), 120, 30).select("story_id", "label", "train")


def first_shots(spark, folder):
    return splits.class_slice(labelled(spark, folder), 3).select("story_id", "label", "idx")


def work_chunks(spark, folder):
    return splits.work_chunks(_docs(spark, folder), "story_id", 10).select("story_id", "idx", "chunk")


def _blocks(spark, folder):
    lengths = table(spark, folder, "documents").select(
        F.col("source").alias("shard_key"), F.col("n_chars").alias("length")
    )
    totals = lengths.groupBy("shard_key").agg(F.sum("length").alias("total"))
    return blocks.block_list(totals, 256)


def epoch_shuffle(spark, folder):
    return splits.epoch_order(_blocks(spark, folder), 2, seed=3, worker=1, rank=2)


def batches(spark, folder):
    ordered = splits.epoch_order(_blocks(spark, folder), 1, seed=3)
    return splits.batches(ordered, 64).select("shard_key", "block", "batch_id")


def topk_ties(spark, folder):
    rounded = _logits(spark, folder).withColumn("logit", F.round("logit", 1))
    return sampling.top_k_ties(rounded, "example_id", "logit", 5)


def argmax_group(spark, folder):
    rounded = _logits(spark, folder).withColumn("logit", F.round("logit", 1))
    return sampling.arg_max(rounded, "example_id", "class_id", "logit")


def softmax_group(spark, folder):
    return sampling.softmax(_logits(spark, folder), "example_id", "logit", 0.7).select(
        "example_id", "class_id", F.round("prob", 6).alias("prob")
    )


def weighted_draw(spark, folder):
    return sampling.sample_tokens(_logits(spark, folder), "example_id", "class_id", "logit", 0.9, seed=6)


def sample_top_k(spark, folder):
    return sampling.sample_tokens(_logits(spark, folder), "example_id", "class_id", "logit", 0.9, 8, seed=6)


def head_rows(spark, folder):
    longest = table(spark, folder, "documents").select("doc_id", "n_chars")
    return sampling.head(longest, 25, F.desc("n_chars"), "doc_id")


def union_distinct(spark, folder):
    both = stories(spark, folder).select("shard_key", F.explode("features").alias("name")).unionByName(
        stories(spark, folder).select("shard_key", F.explode("words").alias("name"), F.lit(True).alias("word")),
        allowMissingColumns=True,
    )
    return both.distinct()


QUERIES = {
    "extract_story": extract_story,
    "multi_hot": multi_hot,
    "split_prefix": split_prefix,
    "clean_generation": clean_generation,
    "generation_table": generation_table,
    "shard_split": shard_split,
    "train_test_exact": train_test_exact,
    "train_test_hash": train_test_hash,
    "test_rows": test_rows,
    "class_slice": class_slice,
    "labelled_set": labelled_set,
    "first_shots": first_shots,
    "work_chunks": work_chunks,
    "epoch_shuffle": epoch_shuffle,
    "batches": batches,
    "topk_ties": topk_ties,
    "argmax_group": argmax_group,
    "softmax_group": softmax_group,
    "weighted_draw": weighted_draw,
    "sample_top_k": sample_top_k,
    "head_rows": head_rows,
    "union_distinct": union_distinct,
}

# ------------------------------------------------------------------ oracle SQL

_MARKERS = "'Words: |Features: |Summary: |Sentence: '"
_STORY = f"regexp_split_to_array(string_split(text, chr(10)||'Story: ')[2], {_MARKERS})[1]"
_LINE = "regexp_extract(text, 'Features: ([^\\n]*)\\n', 1)"
_NAMES = (
    f"CASE WHEN {_LINE}='' THEN [] ELSE list_transform(string_split({_LINE}, ','), lambda x: lower({sql.strip('x')})) END"
)
_U9 = sql.u01(9, "split", "doc_id")
_FLAGGED = f"""flagged AS (SELECT doc_id story_id,
 row_number() OVER (ORDER BY {_U9}, doc_id) <= round(0.8*(SELECT count(*) FROM documents)) train FROM documents)"""
_CLASSES = """classed AS (SELECT story_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY shard_key, story_id)-1 AS BIGINT) idx
 FROM (SELECT *, CAST(CASE WHEN list_contains(features,'Twist') THEN 1 ELSE 0 END AS DOUBLE) AS label FROM stories) q)"""
_BLOCKS = """blocks AS (SELECT shard_key, unnest(range(CAST(total//256-1 AS BIGINT))) block
 FROM (SELECT source shard_key, CAST(sum(n_chars) AS BIGINT) total FROM documents GROUP BY source) q)"""


def _order_sql(seed: int, epochs: int) -> str:
    def u(purpose, *keys):
        joined = "||'|'||".join(f"CAST({k} AS VARCHAR)" for k in keys)
        return sql.u01(seed, purpose, f"({joined})")

    return f"""ordered AS (SELECT epoch, shard_key, block, CAST(row_number() OVER (PARTITION BY epoch
 ORDER BY {u('shard', 'epoch', 'shard_key')}, shard_key, {u('block', 'epoch', 'shard_key', 'block')}, block)-1 AS BIGINT) place
 FROM blocks, (SELECT CAST(unnest(range({epochs})) AS INTEGER) epoch) e)"""


_ROUNDED = "rounded AS (SELECT example_id, class_id, round(logit,1) logit FROM class_logits)"


def _draw_sql(source: str, temperature: float, seed: int) -> str:
    return f"""p AS (SELECT example_id, class_id, exp(logit/{temperature} - max(logit/{temperature}) OVER (PARTITION BY example_id)) e FROM {source}),
 s AS (SELECT example_id, class_id, sum(e) OVER (PARTITION BY example_id ORDER BY class_id) / sum(e) OVER (PARTITION BY example_id) cum FROM p)
 SELECT example_id, min(class_id) class_id FROM s WHERE cum > {sql.u01(seed, 'draw', 'example_id')} GROUP BY example_id"""


_GEN = f"""WITH
{sql.STORIES},
{TEXTS},
parsed AS (SELECT story_id, string_split(text, chr(10)||'Story: ')[1]||chr(10)||'Story: ' prefix, {_STORY} target FROM texts)"""

SQL = {
    "extract_story": T + f"SELECT story_id, {_STORY} story FROM texts",
    "multi_hot": T
    + f"""SELECT story_id, array_to_string(list_transform({list(parse.FEATURE_NAMES)}, lambda f: CAST(list_contains(names, f) AS INTEGER)),'') target,
 array_to_string(list_distinct(list_filter(names, lambda n: NOT list_contains({list(parse.FEATURE_NAMES)}, n))),',') "unknown"
 FROM (SELECT story_id, {_NAMES} names FROM texts WHERE regexp_matches(text, 'Features: [^\\n]*\\n')) q""",
    "split_prefix": _GEN + "SELECT story_id, prefix, target FROM parsed WHERE target IS NOT NULL",
    "clean_generation": sql.with_views(sql.GENERATIONS)
    + f"""SELECT "version", row_idx, {sql.strip(f'regexp_split_to_array(generation, {_MARKERS})[1]')} story FROM generations""",
    "generation_table": _GEN
    + """SELECT CAST(row_number() OVER (PARTITION BY story_id>>3 ORDER BY story_id)-1 AS BIGINT) row_idx, prefix, prefix clean_prefix,
 target generation, target, (story_id>>3)*300 iter_num FROM parsed""",
    "shard_split": sql.with_views(sql.SHARDS)
    + """SELECT doc_id story_id, shard_key, shard_idx, CASE WHEN shard_idx=0 THEN 'test' ELSE 'train' END AS split,
 CASE WHEN shard_idx=0 THEN NULL WHEN shard_idx-1 < floor(((SELECT count(*) FROM shards)-1)*0.8) THEN 'pretrain' ELSE 'finetune' END AS phase
 FROM documents JOIN shards ON source=shard_key""",
    "train_test_exact": sql.with_views(_FLAGGED) + "SELECT story_id, train FROM flagged",
    "train_test_hash": f"SELECT doc_id story_id, {_U9} < 0.8 train FROM documents",
    "test_rows": sql.with_views(_FLAGGED) + "SELECT story_id FROM flagged WHERE NOT train",
    "class_slice": sql.with_views(sql.STORIES, _CLASSES)
    + "SELECT story_id, label, idx FROM classed WHERE idx >= 30 AND idx < 150",
    "labelled_set": sql.with_views(sql.STORIES, _CLASSES)
    + f"""SELECT story_id, label, row_number() OVER (ORDER BY {sql.u01(0, 'split', 'story_id')}, story_id) <=
 round(0.8*count(*) OVER ()) train FROM classed WHERE idx >= 30 AND idx < 150""",
    "first_shots": sql.with_views(sql.STORIES, _CLASSES) + "SELECT story_id, label, idx FROM classed WHERE idx < 3",
    "work_chunks": """SELECT doc_id story_id, idx, CAST(idx // CAST(ceil(n/10.0) AS BIGINT) AS BIGINT) "chunk" FROM
 (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id)-1 AS BIGINT) idx, count(*) OVER () n FROM documents) q""",
    "epoch_shuffle": sql.with_views(_BLOCKS, _order_sql(3 + 1 + 1337 * 2, 2)) + "SELECT epoch, shard_key, block, place FROM ordered",
    "batches": sql.with_views(_BLOCKS, _order_sql(3, 1))
    + "SELECT shard_key, block, CAST(place // 64 AS BIGINT) batch_id FROM ordered",
    "topk_ties": sql.with_views(sql.CLASS_LOGITS, _ROUNDED)
    + "SELECT example_id, class_id, logit FROM rounded QUALIFY rank() OVER (PARTITION BY example_id ORDER BY logit DESC) <= 5",
    "argmax_group": sql.with_views(sql.CLASS_LOGITS, _ROUNDED)
    + "SELECT example_id, class_id FROM rounded QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY logit DESC, class_id) = 1",
    "softmax_group": sql.with_views(
        sql.CLASS_LOGITS,
        "e AS (SELECT example_id, class_id, exp(logit/0.7 - max(logit/0.7) OVER (PARTITION BY example_id)) x FROM class_logits)",
    )
    + "SELECT example_id, class_id, round(x/sum(x) OVER (PARTITION BY example_id),6) prob FROM e",
    "weighted_draw": "WITH " + sql.CLASS_LOGITS + ",\n" + _draw_sql("class_logits", 0.9, 6),
    "sample_top_k": "WITH "
    + sql.CLASS_LOGITS
    + ",\nkept AS (SELECT * FROM class_logits QUALIFY rank() OVER (PARTITION BY example_id ORDER BY logit DESC) <= 8),\n"
    + _draw_sql("kept", 0.9, 6),
    "head_rows": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
    "union_distinct": sql.with_views(sql.STORIES)
    + """SELECT DISTINCT shard_key, "name", word FROM (
 SELECT shard_key, unnest(features) "name", CAST(NULL AS BOOLEAN) word FROM stories
 UNION ALL SELECT shard_key, unnest(words), true FROM stories) q""",
}
