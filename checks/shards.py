"""Shards of JSON arrays, written from all documents and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablework.session import fresh_path
from fablework.sources import readers, writers
from fablework.sources.sample_tables import stories
from fablework.streaming import shards as stream_shards

from . import sql

EARLY = 100


def _written(spark, folder):
    """All stories as shards of at most 256 ids each; returns the folder."""
    path = fresh_path(spark, "json-shards")
    shard = F.format_string("%s-%08d", F.col("shard_key"), F.shiftright("story_id", 8))
    writers.write_story_shards(stories(spark, folder).withColumn("shard_key", shard), path)
    return path


def _shown(rows):
    return rows.select(
        "shard_key", readers.place_in_shard(F.col("story_id")).alias("place"), F.md5("story").alias("story"), "summary",
        F.array_join("words", ",").alias("words"), F.array_join("features", ",").alias("features"),
    )


def json_shards(spark, folder):
    return _shown(readers.read_story_shards(spark, _written(spark, folder)))


def json_ranges(spark, folder):
    """One shard for each source, read in ranges of 32 KB."""
    path = fresh_path(spark, "json-shards")
    writers.write_story_shards(stories(spark, folder), path)
    return _shown(readers.read_large_shards(spark, path, split_bytes=32_768))


def json_shard_index(spark, folder):
    return readers.shard_index(readers.read_story_shards(spark, _written(spark, folder)))


def json_first_shards(spark, folder):
    return _shown(readers.read_story_shards(spark, _written(spark, folder), shards=3))


def json_early_stop(spark, folder):
    return _shown(readers.read_until(spark, _written(spark, folder), EARLY))


def json_stream(spark, folder):
    """Stories with a twist, as the stream renders them."""
    target, state = fresh_path(spark, "texts"), fresh_path(spark, "state")
    stream = stream_shards.stream_story_shards(spark, _written(spark, folder), 16)
    stream_shards.write_texts(stream, "recovery-Twist", target, state).awaitTermination()
    told = F.substring_index("text", "\nStory: ", -1)
    return spark.read.parquet(target).select(
        "shard_key", readers.place_in_shard(F.col("story_id")).alias("place"), F.md5(told).alias("story")
    )


QUERIES = {f.__name__: f for f in (json_shards, json_ranges, json_shard_index, json_first_shards, json_early_stop, json_stream)}

# ------------------------------------------------------------------ oracle SQL

_SHARDS = """shards AS (SELECT *, shard_key||'-'||printf('%08d', story_id>>8) shard,
 row_number() OVER (PARTITION BY shard_key, story_id>>8 ORDER BY story_id)-1 place,
 dense_rank() OVER (ORDER BY shard_key||'-'||printf('%08d', story_id>>8))-1 shard_idx FROM stories)"""
_SHOWN = """SELECT shard shard_key, CAST(place AS BIGINT) place, md5(story) story, summary,
 array_to_string(words,',') words, array_to_string(features,',') features FROM shards"""
_LOADED = f"""counts AS (SELECT shard_idx, count(*) n FROM shards GROUP BY 1),
loaded AS (SELECT shard_idx, coalesce(sum(n) OVER (ORDER BY shard_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) before FROM counts)"""
_ALL = sql.with_views(sql.STORIES, _SHARDS)

SQL = {
    "json_shards": _ALL + _SHOWN,
    "json_ranges": sql.with_views(sql.STORIES)
    + """SELECT shard_key, CAST(row_number() OVER (PARTITION BY shard_key ORDER BY story_id)-1 AS BIGINT) place, md5(story) story, summary,
 array_to_string(words,',') words, array_to_string(features,',') features FROM stories""",
    "json_shard_index": _ALL
    + "SELECT shard shard_key, CAST(count(*) AS BIGINT) n_rows, CAST(shard_idx AS BIGINT) shard_idx FROM shards GROUP BY shard, shard_idx",
    "json_first_shards": _ALL + _SHOWN + " WHERE shard_idx < 3",
    "json_early_stop": sql.with_views(sql.STORIES, _SHARDS, _LOADED)
    + _SHOWN + f" WHERE shard_idx IN (SELECT shard_idx FROM loaded WHERE before <= {2 * EARLY})",
    "json_stream": _ALL
    + f"""SELECT shard shard_key, CAST(place AS BIGINT) place, md5({sql.strip('story')}) story FROM shards
 WHERE list_contains(features,'Twist') AND len(list_filter(regexp_split_to_array(story,'[.!?]'), lambda s: NOT contains(s,'"'))) > 0""",
}
