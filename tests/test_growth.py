"""Jobs, tasks, triggers and calls whose number or size must not grow with the tables."""

import json

import numpy as np

from fablework.operators import merging, scoring, tokens
from fablework.plans import corpus_build, scoring_job
from fablework.sources import json_ranges, readers, writers
from fablework.streaming import blocks as stream_blocks
from fablework.streaming import shards as stream_shards


def asked(spark, count):
    return scoring.with_cache_id(spark.createDataFrame([(f"p{i}",) for i in range(count)], "prompt string"), "m")


def test_slices_are_few_and_lose_no_prompt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring_job, "MOST_SLICES", 3, raising=False)
    commits, write = [], scoring_job.write_new_scores
    monkeypatch.setattr(scoring_job, "write_new_scores", lambda *a: (commits.append(1), write(*a)))
    run = scoring_job.fill_cache(asked(spark, 12), str(tmp_path / "c"), scoring.rule_scorer("Q?"), "Q?", slice_rows=1)
    assert len(commits) <= 3 and (run.asked, run.answered) == (12, 12)


def test_a_slice_lies_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring_job, "FILE_ROWS", 5, raising=False)
    monkeypatch.setattr(scoring_job, "fresh_path", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join such small partitions again
    try:
        run = scoring_job.fill_cache(asked(spark, 120), str(tmp_path / "c"), scoring.rule_scorer("Q?"), "Q?", slice_rows=60)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert run.answered == 120
    rows = [spark.read.parquet(str(f)).count() for f in (tmp_path / "slices").glob("*/*.parquet")]
    assert sum(rows) == 120 and max(rows) < 60


def test_calls_of_a_scorer_are_bounded(spark):
    def counted(prompts):
        return prompts.map(lambda _: str(len(prompts)))

    found = scoring.score_prompts(asked(spark, 2_500).coalesce(1), counted).collect()
    assert len(found) == 2_500 and max(int(r["content"]) for r in found) <= 1_000


def test_short_ranges_share_tasks(spark, tmp_path):
    rows = [{"story": f"{i} " + "x" * 50, "summary": "", "sentence": None, "instruction": {"words": [], "features": []}} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    files = readers.story_files(spark, str(tmp_path)).select("path", "length")
    assert json_ranges.array_elements(files, 64).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    found = readers.read_large_shards(spark, str(tmp_path), split_bytes=64).collect()
    assert sorted(r["story"] for r in found) == sorted(r["story"] for r in rows)


def test_a_shard_is_written_story_by_story(spark, stories_of, tmp_path):
    df = stories_of(*[("s", i, f"t{i}", ["w"], ["Twist"]) for i in (3, 1, 2)], ("t", 9, "u", ["w"], []))
    writers.write_story_shards(df, str(tmp_path / "out"))
    lines = [f.read_text().splitlines() for f in sorted((tmp_path / "out").glob("shard=*/*.txt"))]
    assert [len(x) for x in lines] == [3, 1]  # no line holds a shard
    assert [[s["story"] for s in json.loads("".join(x))] for x in lines] == [["t1", "t2", "t3"], ["u"]]


def test_many_files_take_few_triggers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_shards, "MOST_TRIGGERS", 3, raising=False)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).repartition(9).write.parquet(source)
    stream = stream_shards.stream_tables(spark, source, "id bigint", 1)
    query = stream_shards.append_rows(stream, target, str(tmp_path / "state"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) <= 4
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == list(range(40))


def test_encoding_shuffles_no_text(spark):
    docs = spark.createDataFrame(
        [("s", 1, ["a", "b", "a", "c"]), ("s", 2, []), ("s", 3, None)], "shard_key string, story_id bigint, words array<string>"
    )
    vocab = spark.createDataFrame([("a", 2, 259), ("b", 1, 260)], "w string, c bigint, id int")
    encoded = tokens.encode_words(docs, vocab)
    assert sorted((r["story_id"], r["tokens"]) for r in encoded.collect()) == [(1, [1, 259, 260, 259, 0]), (2, [1])]
    assert "posexplode" not in encoded._jdf.queryExecution().executedPlan().toString()


def test_byte_pairs_are_encoded_where_the_text_is(spark):
    texts = spark.createDataFrame([("s", i, t) for i, t in enumerate(["ab ab c", "", None, "é ab\n"])], "shard_key string, story_id bigint, text string")
    counts = spark.createDataFrame([("▁ab", 3), ("▁c", 1)], "w string, c bigint")
    merges, _ = tokens.learn_merges(counts, 2)
    vocab = tokens.bpe_vocabulary(counts, merges)
    encoded = corpus_build.bpe_tokens(texts, vocab, merges)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    ids = tokens.cut_texts(texts)
    words = tokens.word_counts(ids)
    joined = tokens.encode_cut(ids, tokens.word_ids(tokens.merge_words(words, merges), vocab), words)
    assert sorted(map(tuple, encoded.collect())) == sorted(map(tuple, joined.collect()))


def test_decoding_moves_lists_and_no_single_tokens(spark):
    vocab = tokens.bpe_vocabulary(spark.createDataFrame([("a", 1)], "w string, c bigint"), [])
    ids = lambda t: [1] + [b + 3 for b in ("▁" + t.replace(" ", "▁")).encode()]
    rows = [("s", 1, ids("one é")), ("s", 2, ids("two")[:-1] + [60000, None]), ("s", 3, []), ("s", 4, None), ("s", 5, [1]),
            ("s", 6, ids("漢")[:-1]), (None, None, ids("x")), ("t", 7, ids("b")), ("t", 7, ids("ac"))]
    found = tokens.decode_tokens(spark.createDataFrame(rows, "shard_key string, story_id bigint, tokens array<int>"), vocab)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Generate" not in plan
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("s", 1, "one é"), ("s", 2, "tw"), ("s", 5, ""), ("s", 6, "\ufffd"), (None, None, "x"), ("t", 7, "\u2596\ufffd\ufffdabc")], key=str)


def test_a_merge_looks_at_its_own_places_alone():
    pieces = np.concatenate([[1, 2], np.full(200_000, 3)])
    part = merging.Part(pieces, np.array([2, 200_000]), np.array([5, 1]))
    part.places(9, 9)  # the index is there
    kept = part.pieces
    codes, sums = part.merge(1, 2, 7, True)
    assert part.pieces is kept and len(part.places(7, 9)) == 0  # no array of the part was made anew
    assert codes.tolist() == [merging.pair_code(1, 2)] and sums.tolist() == [-5] and part.rest()[0][:3].tolist() == [7, 3, 3]


def test_a_trigger_of_blocks_comes_in_frames(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("s", i, list(range(i, i + 50))) for i in range(100)]
    spark.createDataFrame(rows, "shard_key string, story_id bigint, tokens array<int>").coalesce(1).write.parquet(source)
    monkeypatch.setattr(stream_blocks, "FRAME_BLOCKS", 3, raising=False)
    stream = stream_shards.stream_tables(spark, source, "shard_key string, story_id bigint, tokens array<int>", 1)
    stream_shards.append_rows(stream_blocks.stream_blocks(stream, 10), target, str(tmp_path / "state")).awaitTermination()
    found = spark.read.schema(stream_blocks.BLOCKS).parquet(target).orderBy("block").collect()
    flat = [t for _, _, x in rows for t in x]
    assert [r["chunk"] for r in found] == [flat[i * 10 : i * 10 + 11] for i in range(499)]


def test_shard_folders_are_listed_once_and_by_few_tasks(spark, tmp_path, monkeypatch):
    for n in range(70):
        folder = tmp_path / f"shard=s-{n:03d}"
        folder.mkdir()
        (folder / "part.json").write_text(json.dumps([{"story": f"Story {n}."}]))
    context, usual = spark.sparkContext, spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    tracker, listed = context.statusTracker(), []
    files = readers.story_files
    monkeypatch.setattr(readers, "story_files", lambda *args: listed.append(args) or files(*args))
    try:
        context.setJobGroup("list-shards", "shards are listed")
        found = readers.story_files(spark, str(tmp_path))
        jobs = tracker.getJobIdsForGroup("list-shards")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tasks = [tracker.getStageInfo(stage).numTasks for job in jobs for stage in tracker.getJobInfo(job).stageIds]
    assert found.count() == 70 and tasks and max(tasks) <= 4 * context.defaultParallelism < 70
    listed.clear()
    rows = readers.read_until(spark, str(tmp_path), 15).select("shard_key").collect()  # runs of 8, 16 and 32 shards
    assert sorted(r["shard_key"] for r in rows) == [f"s-{n:03d}" for n in range(31)] and len(listed) == 1
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == usual
