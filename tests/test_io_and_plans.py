import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fablework.operators import history as hist
from fablework.operators import scoring, splits
from fablework.operators.blocks import bos_blocks, fixed_blocks, token_offsets
from fablework.plans import corpus_build, recipes, scoring_job
from fablework.session import fresh_path, shared_dir
from fablework.sources import json_ranges, readers, token_files, writers
from fablework.sources.readers import read_story_shards
from fablework.streaming import metrics as stream_metrics
from fablework.streaming import scores as stream_scores
from fablework.streaming import shards as stream_shards

from .conftest import SF


def story(text, **more):
    return {"story": text, "summary": "s", "instruction": {"words": ["w"], "features": ["Twist"]}, **more}


def test_story_shards(spark, tmp_path):
    (tmp_path / "data1.json").write_text(json.dumps([story("a"), story("b", sentence="given", extra=1)]))
    (tmp_path / "data10.json").write_text(json.dumps([story("c\nc"), story("a"), story("a")]))
    found = readers.read_story_shards(spark, str(tmp_path))
    rows = found.orderBy("shard_key", "story_id").collect()
    assert [(r["shard_key"], r["story"], r["sentence"]) for r in rows] == [
        ("data1.json", "a", None), ("data1.json", "b", "given"),
        ("data10.json", "c\nc", None), ("data10.json", "a", None), ("data10.json", "a", None),
    ]
    assert len({r["story_id"] for r in rows}) == 5 and [r["story_id"] % 2**32 for r in rows] == [0, 1, 0, 1, 2]
    assert found.count() == 5
    assert [tuple(r) for r in readers.shard_index(found).orderBy("shard_key").collect()] == [("data1.json", 2, 0), ("data10.json", 3, 1)]
    assert readers.first_shards(found, 1).count() == 2 and readers.early_stop_scan(found, 0).count() == 2
    assert splits.shard_split(found).filter("split = 'test'").count() == 2
    assert corpus_build.vocabulary_texts(found).count() == 5
    alone = readers.read_story_shards(spark, str(tmp_path), shards=1).collect()
    assert [r["story_id"] for r in alone] == [r["story_id"] for r in rows[:2]]  # other files don't matter
    assert readers.read_until(spark, str(tmp_path), 1).count() == 5


def test_broken_shard_fails_unless_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([story("a")]))
    (tmp_path / "b.json").write_text(json.dumps([story("b"), story("c")])[:-30])
    with pytest.raises(Exception, match="shard cannot be read"):
        readers.read_story_shards(spark, str(tmp_path)).count()
    assert readers.read_story_shards(spark, str(tmp_path), broken="skip").count() == 1
    assert [r["shard_key"] for r in readers.broken_shards(spark, str(tmp_path)).collect()] == ["b.json"]
    assert readers.read_story_shards(spark, str(tmp_path), shards=1).count() == 1  # the second is not opened


def test_documented_example(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"data{n}.json").write_text(json.dumps([story(f"The cat sat {n}. It ran."), story("A dog. It barked!")]))
    stories = read_story_shards(spark, str(tmp_path))
    custom = recipes.Recipe(filtering="features=Twist", refusal="features=Conflict:0.5")
    vocab, merges = corpus_build.learn_vocabulary(
        corpus_build.vocabulary_texts(read_story_shards(spark, str(tmp_path), shards=2)), 320
    )
    path = corpus_build.build_dataset(stories, custom, vocab, merges, str(tmp_path / "out"), 320)
    assert spark.read.parquet(path).count() == 6 and recipes.build_text(stories, "recovery-Twist").count() == 6


def test_equal_stories_in_a_streamed_shard_stay_apart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps([story("Same. Same."), story("Same. Same.")]))
    stream = stream_shards.stream_story_shards(spark, str(source))
    stream_shards.write_texts(stream, "recovery-Twist", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = {r["story_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {r["story_id"] for r in readers.read_story_shards(spark, str(source)).collect()} and len(streamed) == 2


def test_structure_from_any_cut():
    text = json.dumps([{"a": 'x"y\\ {[', "b": ["]", {"c": '\\\\\\"}'}]}, {"d": "\\"}, {}, {"é": "漢}"}], ensure_ascii=False).encode()
    data = np.frombuffer(text, np.uint8)
    whole, steps, end = json_ranges.structure(data, json_ranges.OUTSIDE)
    assert end == json_ranges.OUTSIDE and steps.sum() == 0 and bytes(data[whole]) == b"[{[{}]}{}{}{}]"
    for cut in range(len(data) + 1):
        left, _, state = json_ranges.structure(data[:cut], json_ranges.OUTSIDE)
        right, _, last = json_ranges.structure(data[cut:], state)
        assert np.concatenate([left, right + cut]).tolist() == whole.tolist() and last == end


def test_large_shards_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice('ab"\\\\{}[],: \n漢é') for _ in range(rng.randrange(40)))
    for name, count, indent in (("data1", 30, None), ("data 2", 7, 3), ("none", 0, None), ("one", 1, None)):
        rows = [story(part(), extra={"deep": [part(), {"x": part()}]}, sentence=part()) for _ in range(count)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=count == 7))
    want = sorted(map(repr, readers.read_story_shards(spark, str(tmp_path)).collect()))
    for split in (16, 1 << 20):
        assert sorted(map(repr, readers.read_large_shards(spark, str(tmp_path), split_bytes=split).collect())) == want, split
    assert len(want) == 38
    first = readers.read_large_shards(spark, str(tmp_path), shards=1, split_bytes=50)
    assert {r["shard_key"] for r in first.collect()} == {"data%202.json"}
    good = (tmp_path / "data1.json").read_bytes()
    broken = [good[:-20], b'[{"story": "a"} {"story": "b"}]', b'[1, {"story": "a"}]', good.replace(b"sentence", b"sent\xffnce", 1), b'[{"story" "a"}]']
    for data in broken:
        (tmp_path / "data1.json").write_bytes(data)
        with pytest.raises(Exception, match="shard cannot be read"):
            readers.read_large_shards(spark, str(tmp_path), split_bytes=60).collect()
        left = readers.read_large_shards(spark, str(tmp_path), broken="skip", split_bytes=60)
        assert {r["shard_key"] for r in left.collect()} == {"data%202.json", "one.json"}, data


def test_token_files(spark, tmp_path):
    for name, ids in {"a.bin": range(10), "b.bin": [1, 65535, 2], "empty.bin": []}.items():
        np.array(list(ids), dtype="<u2").tofile(tmp_path / name)
    pieces = token_files.read_token_bins(spark, str(tmp_path), piece_tokens=4, split_bytes=12)
    rows = sorted(tuple(r) for r in pieces.collect())
    assert rows == [("a", 0, 10, [0, 1, 2, 3]), ("a", 4, 10, [4, 5]), ("a", 6, 10, [6, 7, 8, 9]), ("b", 0, 3, [1, 65535, 2])]
    assert pieces.rdd.getNumPartitions() == 3  # ranges, not files
    found = fixed_blocks(pieces, 3).orderBy("shard_key", "block").collect()
    assert [r["chunk"] for r in found] == [[0, 1, 2, 3], [3, 4, 5, 6]]
    only = pieces.filter("shard_key = 'b'")
    assert only.rdd.getNumPartitions() == 1 and [r["tokens"] for r in only.collect()] == [[1, 65535, 2]]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number of bytes"):
        token_files.read_token_bins(spark, str(tmp_path)).collect()


def test_token_files_come_back(spark, tmp_path):
    rng = random.Random(4)
    shards = {"s 1/ü": 40, "data.00007": 25, "%": 9, "s": 1}
    rows = [(k, i, [1] + [rng.randrange(2, 65536) for _ in range(rng.randrange(0, 30))]) for k, n in shards.items() for i in range(n)]
    rng.shuffle(rows)
    stored = spark.createDataFrame(rows, "shard_key string, story_id bigint, tokens array<int>")
    want = {k: [t for _, _, x in sorted(r for r in rows if r[0] == k) for t in x] for k in shards}
    folder = str(tmp_path / "bins")
    for file_tokens in (1 << 20, 37):  # the second time it replaces the first
        token_files.write_token_bins(token_offsets(stored), folder, file_tokens)
        pieces = token_files.read_token_bins(spark, folder, piece_tokens=11, split_bytes=50)
        got = {}
        for r in sorted(pieces.collect(), key=lambda r: (r["shard_key"], r["before"])):
            assert r["total"] == len(want[r["shard_key"]]) and r["before"] == len(got.setdefault(r["shard_key"], []))
            got[r["shard_key"]] += r["tokens"]
        assert got == want
    assert max(f.stat().st_size for f in (tmp_path / "bins").glob("*.bin")) == 74
    assert not list((tmp_path / "bins").glob("_writing*")) and (tmp_path / "bins" / "_SUCCESS").exists()
    key = ["shard_key", "start", "chunk"]
    whole = sorted(tuple(r[c] for c in key) for r in bos_blocks(token_offsets(stored), 16).collect())
    assert whole and sorted(tuple(r[c] for c in key) for r in bos_blocks(pieces, 16, bos=1).collect()) == whole

    kept = sorted(f.name for f in (tmp_path / "bins").iterdir())
    wide = spark.createDataFrame([("s", 1, [1, 65536])], stored.schema)
    with pytest.raises(Exception, match="16 bits"):
        token_files.write_token_bins(token_offsets(wide), folder)
    assert sorted(f.name for f in (tmp_path / "bins").iterdir()) == kept  # a failed job leaves the old files alone
    next(f for f in (tmp_path / "bins").glob("s *.00001.bin")).unlink()
    with pytest.raises(Exception, match="is missing"):
        token_files.read_token_bins(spark, folder).collect()


def test_versions_stop_at_the_first_gap(spark, tmp_path):
    for v in (0, 1, 3):
        folder = tmp_path / f"v={v}"
        folder.mkdir()
        (folder / "t.json").write_text(json.dumps({"columns": ["generation", "iter_num"], "data": [[f"g{v}", v * 10], ["x", 5]]}, indent=1))
    rows = readers.read_version_tables(spark, str(tmp_path)).orderBy("version", "row_idx").collect()
    assert [(r["version"], r["row"]["generation"], r["row"]["iter_num"]) for r in rows] == [
        (0, "g0", "0"), (0, "x", "5"), (1, "g1", "10"), (1, "x", "5")
    ]


def test_version_tables_take_few_tasks_and_keep_their_folders(spark, tmp_path):
    wanted = [(v, i, f"g{v} {i}\n\"ü", None if v == 3 else "r") for v in range(60) for i in range(1 + v % 3)]
    rows = spark.createDataFrame(wanted, "version bigint, row_idx bigint, generation string, role string")
    for _ in range(2):  # the second time replaces the first
        writers.write_version_tables(rows.filter("version <> 50"), ["generation", "role"], str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("v=*/part=0")) == ["part=0"] * 59 and (tmp_path / "t" / "_SUCCESS").exists()
    (tmp_path / "t" / "v=49" / ".left").write_text("{")
    back = readers.read_version_tables(spark, str(tmp_path / "t"))
    assert back.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = sorted((r["version"], r["row_idx"], r["row"]["generation"], r["row"]["role"]) for r in back.filter("version <> 3").collect())
    assert got == [w for w in wanted if w[0] < 50 and w[0] != 3]
    assert [r["row"] for r in back.filter("version = 3").collect()] == [{"generation": "g3 0\n\"ü", "role": None}]
    (tmp_path / "t" / "v=2" / "part=0" / "table.json").write_text("{broken")
    (tmp_path / "t" / "v=9" / "part=0" / "table.json").write_text('[{"columns": ["a"], "data": [["1"]]}, {"columns": ["a"], "data": [["2"]]}]')
    rows = readers.read_version_tables(spark, str(tmp_path / "t")).select("version", "row").collect()
    assert {r["version"] for r in rows} == set(range(50)) - {2} and [r["row"] for r in rows if r["version"] == 9] == [{"a": "1"}, {"a": "2"}]


def test_vocabulary_file_keeps_quotes_and_order(spark, tmp_path):
    path = tmp_path / "v.vocab"
    path.write_text('<unk>\t0\n"\t-1\n▁\t-2\n', encoding="utf-8")
    odd = ["a\tb", "\\t", "\\", "x\n", "\\\t"]
    vocab = spark.createDataFrame([(i, p, -float(i)) for i, p in enumerate(odd)], "id int, piece string, score double")
    writers.write_vocabulary(vocab, str(tmp_path / "written"))
    back = readers.read_vocabulary(spark, str(tmp_path / "written")).orderBy("id").collect()
    assert [r["piece"] for r in back] == odd and [r["id"] for r in back] == list(range(5))
    rows = readers.read_vocabulary(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["piece"], r["score"]) for r in rows] == [(0, "<unk>", 0.0), (1, '"', -1.0), (2, "▁", -2.0)]


def test_shot_file(spark, tmp_path):
    path = tmp_path / "shots.txt"
    path.write_text("a\n\nb\n\nc\n\nd\n\ne")
    assert readers.read_shot_blocks(spark, str(path), 2).first()["shots"] == "a\n\nb\n\nc\n\nd"


def test_run_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"], float("nan")), (2, ["y"], 1.0)], "run_id bigint, tags array<string>, m double")
    df.write.parquet(str(tmp_path / "runs"))
    found, nothing = readers.read_runs(spark, str(tmp_path / "runs"), tag="x")
    assert nothing is None and [tuple(r) for r in found.collect()] == [(1, ["x"], None)]


def test_json_stream_gives_the_batch_rows(spark, tmp_path):
    source, target, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    (source / "a.json").write_text(json.dumps([story("One. Two"), story("Three")]))
    stream = stream_shards.stream_story_shards(spark, str(source))
    stream_shards.write_texts(stream, "recovery-Twist", str(target), str(state)).awaitTermination()
    (source / "b.json").write_text(json.dumps([story("Four")]))
    stream = stream_shards.stream_story_shards(spark, str(source))
    stream_shards.write_texts(stream, "recovery-Twist", str(target), str(state)).awaitTermination()
    stories = [r["text"].split("Story: ")[1] for r in spark.read.parquet(str(target)).collect()]
    assert sorted(stories) == ["Four", "One. Two", "Three"]


def test_each_prompt_is_scored_once_over_triggers(spark, tmp_path):
    source, cache, state = (str(tmp_path / n) for n in ("in", "cache", "state"))
    ask = "Q?"
    for names in (["p", "q!"], ["p", "p", "r"]):
        rows = scoring.with_cache_id(spark.createDataFrame([(n,) for n in names], "prompt string"), "m")
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = stream_shards.stream_tables(spark, source, rows.schema, 1)
        stream_scores.score_stream(stream, cache, state, scoring.rule_scorer(ask), ask).awaitTermination()
    found = writers.read_scores(spark, cache, distinct=False)
    assert found.count() == 3 and sorted(r["score"] for r in found.collect()) == [0.0, 0.0, 1.0]


def test_late_metric_rows_are_flagged_and_repaired(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    history = spark.createDataFrame(
        [(run, i * 10, float((i * 7 + run) % 5)) for run in (1, 2) for i in range(20)], "run_id bigint, iter bigint, loss_test double"
    )
    late = "run_id = 2 and iter = 50"
    parts = [history.filter(f"iter < 100 and not ({late})"), history.filter(f"iter >= 100 or ({late})")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
    stream = stream_shards.stream_tables(spark, source, history.schema, 1)
    stream_shards.append_rows(stream_metrics.running_metrics(stream, "loss_test"), target, state).awaitTermination()
    results = spark.read.schema(stream_metrics.OUTPUT).parquet(target)
    assert [(r["run_id"], r["iter"]) for r in results.filter("late").collect()] == [(2, 50)]
    fixed = stream_metrics.repaired(results, history, "loss_test").filter("ema is not null")
    want = hist.moving_average(history, "loss_test")
    got = {(r["run_id"], r["iter"]): round(r["ema"], 9) for r in fixed.collect()}
    assert got == {(r["run_id"], r["iter"]): round(r["ema"], 9) for r in want.collect()}


def test_rows_wait_for_those_that_come_late(spark, tmp_path):
    rng = random.Random(3)
    rows = [(run, i * 10, float(rng.randrange(90))) for run in (1, 2, 3) for i in range(40)]
    history = spark.createDataFrame(rows, "run_id bigint, iter bigint, loss_test double")
    order = sorted(rows, key=lambda r: r[1] + rng.random() * 100)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [order[i : i + 30] for i in range(0, len(order), 30)] + [[(1, None, None), (2, None, None)], [(2, 5, 1.0)]]
    for part in parts:
        spark.createDataFrame(part, history.schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_shards.stream_tables(spark, source, history.schema, 1)
        stream_shards.append_rows(stream_metrics.running_metrics(stream, "loss_test", slack=100), target, state).awaitTermination()
    results = spark.read.schema(stream_metrics.OUTPUT).parquet(target)
    assert [(r["run_id"], r["iter"]) for r in results.filter("late").collect()] == [(2, 5)]
    got = {(r["run_id"], r["iter"]): r for r in results.filter("not late").collect()}
    assert {k for k in got if k[0] < 3} == {(run, it) for run, it, _ in rows if run < 3}
    assert {it for run, it in got if run == 3} == {it for it in range(0, 400, 10) if it <= 290}  # the newest still wait
    want = {(r["run_id"], r["iter"]): round(r["ema"], 9) for r in hist.moving_average(history, "loss_test").collect()}
    assert all(round(got[k]["ema"], 9) == v for k, v in want.items() if k in got)
    best = {(r["run_id"], r["iter"]): (r["best_before"], r["improved"]) for r in hist.running_best(history, "loss_test").collect()}
    assert all((r["best_before"], r["improved"]) == best[k] for k, r in got.items())


def test_cache_table_append(spark, tmp_path):
    path = str(tmp_path / "c")
    row = spark.createDataFrame([("k", 1.0, "yes")], "cache_id string, score double, content string")
    assert writers.read_scores(spark, path).count() == 0 and not (tmp_path / "c").exists()  # reading writes nothing
    writers.append_scores(row, path)
    writers.append_scores(row.withColumn("cache_id", F.lit("l")), path)
    writers.append_scores(row.union(row.withColumn("cache_id", F.lit("l"))), path)
    assert sorted(r["cache_id"] for r in writers.read_scores(spark, path, distinct=False).collect()) == ["k", "l"]


def test_report_calls_the_scorer_once_for_each_missing_prompt(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def scorer(prompts):
        calls.add(len(prompts))
        return prompts.map(lambda p: "Q? Yes.")

    generations = spark.createDataFrame(
        [(v, i, f"story {i % 5}", i * 10) for v in range(3) for i in range(12)], "version int, row_idx bigint, generation string, iter_num bigint"
    )
    for _ in range(2):  # the second report finds everything in the cache
        report = scoring_job.generation_report(generations, str(tmp_path / "c"), scorer, "Q?", "m")
        assert sorted((r["version"], r["count"], r["mean"]) for r in report.collect()) == [(v, 12, 1.0) for v in range(3)]
    assert calls.value == 5


class Clumsy:
    """Notes each call in a folder; some prompts fail once, some always, one stops the task itself."""

    def __init__(self, folder, deadly):
        self.folder, self.deadly = folder, deadly

    def __call__(self, prompts):
        if prompts.eq(self.deadly).any():
            os._exit(1)  # what a lost executor does
        for p in prompts:
            if p.endswith("never"):
                raise ValueError(p)
            mark = f"{self.folder}/{p}-tried"
            if p.endswith("once") and not os.path.exists(mark):
                open(mark, "w").close()
                raise ConnectionError("busy")
        for p in prompts:
            with open(f"{self.folder}/{p}", "a") as f:
                f.write("x")
        return prompts.map(lambda p: "Q? Yes." if "3" in p else "Q? No.")


def test_answers_survive_failures_and_restarts(spark, tmp_path):
    notes, cache = tmp_path / "notes", str(tmp_path / "cache")
    notes.mkdir()
    names = [f"p{i}" + ("never" if i % 10 == 0 else "once" if i % 10 == 1 else "") for i in range(120)]
    rows = scoring.with_cache_id(spark.createDataFrame([(n,) for n in [*names, *names[:30]]], "prompt string"), "m")
    by_slice = {r["prompt"]: r["s"] for r in rows.select("prompt", F.pmod(F.xxhash64("cache_id"), F.lit(6)).alias("s")).collect()}
    deadly = next(n for n in names if by_slice[n] == 3 and n[-1].isdigit())
    options = dict(slice_rows=20, retry=scoring.Retry(attempts=3, first_wait=0.0), parallel=2, batch_rows=7)
    with pytest.raises(Exception, match="(?i)worker|crash|abort"):
        scoring_job.fill_cache(rows, cache, Clumsy(str(notes), deadly), "Q?", **options)
    kept = {n for n in names if by_slice[n] < 3 and not n.endswith("never")}
    held = {r["cache_id"] for r in writers.read_scores(spark, cache).collect()}
    ids = {r["prompt"]: r["cache_id"] for r in rows.collect()}
    assert held == {ids[n] for n in kept}  # the slices before the one that died
    for name in set(names) - kept:
        (notes / name).unlink(missing_ok=True)  # calls of the slice that was lost

    run = scoring_job.fill_cache(rows, cache, Clumsy(str(notes), None), "Q?", **options)
    failing = [n for n in names if n.endswith("never")]
    assert (run.asked, run.answered, run.failed) == (120 - len(kept), 120 - len(kept) - 12, 12)
    calls = {n: (notes / n).read_text() for n in names if (notes / n).exists()}
    assert calls == {n: "x" for n in names if n not in failing}  # no answered prompt was asked again
    errors = {r["cache_id"]: r["error"] for r in writers.read_failures(spark, cache).collect()}
    assert errors == {ids[n]: f"ValueError('{n}')" for n in failing}
    scores = {r["prompt"]: r["score"] for r in scoring_job.scored_rows(rows, cache).collect()}
    assert scores == {n: float("3" in n) for n in names if n not in failing}

    again = scoring_job.fill_cache(rows, cache, lambda p: p.map(lambda _: "Q? no"), "Q?")
    assert (again.asked, again.answered, again.failed) == (12, 12, 0) and writers.read_failures(spark, cache).count() == 0
    writers.compact_scores(spark, cache, str(tmp_path / "small"))
    assert len(list((tmp_path / "small").glob("*/*.parquet"))) <= 16
    assert sorted(writers.read_scores(spark, str(tmp_path / "small"), distinct=False).collect()) == sorted(writers.read_scores(spark, cache).collect())


def test_limits_on_failing_prompts(spark, tmp_path):
    rows = scoring.with_cache_id(spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string"), "m")
    calls = spark.sparkContext.accumulator(0)

    def broken(prompts):
        calls.add(1)
        raise ConnectionError("down")

    retry = scoring.Retry(attempts=5, first_wait=0.0, total=16)
    with pytest.raises(scoring_job.ScoringStopped):
        scoring_job.fill_cache(rows, str(tmp_path / "a"), broken, "Q?", slice_rows=20, retry=retry, parallel=2, most_failed=3)
    assert writers.read_failures(spark, str(tmp_path / "a")).count() < 40 and calls.value <= 30
    silent = scoring.score_prompts(rows, lambda p: p.map(lambda _: None), retry=retry).collect()
    assert {r["error"] for r in silent} == {"no answer"} and {r["content"] for r in silent} == {None}
    short = scoring.score_prompts(rows.limit(1), lambda p: p[:0], retry=scoring.Retry(2, 0.0)).collect()
    assert short[0]["attempts"] == 2 and "0 answers" in short[0]["error"]


def test_shared_folder_is_read_from_the_session(spark):
    assert fresh_path(spark, "x").startswith(shared_dir(spark)) and fresh_path(spark, "x") != fresh_path(spark, "x")


# ------------------------------------------------------------------ plans


def plan_of(spark, name):
    return entry_points.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


JVM_ONLY = ["recipe_filter_adv_Twist", "build_tokens", "bos_blocks", "smooth_history", "ema", "score_pivot", "version_metric", "left_pad"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_main_paths_have_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(spark, "runs_tagged")
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert "PushedFilters: [IsNotNull(user_id)" in plan_of(spark, "history_enriched")


def test_last_positions_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "mean_pool_last10")


def test_blocks_of_a_stored_dataset_take_one_shuffle(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", i, [1] + list(range(3, 3 + i % 9))) for i in range(50)], "shard_key string, story_id bigint, tokens array<int>"
    )
    writers.write_tokens(df, str(tmp_path), 8192, "d")
    stored = writers.read_tokens(spark, str(tmp_path), 8192, "d")
    cut = bos_blocks(token_offsets(stored), 8)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(cut.collect()) == sorted(bos_blocks(token_offsets(df), 8).collect())
    one = stored.filter("shard_key = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_key" in one


def test_filter_runs_below_the_text_work(spark):
    plan = plan_of(spark, "recipe_recovery_Twist")
    assert plan.index("array_contains") > plan.index("Story: ")
