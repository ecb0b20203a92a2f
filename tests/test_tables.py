import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fablework.functions import cosine_schedule
from fablework.operators import history as hist
from fablework.operators import edits, metrics, ordinals, runs, sampling, scoring, splits, tokens
from fablework.operators.probes import fit_probes, probe_outputs
from fablework.operators.render import render, render_counts
from fablework.plans import corpus_build


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), i * 37, rng.randrange(5)) for i in range(400)]
    return spark.createDataFrame(rows, "g string, k bigint, v bigint")


def test_running_total_equals_the_plain_window(skewed):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0)))
    got = ordinals.running_total(skewed, ["g"], ["k"], [ordinals.id_bucket(F.col("k"), 6)], F.col("v"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_first_rows_equals_the_plain_window(skewed):
    w = Window.partitionBy("g").orderBy("k")
    want = skewed.withColumn("idx", F.row_number().over(w) - 1).filter("idx >= 7 and idx < 40")
    got = ordinals.first_rows(skewed, ["g"], ["k"], [ordinals.id_bucket(F.col("k"), 6)], 33, 7, max_groups=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_no_group_meets_in_one_window(skewed):
    plan = ordinals.ordinal(skewed, ["g"], ["k"], [ordinals.id_bucket(F.col("k"))])._jdf.queryExecution().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "_amount" in line]
    assert windows and all("_bucket0" in line for line in windows)


@pytest.mark.parametrize("n,chunk", [(1, 16), (3, 16), (7, 16), (200, 16), (500, 64)])
def test_smoothing_mirrors_like_numpy(spark, n, chunk):
    rng = np.random.default_rng(n)
    xs = rng.random(n)
    df = spark.createDataFrame([(1, i * 10, float(x)) for i, x in enumerate(xs)], "run_id bigint, iter bigint, m double")
    got = [r["m_smooth"] for r in hist.smoothed(df, "m", 2.0, chunk_rows=chunk).orderBy("iter").collect()]
    weights = np.array(hist.gaussian_weights(2.0))
    padded = np.pad(xs, 8, mode="symmetric")
    assert len(weights) == 17 and np.allclose(got, [weights @ padded[i : i + 17] for i in range(n)])


@pytest.mark.parametrize("n", [3, 6, 30, 700])
def test_moving_average_over_many_chunks(spark, n):
    xs = np.random.default_rng(n).random(n).tolist()
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "run_id bigint, iter bigint, m double")
    got = [r["ema"] for r in hist.moving_average(df, "m", keep=0.6).orderBy("iter").collect()]
    want, ema = [], None
    for x in xs[5:]:
        ema = x if ema is None else 0.6 * ema + (1 - 0.6) * x
        want.append(ema)
    assert np.allclose(got, want, atol=1e-9) and len(got) == len(want)


def test_step_time_across_chunks(spark):
    df = spark.createDataFrame([(1, i, i * i) for i in range(40)], "run_id bigint, iter bigint, t bigint")
    got = [r["step_time"] for r in hist.step_time(df, "t", chunk_rows=7).orderBy("iter").collect()]
    assert got == [None] + [i * i - (i - 1) ** 2 for i in range(1, 40)]


def test_running_best(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 5.0, 2.0, 2.0])], "run_id bigint, iter bigint, m double")
    rows = hist.running_best(df, "m").orderBy("iter").collect()
    assert [(r["best_before"], r["improved"]) for r in rows] == [(None, True), (3.0, False), (3.0, True), (2.0, False)]


def test_thinning(spark):
    df = spark.range(0, 1000).select(F.lit(1).alias("run_id"), F.col("id").alias("iter"))
    kept = [r["iter"] for r in hist.thinned(df, 200, 100).orderBy("iter").collect()]
    assert kept == list(range(0, 100, 20)) + [200, 400, 600, 800]


def test_exact_split_is_exact_and_whole(spark):
    df = spark.range(1003).withColumnRenamed("id", "story_id")
    flagged = splits.exact_split(df, 0.8, "story_id", seed=3)
    assert flagged.count() == 1003 and flagged.filter("train").count() == round(0.8 * 1003)
    share = splits.hash_split(df, 0.8, "story_id").filter("train").count() / 1003
    assert 0.75 < share < 0.85
    assert splits.exact_split(df.filter("story_id < 1"), 0.2, "story_id").first()["train"] is False


def test_epochs_differ_and_hold_every_block(spark):
    df = spark.createDataFrame([(s, b) for s in "abc" for b in range(20)], "shard_key string, block bigint")
    rows = splits.epoch_order(df, 2, seed=1).collect()
    orders = [[(r["shard_key"], r["block"]) for r in sorted((r for r in rows if r["epoch"] == e), key=lambda r: r["place"])] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]
    assert all(len({s for s, _ in order[i : i + 20]}) == 1 for order in orders for i in (0, 20, 40))


def test_ties_at_the_kth_value_stay(spark):
    df = spark.createDataFrame([(1, v) for v in (5.0, 4.0, 4.0, 4.0, 1.0)], "g int, v double")
    assert sorted(r["v"] for r in sampling.top_k_ties(df, "g", "v", 2).collect()) == [4.0, 4.0, 4.0, 5.0]


def test_draws_follow_the_probabilities(spark):
    df = spark.range(3000).select(F.col("id").alias("g"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("item"))
    df = df.withColumn("p", F.element_at(F.array(F.lit(0.2), F.lit(0.0), F.lit(0.8)), F.col("item") + 1))
    drawn = {r["item"]: r["count"] for r in sampling.weighted_draw(df, "g", "item", "p").groupBy("item").count().collect()}
    assert set(drawn) == {0, 2} and abs(drawn[0] / 3000 - 0.2) < 0.03 and sum(drawn.values()) == 3000


def test_describe_equals_pandas(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([0.0, 1.0, rng.uniform(-5, 5)])) for _ in range(301)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = df.toPandas().groupby("g")["x"].describe()
    for r in metrics.describe(df, "x", ["g"]).collect():
        w = want.loc[r["g"]]
        got = [r[c] for c in ("count", "mean", "min", "p25", "p50", "p75", "max")]
        assert np.allclose(got, [w[c] for c in ("count", "mean", "min", "25%", "50%", "75%", "max")])
        assert (r["std"] is None and math.isnan(w["std"])) or math.isclose(r["std"], w["std"])


def test_error_rates_divide_by_one_more(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "score double, label double")
    row = metrics.confusion(df).first()
    assert row["false_positive"] == pytest.approx(1 / 3) and row["false_negative"] == 0.0


def test_answers(spark):
    ask = "Q?"
    cases = {"Q? Unknown": (0.0, False), "Q? It is unclear": (0.0, True), "no Q? YES": (1.0, False), "Q? yes Q? no": (0.0, False), "yes": (1.0, False)}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    score, invalid = scoring.parse_answer(F.col("c"), ask)
    got = {r[0]: (r[1], r[2]) for r in df.select("c", score, invalid).collect()}
    assert got == cases


def test_only_misses_reach_the_scorer(spark):
    prompts = scoring.with_cache_id(
        spark.createDataFrame([(1, "p"), (2, "p"), (3, "q!"), (4, "r")], "story_id int, prompt string"), "m"
    )
    cache = prompts.filter("story_id = 4").select("cache_id", F.lit(1.0).alias("score"), F.lit("kept").alias("content"))
    assert sorted(r["prompt"] for r in scoring.missing(prompts, cache).collect()) == ["p", "q!"]
    rows = {r["cache_id"]: r["score"] for r in scoring.fresh_scores(prompts, cache, scoring.rule_scorer("Q?"), "Q?").collect()}
    by_story = {r["story_id"]: rows.get(r["cache_id"]) for r in prompts.collect()}
    assert by_story == {1: 0.0, 2: 0.0, 3: 1.0, 4: None} and len(rows) == 2


def test_missing_lookup_is_an_error(spark):
    df = spark.createDataFrame([("strange",)], "dataset_name string")
    with pytest.raises(Exception, match="no training type for strange"):
        runs.with_training_type(df, runs.training_types()).collect()


def test_training_types():
    types = runs.training_types()
    assert len(types) == 8 + 18
    assert types["F_features_x_Twist_features_Foreshadowing_MM_none_AT_features_Twist_0.5"] == (
        "Filtering + Specialisation + 50% Adversarial Training"
    )
    assert types["F_features_Foreshadowing_MM_features_Foreshadowing_Twist_AT_none"] == "Specialisation + Mix Match"


def test_baselines_are_replicated(spark):
    df = spark.createDataFrame(
        [("b", "Not in Pretraining", 0.0), ("a", "Not in Pretraining", 0.0), ("c", "Filtering", 1e-5)],
        "name string, deletion_type string, deletion_lr double",
    )
    rows = sorted(tuple(r) for r in runs.replicate_baselines(df, ["Not in Pretraining"], [1e-5, 1e-4]).collect())
    assert rows == [("a", "Not in Pretraining", 1e-5), ("a", "Not in Pretraining", 1e-4), ("c", "Filtering", 1e-5)] or rows == sorted(
        [("a", "Not in Pretraining", 1e-5), ("a", "Not in Pretraining", 1e-4), ("c", "Filtering", 1e-5)]
    )


def test_schedule(spark):
    df = spark.createDataFrame([(s,) for s in (0, 50, 100, 350, 600, 700)], "s int")
    rates = [r[0] for r in df.select(cosine_schedule(F.col("s"), 1.0, 100, 600)).collect()]
    assert rates == pytest.approx([0.0, 0.5, 1.0, 0.5, 0.0, 0.0])
    assert df.select(cosine_schedule(F.col("s"), 0.3, 100, 600, scheduled=False)).first()[0] == 0.3


def test_probes_beat_the_majority(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 4))
    rows = [(i, 0, v.tolist(), [int(v[0] > 0), int(v[1] - v[2] > 0)]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "example_id int, layer int, vector array<double>, target array<int>")
    outputs = probe_outputs(df, fit_probes(df, [0], features=2))
    rates = {r["feature"]: r["accuracy"] for r in metrics.probe_accuracy(outputs).collect() if r["feature"] is not None}
    assert set(rates) == {0, 1} and min(rates.values()) > 0.95


def test_probes_reach_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 1]
    y = (x @ rng.normal(size=(4, 2)) + rng.normal(size=(300, 2)) > 0).astype(int)
    rows = [(i % 2, x[i].tolist(), y[i].tolist()) for i in range(300)] + [(0, None, [1, 0]), (5, [1.0] * 4, [0, 1])]
    found = fit_probes(spark.createDataFrame(rows, "layer int, vector array<double>, target array<int>"), [0, 1], features=2, reg=0.05)
    assert set(found) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for (layer, f), w in found.items():
        a, b = x[layer::2], y[layer::2, f]
        slope = a.T @ (1 / (1 + np.exp(-a @ np.array(w))) - b) / len(a) + 0.05 * np.array(w)
        assert np.abs(slope).max() < 1e-5


def test_bands_of_means(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.gauss(n, 1.0)) for n, k in enumerate(["a", None]) for i in range(400)] + [("a", 900, None), ("c", 1, 3.0), ("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {r["k"]: r for r in hist.mean_bands(df, ["k"], "v", ["i"], replicates=300).collect()}
    assert set(got) == {"a", None, "c"} and (got["c"]["low"], got["c"]["high"], got["c"]["n"]) == (3.0, 3.0, 1)
    for k, n in (("a", 0), (None, 1)):
        r = got[k]
        assert r["n"] == 400 and r["low"] < r["mean"] < r["high"] and abs(r["high"] - r["low"] - 2 * 1.96 / 20) < 0.04
    again = {r["k"]: r["low"] for r in hist.mean_bands(df.repartition(7), ["k"], "v", ["i"], replicates=300).collect()}
    assert all(abs(again[k] - got[k]["low"]) < 1e-9 for k in got)


def test_a_later_run_replaces_the_whole_row_of_a_table(spark):
    rows = [(1, 0.0, 0.1), (1, 30.0, 0.3), (2, 0.0, 0.2), (2, 30.0, None), (2, 30.0, float("nan"))]
    history = spark.createDataFrame(rows, "run_id int, iter_num_gen double, s double")
    got = hist.score_pivot(history, F.lit("k"), (0, 30), "s").collect()
    assert [(r["key"], r["at_0"], r["at_30"]) for r in got] == [("k", 0.2, None)]


@pytest.mark.parametrize("spec", ["features", "features=", "=Twist", "features=A:x", "features=A:2", "features:A:0.5", "features!=A:0.5"])
def test_a_malformed_chance_is_an_error(spec):
    with pytest.raises(ValueError):
        edits.parse_chances(spec)


def test_thinning_needs_room_for_the_denser_part(spark):
    with pytest.raises(ValueError):
        hist.thinned(spark.range(3).withColumnRenamed("id", "iter"), 5, finer_before=10)


def test_rows_with_null_parts_are_skipped_and_counted(spark):
    full = ("s", 1, "A. B", "sum", None, ["w"], ["Twist"])
    rows = [full] + [tuple(None if i == n else v for i, v in enumerate(full)) for n in (2, 3, 5, 6)]
    df = spark.createDataFrame(
        rows, "shard_key string, story_id bigint, story string, summary string, sentence string, words array<string>, features array<string>"
    )
    assert [tuple(r) for r in render_counts(df).collect()] == [("s", 1, 4)] and render(df).count() == 1


def test_encoding_loses_no_word_and_no_row(spark):
    texts = spark.createDataFrame([("s", 1, "the cat the"), ("s", 1, "the cat the"), ("s", 2, "cat")], "shard_key string, story_id bigint, text string")
    counts = corpus_build.chunk_counts(texts)
    merges, _ = tokens.learn_merges(counts, 3)
    vocab = tokens.bpe_vocabulary(counts, merges)
    got = tokens.decode_tokens(corpus_build.bpe_tokens(texts, vocab, merges).withColumn("n", F.monotonically_increasing_id()), vocab, ("story_id", "n"))
    assert sorted(r["text"] for r in got.collect()) == ["cat", "the cat the", "the cat the"]
    ids = tokens.word_ids(tokens.merge_words(counts, merges), vocab)
    with pytest.raises(Exception, match="no ids for the word"):
        tokens.encode_text(texts.withColumn("text", F.lit("the zebra cat")), ids, counts).collect()
