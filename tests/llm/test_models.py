"""Held-out accuracy and defined results of the two classifiers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablework.llm.langid import fit_languages, fit_svm, language_families, predict_languages, trainable
from fablework.llm.quality import fit_quality, held_out, score_quality

SYLLABLES = {
    "aa": ["lo", "mi", "ra", "te"], "ab": ["lo", "mi", "ra", "tu"], "ba": ["zek", "vot", "krz", "pny"], "bb": ["zek", "vot", "krz", "pnu"],
}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_within_families(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    rows += [(1000, None, "aa"), (1001, "12 ... !!", "aa"), (1002, text(rng, "ab"), None), (1003, "", None), (None, text(rng, "ba"), "ba")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, lang_score string")
    model = fit_languages(docs.filter(trainable(F.col("doc_id"))), features=1024)
    assert sorted(model.families) == [("aa", "ab"), ("ba", "bb")]
    got = predict_languages(docs, model).collect()
    assert all(0 <= r["lang_score"] <= 1 for r in got) and len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 1000]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by_id[i] for i in (1000, 1001, 1003)] == ["und"] * 3 and by_id[1002] == "ab"


def test_languages_without_examples(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in predict_languages(docs, fit_languages(docs)).collect()] == ["und"]
    one = fit_languages(docs.withColumn("lang", F.lit("xx")))
    assert [(r["lang_pred"], r["lang_score"]) for r in predict_languages(docs, one).collect()] == [("xx", 1.0)]
    assert predict_languages(docs.limit(0), one).count() == 0


def test_planes_and_families():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    plane = fit_svm(x, x[:, 0] > 0)
    assert np.mean((plane.margin(x) > 0) == (x[:, 0] > 0)) > 0.97
    centres = {"a": np.array([1.0, 0]), "b": np.array([0.9, 0.1]), "c": np.array([0, 1.0])}
    assert language_families(centres, 2) == [("a", "b"), ("c",)]


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = text(rng, "aa", 60)
        rows.append((i, w if good else " ".join(x.upper() + "!!" for x in w.split()), "clash"))
        labels.append((i, int(good)))
    rows += [(900, None, "c"), (901, "", "c"), (902, text(rng, "aa", 30_000), "c"), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    marked = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, label int")
    model = fit_quality(docs, marked.filter(~held_out(F.col("doc_id"), 5, 0)))
    got = score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held]) >= 0.95
    again = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = fit_quality(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    assert [r["score"] for r in score_quality(docs, none).collect()] == [0.5, 0.5]
    one = fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, label int"))
    assert [r["score"] for r in score_quality(docs, one).collect()] == [1.0, 1.0] and score_quality(docs.limit(0), one).count() == 0


def test_more_than_64_languages_are_learned(spark):
    rng = random.Random(3)
    rows = [(70 * i + n, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{rng.randrange(9)}zz" for _ in range(30)), f"l{n:02d}") for i in range(10) for n in range(70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit_languages(docs, features=512, most_rows=700)
    assert len([x for f in model.families for x in f]) == 70
    with pytest.raises(ValueError, match="most_rows"):
        fit_languages(docs, features=512, most_rows=400)


def test_quality_reads_the_ends_of_long_texts(spark):
    rng = random.Random(4)
    plain, junk = lambda n: text(rng, "aa", n), lambda n: " ".join(w.upper() + "!!" for w in text(rng, "aa", n).split())
    rows = [(i, plain(600) + " " + (plain(900) if i % 2 else junk(900))) for i in range(200)]  # alike for 3,000 characters
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id bigint, label int")
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, marks)).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(150, 200)]) >= 0.95
