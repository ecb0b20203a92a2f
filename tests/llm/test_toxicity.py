"""Voters, the label model and the classifier of toxic texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fablework.llm.quality import held_out
from fablework.llm.toxicity import (
    KINDS, LEXICONS, MINED, PATTERNS, VOTERS, coded_words, fit_label_model, fit_toxicity, logistic, score_toxicity, vote_patterns,
)

NO_LISTS = ((),) * (2 * MINED)


def votes(*texts, mined=NO_LISTS):
    column = pa.array(texts, pa.string())
    found = vote_patterns(column, coded_words(column, KINDS), mined)
    return [{v for i, v in enumerate(VOTERS) if p >> i & 1} for p in found]


def test_voters():
    mined = (("zork",), (), (), ("grub",), (), ())
    assert votes(
        "a quiet day", None, "", "You utter IDIOT", "SHOUTING ALL THE WAY", "no!! way", "id*ot and f@ce", "zork", "grubby grubber", "grubby grubby grub",
        "grubby grubber " + "word " * 400, "idiotic", "you are not here but an idiot", mined=mined,
    ) == [
        set(), set(), set(), {"mind", "addressed"}, {"shouted"}, {"exclaimed"}, {"masked"}, {"mined0"}, {"stems0"}, set(), set(), set(), {"mind"},
    ]


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.2
    chance = {1: [0.8, 0.7, 0.6, 0.5], 0: [0.05, 0.1, 0.02, 0.5]}
    draws = np.stack([rng.random(len(y)) < np.where(y, chance[1][j], chance[0][j]) for j in range(4)], axis=1)
    draws = np.column_stack([draws, draws[:, 0]])  # the last voter copies the first
    patterns, place = np.unique(draws @ (1 << np.arange(5)), return_inverse=True)
    known = rng.random(len(y)) < 0.2
    count = lambda mask: np.bincount(place[mask], minlength=len(patterns)).astype(float)
    model, shared = fit_label_model(patterns, count(~known), count(known & ~y), count(known & y), 5)
    pairs = {frozenset((j, p)) for j, p in enumerate(model.parents) if p >= 0}
    assert frozenset((0, 4)) in pairs and shared[0, 4] > 10 * shared[1, 2]
    right = ((model.posterior(patterns)[place] > 0.5) == y).mean()
    copied = [p for p in range(len(patterns)) if patterns[p] == 0b10001]
    want = 0.2 * 0.8 * 0.3 * 0.4 * 0.5 / (0.2 * 0.8 * 0.3 * 0.4 * 0.5 + 0.8 * 0.05 * 0.9 * 0.98 * 0.5)
    assert right > 0.93 and abs(model.posterior(patterns)[copied[0]] - want) < 0.08  # the copy does not count twice
    alone = fit_label_model(np.array([0, 1, 3]), np.array([50.0, 5, 5]), np.zeros(3), np.zeros(3), len(VOTERS))[0]
    assert alone.posterior(np.array([0]))[0] < 0.5 < alone.posterior(np.array([3]))[0]


def rows_and_labels(n=900, seed=5):
    rng = random.Random(seed)
    syllables = ["lo", "mi", "ra", "te", "zu", "pe", "ka", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 200))], rng.random() < 0.15
        bad = [rng.choice(["idiot", "scum", "vrak", "loser"]), "vrak"] if i % 2 else ["vexo" + word(), "vexo" + word(), "vexo" + word()]
        for b in bad if toxic else []:
            for _ in range(1 + len(words) // 100):
                words.insert(rng.randrange(len(words)), b)
        rows.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
        else:
            labels.append((i, None))
        rows[-1] = (*rows[-1], int(toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = rows_and_labels()
    extra = [(2000, None, 0), (2001, "", 0), (None, "lo mi ra you idiot scum", 1), (2002, ("lo mi ra te " * 20_000), 0), (2003, "loser idiot scum vrak " * 9, 1)]
    docs = spark.createDataFrame([(i, t, y, "clash", "clash") for i, t, y in rows + extra], "doc_id bigint, text string, truth int, score string, label string")
    marks = spark.createDataFrame(labels + [(None, 1), (9999, 1), (3, 7)], "doc_id bigint, label int")
    learned = marks.filter(~held_out(F.col("doc_id"), 5, 0))
    model = fit_toxicity(docs, learned)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["label"] == "clash" for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 2000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    wrong = [r for r in held if (r["score"] >= 0.5) != bool(r["truth"])]
    assert sum(r["truth"] for r in held) > 10 and len(wrong) <= 0.02 * len(held)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[2000] == by_id[2001] < 0.5 and by_id[2002] < 0.5 < by_id[2003] and by_id[None] > 0.5
    assert "vrak" in model.mined[0] and any(s.startswith("vexo"[:3]) for s in model.mined[MINED])
    assert model.accuracies["mined0"] > model.accuracies["shouted"] and len(model.correlations) == len(VOTERS) - 1

    again = fit_toxicity(docs.repartition(7), learned.repartition(3))
    assert again.mined == model.mined and again.words == model.words and np.allclose(again.weights, model.weights)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot scum" if i % 4 == 0 else "a calm line of words") for i in range(40)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, label int")
    scores = {r["text"]: r["score"] for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()}
    assert scores["you idiot scum"] > 0.5 > scores["a calm line of words"]
    empty = fit_toxicity(docs.limit(0), none)
    assert score_toxicity(docs.limit(0), empty).collect() == [] and {r["score"] for r in score_toxicity(docs, empty).collect()} == {0.5}


def test_lists_are_lower_case_and_apart():
    words = [w for chosen in LEXICONS.values() for w in chosen]
    assert len(words) == len(set(words)) and all(w == w.lower() for w in words) and len(VOTERS) == len(LEXICONS) + 2 * MINED + len(PATTERNS)


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 2, (2000, 3)), np.ones(2000)]).astype(float)
    y = 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.0, -0.5]))))
    assert np.allclose(logistic(x, y, np.ones(2000), ridge=1e-6), [2, -1, 0, -0.5], atol=1e-3)
