"""Language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class LinearSVM:
    """A separating plane and the slope that turns its margin into a chance."""

    weights: np.ndarray
    bias: float
    slope: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x), -50, 50)))


@dataclass(frozen=True)
class LanguageModel:
    """Families of languages, a plane for each family, and one for each pair inside a family."""

    families: tuple[tuple[str, ...], ...]
    family_planes: tuple[LinearSVM, ...]
    pair_planes: dict[tuple[str, str], LinearSVM]
    features: int


def features_of(texts: list[str | None], features: int) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams (1 to 3) of whole lower-case texts, of length 1."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0\0".join([*raw, b""]), np.uint8)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), [len(r) + 2 for r in raw])[: len(data)]
    out = np.zeros(len(raw) * features)
    code = np.zeros(len(data), np.uint64)
    whole = np.ones(len(data), bool)
    for n in range(1, 4):
        shifted = data[n - 1 :].astype(np.uint64)
        code = code[: len(shifted)] * np.uint64(257) + shifted + np.uint64(1)
        whole = whole[: len(shifted)] & (shifted > 0)
        mixed = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(features)
        cell = doc[: len(shifted)] * features + mixed.astype(np.int64)
        out += np.bincount(cell[whole], minlength=len(out))
    out = np.sqrt(out.reshape(len(raw), features))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, positive: np.ndarray, cost: float = 200.0, rounds: int = 120) -> LinearSVM:
    """Linear SVM with squared hinge loss, both classes weighted alike, by accelerated gradient steps."""
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    centre = share @ x
    x = x - centre
    w, v, bias, bias_v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    step = 1 / (1 + 2 * cost * float((share * ((x * x).sum(axis=1) + 1)).sum()))
    for i in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v + bias_v))
        pull = 2 * cost * share * gap * y
        new_w = v - step * (v - pull @ x)
        new_bias = bias_v + step * pull.sum()
        push = i / (i + 3)
        v, bias_v = new_w + push * (new_w - w), new_bias + push * (new_bias - bias)
        w, bias = new_w, new_bias
    margin = x @ w + bias
    slope = 1.0
    for _ in range(30):  # one-dimensional logistic fit of the slope, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -50, 50)))
        first = (share * margin * (positive - p)).sum() - 0.001 * slope
        second = (share * margin**2 * p * (1 - p)).sum() + 0.001
        slope = min(max(slope + first / second, 0.1), 20.0)
    return LinearSVM(w.astype(np.float32), float(bias - centre @ w), float(slope))


def language_families(centres: dict[str, np.ndarray], count: int) -> list[tuple[str, ...]]:
    """Groups of similar languages: the closest two groups (mean cosine) are merged until ``count`` are left."""
    groups = [(k,) for k in sorted(centres)]
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in centres.items()}
    while len(groups) > max(1, count):
        _, i, j = max(
            (float(np.mean([unit[a] @ unit[b] for a in groups[i] for b in groups[j]])), -i, -j)
            for i, j in combinations(range(len(groups)), 2)
        )
        merged = tuple(sorted(groups[-i] + groups[-j]))
        groups = [g for n, g in enumerate(groups) if n not in (-i, -j)] + [merged]
    return sorted(groups)


def fit_languages(
    labelled: DataFrame, rows_per_language: int = 800, most_rows: int = 25_600, features: int = 4096,
    families: int | None = None, seed: int = 3, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
) -> LanguageModel:
    """Fit on rows with text and language; others are left out.

    The sample is bounded: about ``rows_per_language`` rows (by a hash of id and text) of each
    language, fewer where all of them would be more than ``most_rows``, and only their features come to
    the driver. Every language is learned; so many that less than eight rows of each would fit are an
    error. Languages are grouped into ``families`` (default: the root of their number) by how
    similar their features are.
    """
    usable = labelled.filter(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    ).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(seed), id_col, text_col).alias("pick"))
    counts = {
        r["lang"]: r["n"]
        for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_rows // 8 + 1).collect()
    }
    if not counts:
        return LanguageModel((), (), {}, features)
    if len(counts) > most_rows // 8:
        raise ValueError(f"more than {most_rows // 8} languages: raise most_rows")
    rows_per_language = min(rows_per_language, most_rows // len(counts))
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_language / n))).otherwise(chance)
    drawn = F.shiftright("pick", 11) / F.lit(float(1 << 53)) + F.lit(0.5) <= chance

    def featurised(batches):
        for batch in batches:
            for first, past in text_slices(batch["text"], 4 << 20):
                x = features_of(batch["text"].slice(first, past - first).to_pylist(), features)
                yield pa.RecordBatch.from_arrays(
                    [batch["lang"].slice(first, past - first),
                     pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], names=["lang", "x"],
                )

    most = 2 * rows_per_language * len(counts)
    rows = usable.filter(drawn).select("lang", "text").mapInArrow(featurised, "lang string, x binary").limit(most).collect()
    langs = np.array([r["lang"] for r in rows])
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], dtype=np.float32).reshape(len(rows), features)
    order = np.lexsort((x[:, 0], langs))  # rows come in any order; sums should not
    langs, x = langs[order], x[order]
    found = sorted(set(langs))
    groups = language_families({k: x[langs == k].mean(axis=0) for k in found}, families or math.ceil(math.sqrt(len(found))))
    planes = tuple(fit_svm(x, np.isin(langs, g)) for g in groups) if len(groups) > 1 else ()
    pairs = {}
    for group in groups:
        for a, b in combinations(group, 2):
            own = (langs == a) | (langs == b)
            pairs[a, b] = fit_svm(x[own], langs[own] == a)
    return LanguageModel(tuple(groups), planes, pairs, features)


def predict(model: LanguageModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row: the best family, then the most pairwise wins in it.

    The score is the family's share of all family chances times the mean chance of the
    language against the others of its family.
    """
    n = len(x)
    if len(model.families) > 1:
        chances = np.stack([p.chance(x) for p in model.family_planes], axis=1) + 1e-9
        family, sure = chances.argmax(axis=1), chances.max(axis=1) / chances.sum(axis=1)
    else:
        family, sure = np.zeros(n, int), np.ones(n)
    lang, score = np.full(n, UNDETERMINED, dtype=object), sure.astype(float)
    for f, group in enumerate(model.families):
        own = np.flatnonzero(family == f)
        if len(group) == 1 or not len(own):
            lang[own] = group[0]
            continue
        wins, mean = np.zeros((len(own), len(group))), np.zeros((len(own), len(group)))
        for i, j in combinations(range(len(group)), 2):
            p = model.pair_planes[group[i], group[j]].chance(x[own])
            wins[:, i] += p >= 0.5
            wins[:, j] += p < 0.5
            mean[:, i] += p / (len(group) - 1)
            mean[:, j] += (1 - p) / (len(group) - 1)
        best = (wins + mean / 2).argmax(axis=1)  # equal wins: the greater mean chance
        lang[own] = np.array(group, dtype=object)[best]
        score[own] *= mean[np.arange(len(own)), best]
    return lang, np.clip(score, 0.0, 1.0)


def predict_languages(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score"
) -> DataFrame:
    """Add the predicted language and its score from whole texts; all other columns stay.

    A null text, one without any letter, or a model without languages gives ``und`` and 0. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # planes of bounded number and size
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    schema = docs.select(*kept, F.lit("").alias(lang_col), F.lit(0.0).cast("double").alias(score_col)).schema

    def label(batches):
        fitted = shared.value
        for batch in batches:
            for first, past in text_slices(batch[text_col], 4 << 20):
                part = batch.slice(first, past - first)
                texts = part[text_col].to_pylist()
                lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
                lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
                if fitted.families:
                    for some in np.array_split(np.flatnonzero(lettered), 1 + lettered.sum() // 512):
                        lang[some], score[some] = predict(fitted, features_of([texts[i] for i in some], fitted.features))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*kept, lang_col, score_col],
                )

    return docs.mapInArrow(label, schema)


def trainable(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    """Rows to learn from: crc32 of the id as text doesn't leave ``held``; null ids are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds) != F.lit(held), F.lit(True))
