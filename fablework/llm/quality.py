"""Quality scores from zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration of the difference of compressed sizes."""

    good: bytes
    bad: bytes
    knots: tuple[float, ...]  # ascending differences
    chances: tuple[float, ...]  # share of good text at the knots
    level: int = 6


@functools.lru_cache(maxsize=4)
def _packers(model: QualityModel):
    import zstandard as zstd

    def packer(dictionary: bytes):
        data = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=model.level)
        return zstd.ZstdCompressor(
            level=model.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    return packer(model.good), packer(model.bad)


def _size(packer, data: bytes, piece: int) -> int:
    """Compressed size of all of ``data``, in pieces that each start from the dictionary."""
    return sum(len(packer.compress(data[i : i + piece])) for i in range(0, len(data), piece))


def size_difference(model: QualityModel, text: str | None, piece: int = 2048) -> float:
    """(size with the bad dictionary - size with the good one) / length; 0 for an empty text.

    The pieces keep a text from becoming its own dictionary, so that each part of a long
    text speaks for one of the two.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    good, bad = _packers(model)
    return (_size(bad, data, piece) - _size(good, data, piece)) / len(data)


def fit_quality(
    docs: DataFrame, labels: DataFrame, dictionary_bytes: int = 524_288, most_rows: int = 2000,
    calibration_rows: int = 2000, seed: int = 5,
) -> QualityModel:
    """Fit on the texts of ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, label``: 1 good, 0 bad) marks.

    The sample is bounded: at most ``most_rows`` rows of each label for the dictionaries and
    ``calibration_rows`` of each label, other rows, for the calibration, by a hash of the id.
    It is drawn from the labels alone, so that its ids go to the texts and no text is moved. Of a dictionary's
    text comes a part from anywhere in it, by a hash, so that the parts fill ``dictionary_bytes``; the texts of
    the calibration are scored whole where they are, and only the scores come to the driver.
    The calibration is isotonic: pooled shares of good rows along the difference, weighted to the labels'
    shares of all rows. Labels that are neither 0 nor 1, null ids and null texts are left out. Without texts of
    both labels every score is the share of good rows (0.5 without any).
    """
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("pick")
    )
    share = usable.agg(F.avg("label").alias("good")).first()["good"]
    prior = 0.5 if share is None else float(share)
    half = F.pmod("pick", F.lit(2)).cast("int")
    drawn = [
        usable.filter((F.col("label") == label) & (half == part)).orderBy("pick", "doc_id").limit(most)
        for part, most in ((0, most_rows), (1, calibration_rows)) for label in (0, 1)
    ]
    sample = stored(functools.reduce(DataFrame.union, drawn).select("doc_id", "label", "pick", half.alias("part")), "quality-sample")
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(sample), "doc_id")  # at most 2 * (both bounds) ids
    sizes = {r["label"]: r["n"] for r in sample.filter("part = 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = F.when(F.col("label") == 1, F.lit(_part_size(dictionary_bytes, sizes.get(1)))).otherwise(F.lit(_part_size(dictionary_bytes, sizes.get(0))))
    start = F.pmod(F.xxhash64("pick", "text"), F.greatest(F.length("text") - size, F.lit(0)) + 1) + 1
    rows = texts.filter("part = 0").select("doc_id", "label", F.substr("text", start.cast("int"), size).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    good, bad = (_dictionary([r["text"] for r in rows if r["label"] == label], dictionary_bytes) for label in (1, 0))
    raw = QualityModel(good, bad, (0.0,), (prior,))
    if not good or not bad:
        return raw
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def differences(batches):
        for batch in batches:
            found = pa.array([size_difference(shared.value, t.as_py()) for t in batch["text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["label"], found], names=["label", "difference"])

    held = texts.filter("part = 1").select("label", "text").mapInArrow(differences, "label int, difference double").toArrow()
    label, x = held["label"].to_numpy(), held["difference"].to_numpy()
    if not (label == 0).any() or not (label == 1).any():
        return raw
    knots, chances = _isotonic(np.sort(x[label == 0]), np.sort(x[label == 1]), prior)
    return QualityModel(good, bad, tuple(knots), tuple(chances))


def _part_size(size: int, texts: int | None) -> int:
    return max(256, size // max(texts or 1, 1))


def _dictionary(parts: list[str], size: int) -> bytes:
    """The parts of all texts, up to ``size`` bytes."""
    return b"\n".join(t.encode("utf-8", "surrogatepass") for t in parts)[-size:]


def _isotonic(bad: np.ndarray, good: np.ndarray, prior: float, pool: int = 25) -> tuple[list[float], list[float]]:
    """Knots and chances of a rising step-wise fit, by pooling adjacent violators."""
    x = np.concatenate([bad, good])
    y = np.concatenate([np.zeros(len(bad)), np.ones(len(good))])
    w = np.concatenate([np.full(len(bad), (1 - prior) / len(bad)), np.full(len(good), prior / len(good))])
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    blocks: list[list[float]] = []  # weight, weighted labels, weighted x
    for i in range(0, len(x), pool):
        s = slice(i, i + pool)
        blocks.append([w[s].sum(), (w[s] * y[s]).sum(), (w[s] * x[s]).sum()])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[2] / b[0] for b in blocks], [min(max(b[1] / b[0], 0.001), 0.999) for b in blocks]


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col`` (0 to 1, higher is better) from whole texts; all other columns stay.

    A null or empty text has difference 0. Rows keep their partitions; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    schema = docs.withColumn(score_col, F.lit(0.0).cast("double")).schema

    def score(batches):
        fitted = shared.value
        for batch in batches:
            d = np.array([size_difference(fitted, t.as_py()) for t in batch[text_col]], dtype=np.float64)
            values = pa.array(np.interp(d, fitted.knots, fitted.chances), pa.float64())
            yield _with(batch, score_col, values)

    return docs.mapInArrow(score, schema)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with a column added, or replaced in its place."""
    names = list(batch.schema.names)
    columns = list(batch.columns)
    if name in names:
        columns[names.index(name)] = values
    else:
        names.append(name)
        columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds) == F.lit(fold), F.lit(False))
