"""Helpers that several operators share: words, stored tables, vectors in Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablework.session import fresh_path

#: A word: a run of anything but blank, TAB, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z in lower case.

    ``bytes.split`` cuts at exactly the six characters that ``WORD`` excludes.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions in here remove the files of their shuffles as they end; else these stay until the driver collects its garbage."""
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVE_SHUFFLES) if before is None else spark.conf.set(_REMOVE_SHUFFLES, before)


def stored(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, and the files outlive any executor. The folder is noted in ``scratch`` for ``remove``.
    """
    path = fresh_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the tables noted in ``scratch`` and forget them; what reads them must be stored by then."""
    while scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``(vec_id, vector)`` with an id and finite components only."""
    vector = F.col(vector_col)
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & vector.isNotNull() & ~F.coalesce(broken, F.lit(True))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")
    )


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    width = max(width or 0, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), _within(lengths)] = flat
    return out


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def text_slices(texts: pa.Array | pa.ChunkedArray, max_bytes: int = 8 << 20):
    """Slices ``(first, past)`` of a text column with about ``max_bytes`` each, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > max_bytes:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def remaining(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    blank = np.isin(np.frombuffer(data, np.uint8), np.array([9, 10, 11, 12, 13, 32], np.uint8))
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    kept, at = [], 0
    for first, past in sorted(spans):
        start = begins[first] if first < len(begins) else len(data)
        end = begins[past] if past < len(begins) else len(data)
        if start > at:
            kept.append(data[at:start])
        at = max(at, int(end))
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")
