"""JSON-array shards read in byte ranges by many tasks.

Whether a byte lies inside a string, and how deep in brackets, depends on all bytes before it. A first
pass reads every range for each state that it may begin in and notes the state at its end, the change of
depth and how many objects begin at each depth. Composed along a file, these small rows give every
range its true start and the number of stories before it; a second pass then cuts the stories out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import open_file

#: What a byte may begin in: outside of strings, inside one, inside one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
SPLIT_BYTES = 32 << 20
TASK_BYTES = 32 << 20  # of short ranges that a task reads one after the other
_MORE = 1 << 20  # bytes read at a time beyond a long range's end
_LEAST_MORE = 1 << 14  # and beyond a short one's

_OPEN, _CLOSE, _QUOTE, _BACKSLASH, _BRACE = (np.frombuffer(b, np.uint8) for b in (b"{[", b"}]", b'"', b"\\", b"{"))


def structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(places, steps, end state)``: brackets outside of strings, with +1 or -1 for each."""
    index = np.arange(len(data))
    plain = np.where(data != _BACKSLASH[0], index, -1)
    last = np.append(-1, np.maximum.accumulate(plain)) if len(data) else np.array([-1])  # last other byte before each place
    carried = np.where(last == -1, int(state == ESCAPED), 0)

    def odd(at: np.ndarray) -> np.ndarray:
        return (at - 1 - last[at] + carried[at]) % 2 == 1

    quotes = np.flatnonzero(data == _QUOTE[0])
    quotes = quotes[~odd(quotes)]
    brackets = np.flatnonzero(np.isin(data, np.concatenate([_OPEN, _CLOSE])))
    started = int(state != OUTSIDE)
    outside = (np.searchsorted(quotes, brackets) + started) % 2 == 0
    places = brackets[outside]
    steps = np.where(np.isin(data[places], _OPEN), 1, -1)
    inside = (len(quotes) + started) % 2 == 1
    escaped = bool(odd(np.array([len(data)]))[0])
    return places, steps, (ESCAPED if escaped else INSIDE) if inside else OUTSIDE


_SCANNED = "path string, first bigint, past bigint, state int, ends int, delta bigint, depths array<bigint>, opens array<bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, first, past in zip(*(batch[c].to_pylist() for c in ("path", "first", "past"))):
            with open_file(path) as file:
                data = np.frombuffer(file.read_at(past - first, first), np.uint8)
            for state in (OUTSIDE, INSIDE, ESCAPED):
                places, steps, ends = structure(data, state)
                before = np.cumsum(steps) - steps
                depths, opens = np.unique(before[np.isin(data[places], _BRACE)], return_counts=True)
                rows.append((path, first, past, state, ends, int(steps.sum()), depths.tolist(), opens.tolist()))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _SCANNED.split(", ")]
        )


_STARTS = "path string, first bigint, past bigint, state int, depth bigint, place bigint, error string"


def _compose(rows: pa.Table) -> pa.Table:
    """The true start of each range of a file, and what is wrong with the file as a whole."""
    by_start = {(r["first"], r["state"]): r for r in rows.to_pylist()}
    state, depth, place, out, error = OUTSIDE, 0, 0, [], None
    for first in sorted({f for f, _ in by_start}):
        r = by_start[first, state]
        opens = dict(zip(r["depths"], r["opens"]))
        out.append((r["path"], first, r["past"], state, depth, place))
        if opens.get(-depth):
            error = "it is no array"
        state, place, depth = r["ends"], place + opens.get(1 - depth, 0), depth + r["delta"]
    if state != OUTSIDE or depth:
        error = "it ends too early"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array([(*r, error)[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _STARTS.split(", ")])


def _objects(path: str, first: int, past: int, state: int, depth: int) -> Iterator[str]:
    """The objects of the array that begin in a range; what stands between them must be one comma."""
    with open_file(path) as file:
        size, more = file.size(), min(_MORE, max(_LEAST_MORE, past - first >> 3))
        data = file.read_at(min(past - first + more, size - first), first)
        while True:
            array = np.frombuffer(data, np.uint8)
            places, steps, _ = structure(array, state)
            after = depth + np.cumsum(steps)
            begins = places[(after == 2) & (steps == 1) & np.isin(array[places], _BRACE)]
            ends = places[(after == 1) & (steps == -1)]
            own = begins[begins < past - first]
            last = own[-1] if len(own) else -1
            closed = places[(places > last) & (after <= 1)] if len(own) else places[:0]
            # the last own object is followed by its end, a gap, and then a bracket or the end of the file
            if not len(own) or len(closed) and (places > closed[0]).any() or first + len(data) >= size:
                break
            data += file.read_at(min(more, size - first - len(data)), first + len(data))
            more *= 2
    for i, begin in enumerate(own):
        end = ends[np.searchsorted(ends, begin)]
        follows = begins[i + 1] if i + 1 < len(begins) else None
        gap = data[end + 1 : follows].split(b"]")[0].strip() if follows is None else data[end + 1 : follows].strip()
        if gap != (b"" if follows is None else b","):
            raise ValueError("stories are not parted by commas")
        yield data[begin : end + 1].decode("utf-8")
    if first == 0:
        head = data[: begins[0] if len(begins) else len(data)].removeprefix(b"\xef\xbb\xbf").strip()
        if head.rstrip(b"]").strip() != b"[":
            raise ValueError("it is no array of stories")


_CUT = "path string, place bigint, text string, error string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("path", "first", "past", "state", "depth", "place", "error")
    for batch in batches:
        for path, first, past, state, depth, place, error in zip(*(batch[c].to_pylist() for c in names)):
            texts: list[str] = []
            try:
                if error is None:
                    texts = list(_objects(path, first, past, state, depth))
            except (ValueError, IndexError) as broken:  # bytes that are no text or no array
                error = str(broken)
            count = len(texts) + (error is not None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * count, pa.string()), pa.array([*range(place, place + len(texts)), *([None] * (count - len(texts)))], pa.int64()),
                    pa.array([*texts, *([None] * (count - len(texts)))], pa.string()),
                    pa.array([None] * len(texts) + [error] * (count - len(texts)), pa.string()),
                ],
                names=["path", "place", "text", "error"],
            )


def array_elements(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, place, text, error)``: the objects of the JSON arrays in ``files`` (``path, length``).

    ``place`` counts the objects of a file from 0. A task holds ``split_bytes`` and the object at their end at a time,
    and reads about ``TASK_BYTES`` in all, or one range if that is longer. A file
    that is no array of objects has a row with ``error``, and maybe rows of its readable part.
    """
    ranges = files.filter(F.col("length") > 0).select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("first")
    ).select("path", "first", F.least(F.col("first") + split_bytes, "length").alias("past"))
    # short ranges share a task: the bytes of the files decide how many tasks there are, not the number of ranges
    size = ranges.agg(F.count(F.lit(1)).alias("ranges"), F.coalesce(F.sum(F.col("past") - F.col("first")), F.lit(0)).alias("bytes")).first()
    least = 4 * files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size["ranges"], max(least, -(-size["bytes"] // TASK_BYTES)), 50_000))
    scanned = ranges.repartition(tasks).mapInArrow(_scan, _SCANNED)
    starts = scanned.groupBy("path").applyInArrow(_compose, _STARTS)
    return starts.repartition(tasks).mapInArrow(_cut, _CUT)
