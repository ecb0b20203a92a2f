"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablework.operators.ordinals import ordinal

from .common import stored, text_slices
from .wordcodes import flat


def public_tokenizer(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Sentence marks at the end of a word that ends in an ASCII letter or digit.
END_MARKS = re.compile(rb"(?<=[a-z0-9])([.,!?;:]+)(?![^\x20\x09-\x0D])")

#: Tables by byte: A-Z in lower case, blanks, marks and letters or digits as in ``END_MARKS``.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _MARK, _ALNUM = (np.isin(np.arange(256), list(chosen)) for chosen in (b" \t\n\x0b\x0c\r", b".,!?;:", b"abcdefghijklmnopqrstuvwxyz0123456789"))


class WordEncoder:
    """Token ids of documents from a cache of their words.

    Only for tokenizers whose pieces never reach over ASCII white space: then the ids of a
    text are those of its words, one after the other. Words are encoded once and kept in
    one flat array; a full cache (``most`` words) starts anew.
    """

    def __init__(self, path: str, end_id: int, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.most = end_id, most
        self.mark = "\x01"
        alone = self.tokenizer.encode(f"a {self.mark} a", add_special_tokens=False).ids
        self.mark_id = alone[1] if len(alone) == 3 else None
        same = lambda a, b: self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids
        self.simple = same("Some MiXeD, words; of it!?", "some mixed , words ; of it !?")
        self._clear()

    def _words(self, text: str) -> list[bytes]:
        """The words of a text; where it is the same to the tokenizer, in lower case and without marks at the end."""
        data = text.encode("utf-8")
        if self.simple and b"<|" not in data:  # special tokens are found before letters are lowered
            data = END_MARKS.sub(rb" \1", data.lower())
        return data.split()

    def _clear(self) -> None:
        self.slots = {b"": 0}  # no word is empty, so this is the end of a document
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.flat[0], self.lengths[0], self.used = self.end_id, 1, 1

    def _encoded(self, words: list[bytes], batch: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and the number of ids of each.

        One call for many words is far cheaper than a call for each; a mark that is a piece
        of its own stands between them. Words that hold the mark are encoded by themselves.
        """
        mark = self.mark.encode()
        if self.mark_id is None or any(mark in w for w in words):
            parts = self.tokenizer.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)
            return np.array([i for e in parts for i in e.ids], np.uint32), np.array([len(e.ids) for e in parts], np.int64)
        texts = [
            (b" " + mark + b" ").join([*words[i : i + batch], b""]).decode("utf-8") for i in range(0, len(words), batch)
        ]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in encoded])
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(words):
            raise ValueError("the tokenizer's pieces reach over white space")
        return ids[ids != self.mark_id], np.diff(marks, prepend=-1) - 1

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        ids, lengths = self._encoded(words)
        first, total = len(self.slots), self.used + len(ids)
        self.starts, self.lengths = (_room(a, first + len(words)) for a in (self.starts, self.lengths))
        self.flat = _room(self.flat, total)
        self.lengths[first : first + len(words)] = lengths
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : total] = ids
        self.used = total
        self.slots.update(zip(words, range(first, first + len(words))))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """``(codes, distinct words, rows)`` of all words of a column, as ``_words`` cuts them; nothing of special texts."""
        data, offsets = flat(texts)
        if self.simple:
            data = _LOWER[data]
        inside = ~_BLANK[data]
        if self.simple and len(data):  # texts with special tokens are cut by themselves
            for row in self._special(texts):
                inside[offsets[row] : offsets[row + 1]] = False
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before, after = np.append(False, inside[:-1])[: len(data)], np.append(inside[1:], False)[: len(data)]
        before[edges], after[edges - 1] = False, False
        begins, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if self.simple and len(begins):  # marks at the end of a word behind a letter or digit are a word of their own
            word_end = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[ends - 1]
            marked = (word_end >= begins) & (word_end < ends - 1)
            marked[marked] = _ALNUM[data[word_end[marked]]]
            order = np.argsort(np.append(begins, word_end[marked] + 1), kind="stable")
            begins = np.append(begins, word_end[marked] + 1)[order]
            ends = np.append(np.where(marked, word_end + 1, ends), ends[marked])[order]
        cuts = np.append(0, np.cumsum(ends - begins))
        words = pa.Array.from_buffers(
            pa.large_binary(), len(begins), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data[inside].tobytes())]
        ).dictionary_encode()
        rows = np.searchsorted(offsets, begins, side="right") - 1
        return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist(), rows

    def _special(self, texts: pa.Array) -> list[int]:
        return np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)).tolist() if self.simple else []

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the position where each document ends; every document ends with the end id."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if len(self.slots) > self.most:
            self._clear()
        codes, distinct, rows = self._cut(texts)
        special = {row: self._words(texts[row].as_py()) for row in self._special(texts)}
        wanted = dict.fromkeys(distinct)
        for words in special.values():
            wanted.update(dict.fromkeys(words))
        self._learn([w for w in wanted if w not in self.slots])
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[codes]
        if special:  # their words go between those of the other rows
            slots = np.concatenate([slots, *(np.array([self.slots[w] for w in words], np.int64) for words in special.values())])
            rows = np.concatenate([rows, *(np.full(len(words), row) for row, words in special.items())])
            order = np.argsort(rows, kind="stable")
            slots, rows = slots[order], rows[order]
        at = np.zeros(len(slots) + len(texts), np.int64)  # 0, the end, behind each document
        at[np.arange(len(slots)) + rows] = slots
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)) + 1)
        lengths = self.lengths[at]
        past = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - past + lengths, lengths) + np.arange(past[-1] if len(past) else 0)]
        return ids, past[ends - 1]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


@functools.cache
def _encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each piece of each document.

    A document is its ids, then ``end_id``; it is cut every ``capacity`` ids. A null text is
    an empty one and gives a single piece that holds the end.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def pieces(batches):
        encoder = _encoder(tokenizer, end_id)
        for batch in batches:
            for first, past in text_slices(batch["text"]):
                ids, ends = encoder.encode(batch["text"].slice(first, past - first))
                begins = np.concatenate([[0], ends[:-1]])
                count = -((begins - ends) // capacity)
                doc = np.repeat(np.arange(len(ends)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                lo = begins[doc] + piece * capacity
                hi = np.minimum(lo + capacity, ends[doc])
                raw = memoryview(ids.astype("<u4")).cast("B")
                columns = [
                    batch["doc_id"].take(pa.array(doc + first)), pa.array(piece, pa.int32()),
                    pa.array(piece * capacity, pa.int64()), pa.array(hi - lo, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo, hi)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(lo, ends[-1]), pa.int32()), pa.array(ids.astype(np.int32))
                    ))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = np.zeros(2 * self.leaves, dtype=bool)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, remaining: int, value: bool) -> None:
        node = remaining + self.leaves
        self.filled[node] = value
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def add(self, remaining: int, first: int, count: int) -> None:
        """``count`` bins from number ``first`` on have ``remaining`` room each."""
        if remaining and count:
            if not self.ranges[remaining]:
                self._mark(remaining, True)
            self.ranges[remaining].append((first, count))

    def take(self, remaining: int) -> tuple[int, int]:
        out = self.ranges[remaining].pop()
        if not self.ranges[remaining]:
            self._mark(remaining, False)
        return out

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is ``length`` or more."""
        node = length + self.leaves
        while not self.filled[node]:
            while node % 2:  # right child: what is above it has been seen
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing for ``counts[length]`` pieces of each length, in runs of equal pieces.

    A row ``(length, rank, pieces, bin, per_bin, offset)`` says: of the pieces of this length,
    number ``rank + i`` is in bin ``bin + i // per_bin`` at ``offset + i % per_bin * length``.
    Equal pieces that come one after the other fill the tightest bin, then the next one of
    the same room, so the runs give what packing one by one gives, and their number
    depends on the capacity, not on the number of pieces.
    """
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = int(counts[length]), 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins.take(room)
            each = room // length
            used = min(count, -(-left // each))
            bins.add(room, first + used, count - used)
            placed = min(left, used * each)
            runs.append((length, rank, placed, first, each, capacity - room))
            whole, rest = divmod(placed, each)
            bins.add(room - each * length, first, whole)
            bins.add(room - rest * length, first + whole, 1 if rest else 0)
            left, rank = left - placed, rank + placed
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut. Packing is best-fit decreasing over all
    pieces: it depends on their lengths alone, so the number of pieces of each length (at most
    ``capacity`` rows) is all that the placement reads. Pieces of a length are numbered
    without gathering them in one task, and the number tells sequence and offset.

    A null text is an empty one. Null ids and repeated rows are documents like any other;
    equal ones may be in any order. An empty table gives no rows. Other columns are not read.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).
    """
    pieces = tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    pieces = stored(pieces.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32")), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_runs(counts, capacity)
    slice_ = F.shiftright(F.col("key"), 48)
    ranked = ordinal(pieces, ["length"], ["key", "doc_id", "piece"], [slice_], "rank")
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    starts = (runs[:, 0] << 44) + runs[:, 1]
    kept = [c for c in pieces.columns if c != "key"]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id bigint, offset bigint"

    def assign(batches):
        for batch in batches:
            length, rank = (np.asarray(batch[c], dtype=np.int64) for c in ("length", "rank"))
            run = runs[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            i = rank - run[:, 1]
            columns = [batch[c] for c in kept]
            columns += [pa.array(run[:, 3] + i // run[:, 4]), pa.array(run[:, 5] + i % run[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(assign, schema)
