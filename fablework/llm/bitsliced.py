"""Ranked lexical search over bit-sliced Bloom signatures.

A block of documents is a matrix of bits: a row ("slice") for each place of a signature, a column for
each document. A term is looked up for all documents of a block by joining its few slices with "and".
The bits never miss a term, so the weights of the terms found bound a document's score from above;
documents whose bound reaches the score that the k-th best certainly has are scored exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices
from .wordcodes import byte_kinds, coded_words, mixed, word_hashes

#: Terms are runs of ASCII letters, digits and all bytes from 0x80 on.
KINDS = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()))

#: A term is entered once for each of these that its number of occurrences reaches.
LEVELS = np.sort([1] + [2 << i for i in range(39)] + [3 << i for i in range(38)])

HASHES = 3  # slices of an entry
ROOM = 12  # slices for each entry that the longest document of a class may have
LEAST_CLASS = 5  # documents of up to 2**5 entries share the shortest signatures
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 512

INDEX_SCHEMA = "slices bigint, documents int, bits binary, ids array<bigint>, keys array<bigint>, sizes array<bigint>"


@dataclass(frozen=True)
class Searches:
    """Query texts as lists of places in a table of terms, with weights and what a length costs."""

    terms: pa.Array  # bytes
    weights: np.ndarray
    lists: tuple[np.ndarray, ...]  # places of each item's terms
    documents: int = 0
    total: int = 0

    def cost(self, sizes: np.ndarray) -> np.ndarray:
        """``m`` of documents of the given numbers of terms."""
        return 10 + (90 * sizes * self.documents) // max(self.total, 1)

    def sums(self, parts: np.ndarray) -> np.ndarray:
        """``[item, document]`` from ``[term, document]``."""
        return np.stack([self.weights[t] @ parts[t] if len(t) else np.zeros(parts.shape[1], np.int64) for t in self.lists])


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ------------------------------------------------------------------ index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signatures of all documents that have a term, in blocks of about equal length.

    ``keys`` are hashes of the texts, by which documents are found again; ``sizes`` their numbers of terms.
    Documents are classed by powers of two of their entries; the signature of a class has ``ROOM``
    slices for each possible entry, so that about one look-up in a hundred is wrong for the longest
    documents of a class and fewer for the others.
    """
    rows = _keyed(docs, id_col, text_col)
    return rows.mapInArrow(_index_batches, INDEX_SCHEMA)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).filter(F.length("text") > 0)
    return named.withColumn("key", F.xxhash64("text"))


def _positions(hashes: np.ndarray, levels: np.ndarray, slices: int) -> np.ndarray:
    """``[hash function, entry]``: the slices of each entry."""
    entry = mixed(hashes + (levels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    low, high = entry & np.uint64(0xFFFFFFFF), (entry >> np.uint64(32)) | np.uint64(1)
    return np.stack([((low + np.uint64(i) * high) % np.uint64(slices)).astype(np.int64) for i in range(HASHES)])


class _Class:
    """Documents of one class that wait until they fill a block."""

    def __init__(self, number: int):
        self.slices = ROOM << number
        self.room = max(8, min(BLOCK_DOCS, (BLOCK_BYTES * 8 // self.slices) & ~7))
        self.parts: list[tuple] = []
        self.count = 0

    def add(self, ids, keys, sizes, entries, hashes, levels):
        """Documents with the number of ``entries`` of each; hashes and levels in their order."""
        self.parts.append((ids, keys, sizes, entries, hashes, levels))
        self.count += len(entries)
        if self.count >= self.room:
            yield from self.blocks(False)

    def blocks(self, rest: bool):
        if not self.count:
            return
        ids = pa.concat_arrays([p[0] for p in self.parts])
        keys, sizes, entries, hashes, levels = (np.concatenate([p[i] for p in self.parts]) for i in range(1, 6))
        ends = np.append(0, np.cumsum(entries))
        first = 0
        while first < self.count and (rest or self.count - first >= self.room):
            past = min(first + self.room, self.count)
            inner = slice(ends[first], ends[past])
            yield self._block(ids[first:past], keys[first:past], sizes[first:past], entries[first:past], hashes[inner], levels[inner])
            first = past
        inner = slice(ends[first], None)
        self.parts = [(ids[first:], keys[first:], sizes[first:], entries[first:], hashes[inner], levels[inner])]
        self.count -= first

    def _block(self, ids, keys, sizes, entries, hashes, levels):
        width = -(-len(entries) // 8) * 8
        bits = np.zeros((self.slices, width), bool)
        column = np.repeat(np.arange(len(entries)), entries)
        for place in _positions(hashes, levels, self.slices):
            bits[place, column] = True
        packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.slices]), pa.array([len(entries)], pa.int32()), pa.array([packed], pa.binary()), one(ids), one(keys), one(sizes)],
            names=["slices", "documents", "bits", "ids", "keys", "sizes"],
        )


def _term_counts(words):
    """``row, code, occurrences`` of the words of a slice."""
    seen, tf = np.unique(words.rows * max(len(words.distinct), 1) + words.codes, return_counts=True)
    row, code = np.divmod(seen, max(len(words.distinct), 1))
    return row, code, tf


def _slices(batches):
    for batch in batches:
        for first, past in text_slices(batch["text"]):
            part = batch.slice(first, past - first)
            words = coded_words(part["text"], KINDS)
            if len(words):
                yield part, words


def _index_batches(batches):
    classes: dict[int, _Class] = {}
    for part, words in _slices(batches):
        row, code, tf = _term_counts(words)
        hashes = word_hashes(words.distinct)[code]
        reached = np.searchsorted(LEVELS, tf, side="right")
        level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
        entry_row, entry_hash = np.repeat(row, reached), np.repeat(hashes, reached)
        entries = np.bincount(entry_row, minlength=part.num_rows)
        sizes = np.bincount(words.rows, minlength=part.num_rows)
        number = np.maximum(np.ceil(np.log2(np.maximum(entries, 1))).astype(int), LEAST_CLASS)
        keys = part["key"].to_numpy(zero_copy_only=False)
        for c in np.unique(number[entries > 0]):
            mine = (number == c) & (entries > 0)
            held = mine[entry_row]
            waiting = classes.setdefault(int(c), _Class(int(c)))
            yield from waiting.add(
                part["doc_id"].filter(pa.array(mine)), keys[mine], sizes[mine], entries[mine], entry_hash[held], level[held]
            )
    for waiting in classes.values():
        yield from waiting.blocks(True)


# ------------------------------------------------------------------ bounds


def _found_bits(bits: np.ndarray, hashes: np.ndarray, level: int, documents: int) -> np.ndarray:
    """``[term, document]``: whether the signature may hold the entry."""
    places = _positions(hashes, np.full(len(hashes), level), len(bits))
    joined = bits[places[0]]
    for more in places[1:]:
        joined = joined & bits[more]
    return np.unpackbits(joined, axis=1, count=documents, bitorder="little").view(bool)


def upper_bounds(bits: np.ndarray, documents: int, sizes: np.ndarray, searches: Searches, hashes: np.ndarray) -> np.ndarray:
    """``[item, document]``: no document of the block scores more."""
    most = np.zeros((len(hashes), documents), np.int64)
    live = np.arange(len(hashes))
    held = np.ones((len(hashes), documents), bool)
    for level in range(len(LEVELS) - 1):
        found = _found_bits(bits, hashes[live], level, documents) & held
        any_left = found.any(axis=1)
        live, held = live[any_left], found[any_left]
        if not len(live):
            break
        most[live] = np.where(held, LEVELS[level + 1] - 1, most[live])
    term, doc = np.nonzero(most)
    parts = np.zeros((len(hashes), documents), np.int64)
    parts[term, doc] = _share(np.minimum(most[term, doc], sizes[doc]), searches.cost(sizes)[doc])
    return searches.sums(parts)


def _blocks(shared, batches):
    """``(row, bounds)`` of each block of the index."""
    searches = shared.value
    hashes = word_hashes(searches.terms)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch[name][i] for name in ("ids", "keys")}
            documents, slices = batch["documents"][i].as_py(), batch["slices"][i].as_py()
            bits = np.frombuffer(batch["bits"][i].as_buffer(), np.uint8).reshape(slices, -1)
            sizes = batch["sizes"][i].values.to_numpy()
            yield row, upper_bounds(bits, documents, sizes, searches, hashes)


_SEEDS = "item int, bound bigint, key bigint"


def _best_bounds(shared, count, batches):
    """The ``count`` highest bounds of each item in the blocks of a task."""
    best: np.ndarray | None = None
    keys = np.zeros(0, np.int64)
    for row, bounds in _blocks(shared, batches):
        more = row["keys"].values.to_numpy()
        best = bounds if best is None else np.concatenate([best, bounds], axis=1)
        keys = np.broadcast_to(more, bounds.shape) if not keys.size else np.concatenate([keys, np.broadcast_to(more, bounds.shape)], axis=1)
        if best.shape[1] > count:
            top = np.argpartition(-best, count, axis=1)[:, :count]
            best, keys = np.take_along_axis(best, top, 1), np.take_along_axis(keys, top, 1)
    if best is not None:
        item, place = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(best[item, place]), pa.array(keys[item, place])], names=["item", "bound", "key"]
        )


def _reaching(shared, least, batches):
    """Keys of the documents whose bound reaches what some item asks for."""
    for row, bounds in _blocks(shared, batches):
        wanted = (bounds >= least.value[:, None]).any(axis=0)
        yield pa.RecordBatch.from_arrays([row["keys"].values.filter(pa.array(wanted))], names=["key"])


# ------------------------------------------------------------------ exact scores


_SCORES = "item int, doc_id bigint, score bigint"


def _exact(shared, least, batches):
    """Exact scores of all items for each text, where they reach ``least``."""
    searches = shared.value
    for part, words in _slices(batches):
        row, code, tf = _term_counts(words)
        sizes = np.bincount(words.rows, minlength=part.num_rows)
        place = pc.fill_null(pc.index_in(words.distinct, value_set=searches.terms), -1).to_numpy(zero_copy_only=False)[code]
        row, tf, place = row[place >= 0], tf[place >= 0], place[place >= 0]
        for first in range(0, part.num_rows, BLOCK_DOCS):
            width = min(BLOCK_DOCS, part.num_rows - first)
            mine = (row >= first) & (row < first + width)
            parts = np.zeros((len(searches.terms), width), np.int64)
            parts[place[mine], row[mine] - first] = _share(tf[mine], searches.cost(sizes)[row[mine]])
            scores = searches.sums(parts)
            item, at = np.nonzero(scores >= least.value[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), part["doc_id"].take(pa.array(at + first)), pa.array(scores[item, at])],
                names=["item", "doc_id", "score"],
            )


def _texts_of(texts: DataFrame, keys: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows of ``texts`` with one of ``keys`` (distinct, stored); few keys go to the texts, many are joined."""
    small = keys.count() <= broadcast_rows
    return texts.join(F.broadcast(keys) if small else keys, "key", "left_semi")


# ------------------------------------------------------------------ search


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", index: DataFrame | None = None, seeds: int = 4, query_bytes: int = 131_072, broadcast_rows: int = 262_144,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, all exact.

    Terms are maximal runs of ASCII letters, digits and characters from U+0080 on, with A-Z in lower case.
    ``index`` is the stored result of ``build_index`` (built here if not given). Items are answered in
    blocks of about ``query_bytes``. For each block the index gives the ``seeds * k`` documents with the
    highest bounds; their exact scores give a score that the k-th best certainly reaches, and every
    document whose bound reaches that is read and scored. At most ``broadcast_rows`` keys of such
    documents are broadcast; more are joined.

    Scores that tie are ranked by ``doc_id``, null last. Null and empty texts, and items without terms,
    give no rows. Rows that repeat are ranked each; items that repeat are answered once, an id with
    two texts for each of them. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = _keyed(docs, id_col, text_col)
    if index is None:
        index = stored(build_index(docs, id_col, text_col), "search-index")
    size = index.select(F.size("sizes").cast("bigint").alias("n"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("all"))
    corpus = size.agg(F.sum("n").alias("n"), F.sum("all").alias("all")).first()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0).distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text")).cast("bigint")).first()[0] or 0) // query_bytes))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    found: list[DataFrame] = []
    for number in range(blocks if corpus["n"] else 0):
        rows = dealt.filter(F.col("block") == number).select("item_id", "text").toArrow()  # about ``query_bytes``
        if rows.num_rows:
            scores = _answer(texts, index, rows, corpus["n"], corpus["all"], k, seeds * k, broadcast_rows)
            names = spark.createDataFrame(
                pa.table({"item": pa.array(np.arange(rows.num_rows), pa.int32()), "item_id": rows["item_id"]})
            )
            found.append(stored(scores.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-found"))
    empty = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    out = spark.createDataFrame([], empty) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _parsed(rows: pa.Table) -> Searches:
    words = coded_words(rows["text"], KINDS)
    row, code, _ = _term_counts(words)
    ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
    lists = tuple(code[a:b] for a, b in zip(ends[:-1], ends[1:]))
    return Searches(words.distinct, np.zeros(len(words.distinct), np.int64), lists)


def _document_counts(shared, batches):
    """In how many documents of a slice each term of the queries stands."""
    for _, words in _slices(batches):
        _, code, _ = _term_counts(words)
        held = np.bincount(code, minlength=len(words.distinct))
        place = pc.index_in(words.distinct, value_set=shared.value)
        known = place.is_valid()
        yield pa.RecordBatch.from_arrays(
            [place.filter(known).cast(pa.int32()), pa.array(held, pa.int64()).filter(known)], names=["term", "df"]
        )


def _answer(texts, index, rows, documents, total, k, seeds, broadcast_rows) -> DataFrame:
    spark = texts.sparkSession
    plain = _parsed(rows)
    terms = spark.sparkContext.broadcast(plain.terms)
    counts = texts.mapInArrow(partial(_document_counts, terms), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(plain.terms), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)
    used = np.flatnonzero(weights > 0)  # a term without weight or documents adds nothing
    place = np.full(len(df), -1)
    place[used] = np.arange(len(used))
    lists = tuple(place[t][place[t] >= 0] for t in plain.lists)
    shared = spark.sparkContext.broadcast(Searches(plain.terms.take(pa.array(used)), weights[used], lists, documents, total))

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "key")
    best = index.mapInArrow(partial(_best_bounds, shared, seeds), _SEEDS).dropDuplicates()
    first = stored(
        best.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= seeds).select("key").distinct(), "search-seeds"
    )
    nothing = spark.sparkContext.broadcast(np.ones(len(lists), np.int64))
    tried = _texts_of(texts, first, broadcast_rows).mapInArrow(partial(_exact, shared, nothing), _SCORES)
    sure = (
        tried.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
        .filter(F.col("at") == k).select("item", "score").collect()  # a row for each item of the block
    )
    least = np.ones(len(lists), np.int64)
    for r in sure:
        least[r["item"]] = max(r["score"], 1)
    reached = spark.sparkContext.broadcast(least)

    wanted = stored(index.mapInArrow(partial(_reaching, shared, reached), "key bigint").distinct(), "search-candidates")
    scores = _texts_of(texts, wanted, broadcast_rows).mapInArrow(partial(_exact, shared, reached), _SCORES)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
