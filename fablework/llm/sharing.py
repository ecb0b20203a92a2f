"""Which hashed features of a document also occur in a document with other content.

Most features of a corpus occur once, so a row for each of them is too much to shuffle.
Here a block of documents sends, to each fragment of the order of hashes, one compressed
row with the sorted hashes it has there; a fragment sends back only those that another
document has too. A feature that documents of a block share travels once for the block,
so one that a third of all documents have costs its fragment a few bytes a block.
Documents with equal content (by a 128-bit digest) count as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffles_removed, text_slices, words_of

#: Bits of a feature's hash. A clash makes a feature look shared, which later exact steps undo.
BITS = 48
NO_ID = -(2**63)
_ROWS = "fragment int, block string, header boolean, payload binary"


@dataclass
class Features:
    """Features of the documents of a block, in ascending order of documents.

    ``extra`` holds integer arrays that go along with each feature; ``size`` is a number for
    each document and ``digest`` 16 bytes that equal content, and only that, has in common.
    """

    value: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    digest: list[bytes]
    extra: list[np.ndarray] = field(default_factory=list)


@dataclass
class Block:
    """What is known of a block's documents when all fragments have answered.

    ``value``, ``doc`` and ``extra`` hold the shared features only, and only of documents with
    ``holder`` (one of each content in the block, the one with the smallest id).
    """

    ids: np.ndarray
    size: np.ndarray
    digest: np.ndarray
    holder: np.ndarray
    value: np.ndarray
    doc: np.ndarray
    extra: list[np.ndarray]

    def id_array(self, of: np.ndarray | slice = slice(None)) -> pa.Array:
        ids = self.ids[of]
        return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, the bytes of equal weight next to each other."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str}{len(a)}".encode()
        parts += [bytes([len(head)]), head, a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return zstd.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstd.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        head = data[at + 1 : at + 1 + data[at]].decode()
        at += 1 + data[at]
        kind, n = np.dtype(head[:3]), int(head[3:])
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in a sorted array, and the run of each place."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case."""
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes, ``BITS`` wide, of each run of ``words`` words; none when there are fewer words."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


def fragment_count(docs: DataFrame, text_col: str, per_word: float, target: int = 2_500_000) -> int:
    """Fragments of about ``target`` features, from the bytes of all texts (about six a word)."""
    with shuffles_removed(docs.sparkSession):
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(min(60_000, max(16, -(-total * per_word // (6 * target)))))


def shared_features(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    features: Callable[[list[str | None]], Features],
    finish: Callable[[Block], pa.RecordBatch],
    schema: str,
    fragments: int,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``finish`` of every block of documents; ``docs`` should be a table or a stored frame.

    Two shuffles, both of compressed rows: features to fragments, shared ones back to blocks.
    Blocks are named by task and number, which a repeated scan of the same files repeats.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, past in text_slices(batch["text"], block_bytes):
                part = batch.slice(first, past - first)
                ids = np.asarray(part["doc_id"].fill_null(NO_ID), dtype=np.int64)
                name = f"{task}-{number}"
                number += 1
                rows = _sent(ids, features(part["text"].to_pylist()), fragments, name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows)),
                     pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())],
                    names=["fragment", "block", "header", "payload"],
                )

    def finished(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([finish(_received(rows))])

    sent = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(blocks, _ROWS)
    answered = sent.groupBy("fragment").applyInArrow(_answers, "block string, header boolean, payload binary")
    return answered.groupBy("block").applyInArrow(finished, schema)


def _sent(ids: np.ndarray, f: Features, fragments: int, name: str) -> list[tuple[int, bool, bytes]]:
    """Rows ``(fragment, header, payload)`` of one block."""
    digest = np.array(f.digest, dtype="S16") if f.digest else np.empty(0, "S16")
    raw = np.frombuffer(b"".join(f.digest), np.uint64).reshape(-1, 2)
    # a null id comes last: its copies with an id keep their features
    order = np.lexsort((np.where(ids == NO_ID, np.iinfo(np.int64).max, ids), raw[:, 1], raw[:, 0]))
    holder = np.zeros(len(ids), bool)
    if len(ids):
        ordered = raw[order]
        holder[order[np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))]] = True
    kept = holder[f.doc]
    value, doc, extra = f.value[kept], f.doc[kept], [e[kept] for e in f.extra]
    order = np.argsort(value, kind="stable")
    value, doc, extra = value[order], doc[order], [e[order] for e in extra]
    starts, run = _runs(value)
    ends = np.append(starts[1:], len(value)) - 1
    local = (doc[starts] != doc[ends])[run] if len(value) else np.empty(0, bool)
    header = pack(
        ids, f.size.astype(np.int64), raw[:, 0], raw[:, 1], holder.astype(np.uint8),
        value[local], doc[local].astype(np.uint32), *(e[local].astype(np.int32) for e in extra),
    )
    del digest
    rows = [(zlib.crc32(name.encode()) % fragments, True, header)]
    many = value[starts[local[starts]]] if len(value) else value
    alone = ~local
    value, doc, extra = value[alone], doc[alone], [e[alone] for e in extra]
    cuts = np.array([-(-i * (1 << BITS) // fragments) for i in range(fragments + 1)], np.uint64)
    at, at_many = np.searchsorted(value, cuts), np.searchsorted(many, cuts)
    for i in range(fragments):
        s, m = slice(at[i], at[i + 1]), many[at_many[i] : at_many[i + 1]]
        if at[i + 1] > at[i] or len(m):
            docs, place = np.unique(doc[s], return_inverse=True)
            rows.append((i, False, pack(
                np.diff(value[s], prepend=np.uint64(0)), place.astype(np.uint32), docs.astype(np.uint32),
                raw[docs, 0], np.diff(m, prepend=np.uint64(0)), *(e[s].astype(np.int32) for e in extra),
            )))
    return rows


def _answers(rows: pa.Table) -> pa.Table:
    """The shared features of one fragment, a row for each block that has some; headers pass."""
    blocks = rows["block"].to_pylist()
    payloads = rows["payload"].to_pylist()
    headers = rows["header"].to_pylist()
    out: list[tuple[str, bool, bytes]] = [(b, True, p) for b, p, h in zip(blocks, payloads, headers) if h]
    names, value, doc, digest, origin, many, extra = [], [], [], [], [], [], []
    for b, p, h in zip(blocks, payloads, headers):
        if h:
            continue
        v, place, docs, digests, m, *more = unpack(p)
        value.append(np.cumsum(v))
        doc.append(docs[place])
        digest.append(digests[place])
        origin.append(np.full(len(v), len(names), np.uint32))
        many.append(np.cumsum(m))
        extra.append(more)
        names.append(b)
    del payloads
    if names:
        v = np.concatenate(value)
        order = np.argsort(v, kind="stable")
        v = v[order]
        new = np.append(True, v[1:] != v[:-1])[: len(v)]
        if len(v):
            starts = np.flatnonzero(new)
            g = np.concatenate(digest)[order]
            several = np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)
            del digest, g
            known = np.unique(np.concatenate(many))  # shared inside some block
            several |= np.isin(v[starts], known)
            picked = several[np.cumsum(new, dtype=np.uint32) - 1]
            places = order[picked]
            by_block = np.argsort(places)  # blocks came one after the other
            v, places = v[picked][by_block], places[by_block]
            del order, new, picked, by_block
            d, o = (np.concatenate(x)[places] for x in (doc, origin))
            more = [np.concatenate(x)[places] for x in zip(*extra)]
            del value, doc, origin, extra
            cuts = np.searchsorted(o, np.arange(len(names) + 1))
            for i, name in enumerate(names):
                s = slice(cuts[i], cuts[i + 1])
                if cuts[i + 1] > cuts[i]:
                    out.append((name, False, pack(v[s], d[s], *(e[s] for e in more))))
    return pa.table({
        "block": pa.array([r[0] for r in out], pa.string()), "header": pa.array([r[1] for r in out], pa.bool_()),
        "payload": pa.array([r[2] for r in out], pa.binary()),
    })


def _received(rows: pa.Table) -> Block:
    """The header of a block together with the answers of all fragments."""
    value, doc, extra, head = [], [], [], None
    for header, payload in zip(rows["header"].to_pylist(), rows["payload"].to_pylist()):
        arrays = unpack(payload)
        if header:
            head, arrays = arrays[:5], arrays[5:]
        value.append(arrays[0])
        doc.append(arrays[1])
        extra.append(arrays[2:])
    ids, size, a, b, holder = head
    v, d = np.concatenate(value), np.concatenate(doc).astype(np.int64)
    more = [np.concatenate(x) for x in zip(*extra)]
    order = np.lexsort((v, d))
    return Block(ids, size, np.stack([a, b], axis=1), holder.astype(bool), v[order], d[order], [e[order] for e in more])
