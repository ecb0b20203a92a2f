"""Words of Arrow text columns as numbers, and Rabin-Karp fingerprints of their sequences.

Everything here works on whole columns: a text is never a Python object of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of bytes: part of a word, between words, between pieces that no phrase crosses.
INSIDE, BETWEEN, BREAK = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))  # odd, so that they have inverses
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x452821E638D01377))


def byte_kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table with the kind of each byte; what is in neither list is part of a word."""
    kinds = np.full(256, INSIDE, np.uint8)
    kinds[list(between)] = BETWEEN
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    """All words of a slice of a text column, in order."""

    codes: np.ndarray  # place of the word in ``distinct``
    distinct: pa.Array  # each word once, A-Z in lower case, as bytes
    rows: np.ndarray  # row of each word
    pieces: np.ndarray  # equal for two words of a row with no break between them
    begins: np.ndarray  # first byte in the row's text
    ends: np.ndarray  # byte after the last one

    def __len__(self) -> int:
        return len(self.codes)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings or bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def coded_words(texts: pa.Array | pa.ChunkedArray, kinds: np.ndarray) -> Words:
    """The words of each text: maximal runs of bytes of the kind ``INSIDE``.

    Words are told apart by their bytes, not by a hash.
    """
    data, offsets = flat(texts)
    kind = kinds[data]
    inside = kind == INSIDE
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before = np.append(False, inside[:-1])
    before[edges] = False
    after = np.append(inside[1:], False)
    after[edges - 1] = False
    if not len(data):
        before, after = inside, inside
    begins = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, begins, side="right") - 1
    pieces = np.cumsum(kind == BREAK, dtype=np.int64)[begins] + rows
    cuts = np.append(0, np.cumsum(ends - begins))
    spelled = pa.Array.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(_LOWER[data[inside]].tobytes())]
    ).dictionary_encode()
    first = offsets[rows]
    return Words(
        spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64), spelled.dictionary, rows, pieces,
        begins - first, ends - first,
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(count - 1, 0), base, np.uint64)), dtype=np.uint64)[:count]


class Polynomial:
    """Prefix polynomial of a sequence: the fingerprint of any window costs one subtraction."""

    def __init__(self, values: np.ndarray, variant: int = 0):
        base = _BASES[variant]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64))
        self.back = _powers(inverse, len(values) + 1)
        self.salt = _SALTS[variant]

    def windows(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of ``values[begin:end]``; windows of different lengths differ, too."""
        plain = (self.sums[ends] - self.sums[begins]) * self.back[begins]
        return mixed(plain + (ends - begins).astype(np.uint64) * self.salt)


def word_hashes(distinct: pa.Array, variant: int = 0) -> np.ndarray:
    """Fingerprints of words from their bytes."""
    data, offsets = flat(distinct)
    return Polynomial(data.astype(np.uint64) + np.uint64(1), variant).windows(offsets[:-1], offsets[1:])
