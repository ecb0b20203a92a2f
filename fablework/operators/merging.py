"""Byte-pair merges learned one by one, with many of them proven in each job.

The distinct words lie in parts, each word a list of pieces. A job plays a plan of merges through
every part and brings back, for each step, by how much each pair's count changed: only pairs beside a
merged place change, so the index of pair counts is kept up by differences. The driver then walks the
plan as long as the planned pair is the best one of the state before it; the rest of the plan is
dropped, and the next job starts from there. The merges are those of learning one at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

# A piece is a number: a character its code point, a merged piece a number above all of them.
FIRST_MERGED = 0x110000
GONE = -1  # stands where a joined piece was
BITS = 21  # of a piece; a pair is ``left << BITS | right``

STATE_SCHEMA = "w string, c bigint, pieces array<int>"


def pair_code(left: int, right: int) -> int:
    return left << BITS | right


# ------------------------------------------------------------------ one part of the words


class Part:
    """Words of a part as one array of pieces, each linked to the ones beside it in its word.

    An index of the pairs' places, which grows with the pairs that merges make, keeps a merge's work in proportion to
    the places it has, whatever the size of the part. A joined piece leaves ``GONE`` at its place.
    """

    def __init__(self, pieces: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        self.pieces = pieces.astype(np.int64)
        self.word = np.repeat(np.arange(len(lengths)), lengths)
        self.counts = counts
        self.end = len(self.pieces)
        at = np.arange(self.end)
        same = self.word[1:] == self.word[:-1]
        self.after = np.where(np.append(same, False)[: self.end], at + 1, self.end)
        self.before = np.where(np.append(False, same)[: self.end], at - 1, -1)
        self.index: tuple[np.ndarray, np.ndarray] | None = None
        self.made: dict[int, list[np.ndarray]] = {}  # places of pairs that came after the index

    def _codes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``at`` where a pair begins, and the pairs; a word's last piece begins none."""
        at = at[(at >= 0) & (at < self.end)]
        at = at[(self.pieces[at] != GONE) & (self.after[at] < self.end)]
        return at, self.pieces[at] << BITS | self.pieces[self.after[at]]

    def _weights(self, at: np.ndarray) -> np.ndarray:
        return self.counts[self.word[at]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at, codes = self._codes(np.arange(self.end))
        return summed(codes, self._weights(at))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that are left, and the word of each."""
        left = self.pieces != GONE
        return self.pieces[left], self.word[left]

    def places(self, left: int, right: int) -> np.ndarray:
        """Where the pair stands, from the left and without overlap."""
        if self.index is None:
            at, codes = self._codes(np.arange(self.end))
            order = np.argsort(codes, kind="stable")
            self.index = codes[order], at[order]
        code = pair_code(left, right)
        first, past = np.searchsorted(self.index[0], [code, code + 1])
        at = np.unique(np.concatenate([self.index[1][first:past], *self.made.get(code, [])]))
        at = at[(self.pieces[at] == left) & (self.after[at] < self.end)]
        at = at[self.pieces[self.after[at]] == right]
        if left == right and len(at) > 1:  # of a run of equal pieces every second place counts
            first = np.append(True, self.after[at[:-1]] != at[1:])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        return at

    def merge(self, left: int, right: int, made: int, compare: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Join a pair everywhere; with ``compare`` return the pairs whose counts changed and by how much."""
        at = self.places(left, right)
        if not len(at):
            return None
        second = self.after[at]
        if compare:
            old, old_codes = self._codes(np.unique(np.concatenate([self.before[at], at, second])))
        beyond = self.after[second]
        self.pieces[at], self.pieces[second] = made, GONE
        self.after[at] = beyond
        linked = beyond < self.end
        self.before[beyond[linked]] = at[linked]
        new, codes = self._codes(np.unique(np.concatenate([self.before[at], at])))
        order = np.argsort(codes, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0)) if len(codes) else np.zeros(0, np.int64)
        for code, stretch in zip(codes[order][heads].tolist(), np.split(new[order], heads[1:])):
            self.made.setdefault(code, []).append(stretch)
        if not compare:
            return None
        return summed(np.concatenate([old_codes, codes]), np.concatenate([-self._weights(old), self._weights(new)]))

    def neighbours(self, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces beside a pair, as codes ``piece << 1 | side``, with weights: what merging it would make."""
        at = self.places(left, right)
        ahead, behind = self.before[at], self.after[self.after[at]]
        begun, follows = ahead >= 0, behind < self.end
        codes = np.concatenate([self.pieces[ahead[begun]] << 1, self.pieces[behind[follows]] << 1 | 1])
        return summed(codes, self._weights(np.concatenate([at[begun], at[follows]])))


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights added up by code, sums of 0 left out."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    sums = np.add.reduceat(weights, heads)
    return codes[heads][sums != 0], sums[sums != 0]


def _part(batches: Iterator[pa.RecordBatch], done: Sequence[tuple[int, int, int]]) -> Part:
    """The part that a task reads, with the merges ``done`` since it was written."""
    pieces, lengths, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        pieces.append(batch["pieces"].flatten().to_numpy())
        lengths.append(pc.list_value_length(batch["pieces"]).to_numpy(zero_copy_only=False))
        counts.append(batch["c"].to_numpy())
    part = Part(np.concatenate(pieces), np.concatenate(lengths), np.concatenate(counts))
    for left, right, made in done:
        part.merge(left, right, made, False)
    return part


def _rows(step: int, codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(codes), step), pa.int32()), pa.array(codes, pa.int64()), pa.array(sums, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["step", "code", "n"])


_CHANGES = "step int, code bigint, n bigint"


def _play(shared, batches):
    """Changes of each planned step, then the neighbours of the pairs that are likely to follow."""
    done, plan, likely = shared.value
    part = _part(batches, done)
    for step, merge in enumerate(plan):
        changed = part.merge(*merge, True)
        if changed is not None and len(changed[0]):
            yield _rows(step, *changed)
    for i, (left, right) in enumerate(likely):
        yield _rows(-1 - i, *part.neighbours(left, right))


def _count(shared, batches):
    yield _rows(0, *_part(batches, shared.value).pairs())


def _spelled(batches):
    for batch in batches:
        text = "".join(w for w in batch["w"].to_pylist())
        pieces = pa.array(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32))
        ends = np.append(0, np.cumsum(pc.utf8_length(batch["w"]).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays(
            [batch["w"], batch["c"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)], names=["w", "c", "pieces"]
        )


def _merged(shared, batches):
    """Words with their pieces after the merges."""
    for batch in batches:
        pieces, word = _part(iter([batch]), shared.value).rest()
        ends = np.searchsorted(word, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch["w"], batch["c"], lists], names=["w", "c", "pieces"])


# ------------------------------------------------------------------ the driver's view


@dataclass
class _Index:
    """Counts of the pairs that may be the best; any other pair has at most ``floor``."""

    spell: dict[int, str]
    counts: dict[int, int] = field(default_factory=dict)
    floor: int = 0
    raised: dict[int, int] = field(default_factory=dict)  # growth of pairs whose count is not known
    heap: list = field(default_factory=list)

    def text(self, piece: int) -> str:
        return self.spell.get(piece) or chr(piece)

    def key(self, code: int, count: int) -> tuple:
        return -count, self.text(code >> BITS), self.text(code & (1 << BITS) - 1), code

    def load(self, rows: list[tuple[int, int]], most: int) -> None:
        self.counts = dict(rows)
        self.floor = min(self.counts.values()) if len(rows) >= most else 0
        self.raised = {}
        self.heap = [self.key(code, n) for code, n in rows]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, int] | None:
        """The most frequent pair, ties by text; None where only a new count can tell."""
        while self.heap and self.counts.get(self.heap[0][-1], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        if not self.heap:
            return None
        code, n = self.heap[0][-1], -self.heap[0][0]
        unknown = self.floor + max(self.raised.values(), default=0) if self.floor else 0
        return (code, n) if n > unknown else None

    def change(self, codes, sums, oldest: int) -> None:
        """Add differences; a pair with a piece made since ``oldest`` starts from 0."""
        for code, n in zip(codes, sums):
            if code in self.counts:
                total = self.counts[code] + n
            elif not self.floor or code >> BITS >= oldest or code & (1 << BITS) - 1 >= oldest:
                total = n
            else:
                self.raised[code] = self.raised.get(code, 0) + max(n, 0)
                continue
            if total > self.floor:
                self.counts[code] = total
                heapq.heappush(self.heap, self.key(code, total))
            elif total <= 0:
                self.counts.pop(code, None)
            else:
                self.counts[code] = total

    def forecast(self, steps: int, near: dict[int, dict[int, int]], ids: dict[str, int]) -> tuple[list[tuple[int, int, int]], list[int]]:
        """The merges that will probably be next, as ``(left, right, made)``, and pairs that may follow.

        ``near`` has the neighbours of pairs that were likely before: what a merge takes from the
        pairs beside it and what new pairs it makes. It may be out of date or lack a pair; then the
        plan is cut short, nothing more.
        """
        ahead = heapq.nsmallest(4 * steps, (k for k in self.heap if self.counts.get(k[-1]) == -k[0]))
        guess = {k[-1]: -k[0] for k in ahead}
        least = -ahead[-1][0] if ahead else 0
        queue, plan, ids, spell = list(ahead), [], dict(ids), _Index(dict(self.spell))
        seen = set()
        while queue and len(plan) < steps:
            key = heapq.heappop(queue)
            code = key[-1]
            if guess.get(code) != -key[0] or code in seen:
                continue
            seen.add(code)
            left, right = code >> BITS, code & (1 << BITS) - 1
            text = spell.text(left) + spell.text(right)
            made = ids.setdefault(text, FIRST_MERGED + len(ids))
            spell.spell[made] = text
            plan.append((left, right, made))
            for side, n in near.get(code, {}).items():
                piece = side >> 1
                old, new = (
                    (pair_code(right, piece), pair_code(made, piece)) if side & 1 else (pair_code(piece, left), pair_code(piece, made))
                )
                if old in guess and old not in seen:
                    guess[old] -= n
                    heapq.heappush(queue, spell.key(old, guess[old]))
                if n >= least and new not in seen:
                    guess[new] = guess.get(new, 0) + n
                    heapq.heappush(queue, spell.key(new, guess[new]))
        likely = [k[-1] for k in ahead if k[-1] not in seen]
        return plan, likely[: 2 * steps]


def learn(
    counts: DataFrame, merges: int, steps: int = 64, most_steps: int = 512, most: int = 50_000, store_every: int = 1024, part_words: int = 20_000
) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """The first ``merges`` merges of the distinct words ``(w, c)`` and the words ``(w, c, pieces)`` after them.

    A merge is ``(left, right, count)``: the pair with the highest count, ties by text, at its turn.
    Learning ends early when no pair is left. A job plays ``steps`` merges, twice as many after a plan that
    held, up to ``most_steps``, and fewer after one that mostly didn't; the driver holds the
    ``most`` best pairs and what the merges made of them, and counts all pairs anew when a pair outside
    could be the best. Words are written to the shared folder every ``store_every`` merges; tasks repeat
    the merges since then, so a lost executor costs its tasks only. Null and empty words take no part.
    """
    spark = counts.sparkSession
    words = counts.select("w", F.col("c").cast("bigint").alias("c")).filter(F.length("w") > 0)
    rows = words.count()
    parts = max(1, min(-(-rows // part_words), 4 * spark.sparkContext.defaultParallelism))
    state = _write(words.repartition(parts).mapInArrow(_spelled, STATE_SCHEMA))
    index = _Index({})
    ids: dict[str, int] = {}
    found: list[tuple[str, str, int]] = []
    done: list[tuple[int, int, int]] = []
    near: dict[int, dict[int, int]] = {}

    def recount() -> int:
        share = spark.sparkContext.broadcast(list(done))
        pairs = state.mapInArrow(partial(_count, share), _CHANGES).groupBy("code").agg(F.sum("n").alias("n"))
        top = pairs.orderBy(F.desc("n"), "code").limit(most).toArrow()
        index.load(list(zip(top["code"].to_pylist(), top["n"].to_pylist())), most)
        return FIRST_MERGED + len(ids)

    oldest = recount()
    while len(found) < merges:
        if index.best() is None:
            if not index.floor:
                break
            oldest = recount()
            if index.best() is None:  # ties fill the list: hold more
                most *= 4
                oldest = recount()
            continue
        if len(done) >= store_every:
            state = _write(state.mapInArrow(partial(_merged, spark.sparkContext.broadcast(list(done))), STATE_SCHEMA))
            done = []
        plan, likely = index.forecast(min(steps, merges - len(found)), near, ids)
        ask = [(c >> BITS, c & (1 << BITS) - 1) for c in likely]
        shared = spark.sparkContext.broadcast((list(done), plan, ask))
        changes = state.mapInArrow(partial(_play, shared), _CHANGES).groupBy("step", "code").agg(F.sum("n").alias("n"))
        table = changes.filter((F.col("step") >= 0) | (F.col("n") >= 2)).toArrow()  # bounded by the vocabulary, not by the words
        step, codes, sums = (table[c].to_numpy() for c in ("step", "code", "n"))
        order = np.argsort(step, kind="stable")
        step, codes, sums = step[order], codes[order].tolist(), sums[order].tolist()
        first = np.searchsorted(step, np.arange(-len(ask), len(plan) + 1)).tolist()
        near = {
            likely[i]: dict(zip(codes[first[len(ask) - 1 - i] : first[len(ask) - i]], sums[first[len(ask) - 1 - i] : first[len(ask) - i]]))
            for i in range(len(ask))
        }
        valid, held = True, len(found)
        for i, (left, right, made) in enumerate(plan):
            at = slice(first[len(ask) + i], first[len(ask) + i + 1])
            best = index.best() if valid else None
            valid = best is not None and best[0] == pair_code(left, right)
            if not valid:  # not its turn; what it would have made tells what to plan next
                near[pair_code(left, right)] = _sides(made, codes[at], sums[at])
                continue
            text = index.text(left), index.text(right)
            found.append((*text, best[1]))
            ids.setdefault(text[0] + text[1], made)
            index.spell[ids[text[0] + text[1]]] = text[0] + text[1]
            done.append((left, right, made))
            index.change(codes[at], sums[at], oldest)
        shared.unpersist()
        held = len(found) - held
        steps = min(2 * steps, most_steps) if held == len(plan) else max(steps // 2, 16) if 4 * held < len(plan) else steps
        known = FIRST_MERGED + len(ids)  # pieces of dropped steps don't exist
        near = {
            code: {side: n for side, n in sides.items() if side >> 1 < known}
            for code, sides in near.items() if code >> BITS < known and code & (1 << BITS) - 1 < known
        }
    spell = spark.sparkContext.broadcast(dict(index.spell))
    last = state.mapInArrow(partial(_merged, spark.sparkContext.broadcast(list(done))), STATE_SCHEMA)
    return found, last.mapInArrow(partial(_as_text, spell), "w string, c bigint, pieces array<string>")


def _sides(made: int, codes: list[int], sums: list[int]) -> dict[int, int]:
    """Neighbours of a merge from the pairs with the piece it made."""
    sides = {}
    for code, n in zip(codes, sums):
        left, right = code >> BITS, code & (1 << BITS) - 1
        if n > 0 and right == made:
            sides[left << 1] = n
        if n > 0 and left == made:
            sides[right << 1 | 1] = n
    return sides


def _write(frame: DataFrame) -> DataFrame:
    path = fresh_path(frame.sparkSession, "merging")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(STATE_SCHEMA).parquet(path)


def _as_text(shared, batches):
    spell = shared.value
    for batch in batches:
        lists = batch["pieces"]
        kinds = lists.flatten().dictionary_encode()
        names = pa.array([spell.get(p) or chr(p) for p in kinds.dictionary.to_pylist()], pa.string())
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        text = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(kinds.indices))
        yield pa.RecordBatch.from_arrays([batch["w"], batch["c"], text], names=["w", "c", "pieces"])
