"""Frequent phrases of neighbouring words with their collocation scores.

Every n-gram gets a Rabin-Karp fingerprint from a prefix polynomial over the words of a slice of
texts. The shuffle adds up counts by fingerprint and keeps two places where the phrase stands; only
frequent phrases are read from the text there, and the two readings must agree.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices
from .wordcodes import Polynomial, Words, byte_kinds, coded_words, mixed, word_hashes

#: Blank and TAB part words; these marks and line ends part pieces, which no phrase crosses.
KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")

LEAST_BITS, MOST_BITS = 16, 27  # of a filter table: 8 KB to 16 MB

SLICE_BYTES = 3 << 20  # of text that a task holds as arrays
SHORT = np.uint64((1 << 48) - 1)


def phrase_collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4,
    best: int | None = 2000, covered: int = 80, undetermined: str = "und", fingerprint_bits: int = 64,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the best phrases of 2 to ``longest`` words of each language.

    ``a`` counts the places of a phrase, at least ``least``; ``l`` and ``r`` those of its two parts at
    the cut that scores lowest, ``2000000 * a div (l + r)``, ties to the earlier cut; ``n`` all words of
    the language. A phrase inside a longer one that has ``covered`` percent of its places is dropped.
    ``best`` (None: all) rows of each language remain, by score, ``a`` and phrase.

    A phrase is frequent only if its parts are, so short fingerprints of words are counted first, then those
    of pairs of frequent words, and so on; the last pass counts the phrases that may be frequent with their
    places. The filter between the passes is a table of bits of bounded size; a false hit costs a row, never a
    result. ``fingerprint_bits``
    shortens the first fingerprint (for tests of collisions); phrases that share it are told apart by the
    second one, in a slice of texts by the words themselves, and at last by reading the text.

    A null text has no words, a null language is ``undetermined``; repeated rows count each time. Other
    columns are not read. Empty tables give no rows.
    """
    text = F.col(text_col)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(undetermined)).alias("lang"), text.alias("text")
    ).filter(F.length("text") > 0)
    texts = texts.withColumn("key", F.xxhash64("lang", "text"))

    words = stored(_filter_counts(texts, least, fingerprint_bits, 1, []), "phrases-1")
    tables = [bit_table(words.filter(F.col("lang").isNull()), "fp")]
    for length in range(2, longest):
        tables.append(bit_table(stored(_filter_counts(texts, least, fingerprint_bits, length, tables), f"phrases-{length}"), "fp"))
    found = stored(_counted(texts, least, fingerprint_bits, longest, tables), "phrases-found")
    phrases = stored(_read_phrases(found, texts), "phrases-read")
    totals = words.filter(F.col("lang").isNotNull()).select("lang", F.col("n").alias("total"))
    return _ranked(_kept(_scored(phrases), covered), totals, best)


# ------------------------------------------------------------------ counting


def _filter_counts(texts: DataFrame, least: int, bits: int, length: int, tables: list[np.ndarray]) -> DataFrame:
    """``(lang, fp, n)``: short fingerprints of at least ``least`` places; with words the totals of the languages.

    Only a filter is made from these rows, so they carry no more than 48 bits and a count.
    """
    shared = texts.sparkSession.sparkContext.broadcast(list(tables))
    rows = texts.mapInArrow(partial(_filter_batches, shared, bits, length), "lang string, fp bigint, n bigint")
    counts = rows.groupBy("lang", "fp").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least) | F.col("lang").isNotNull())


def _counted(texts: DataFrame, least: int, bits: int, longest: int, tables: list[np.ndarray]) -> DataFrame:
    """Frequent fingerprints ``(fp, check, n, key, place, key2, place2)`` of words and phrases."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)
    rows = texts.mapInArrow(partial(_count_batches, shared, bits, longest), "fp bigint, check bigint, n bigint, key bigint, place bigint")
    return (
        rows.groupBy("fp", "check")
        .agg(
            F.sum("n").alias("n"), F.min("key").alias("key"), F.min_by("place", "key").alias("place"),
            F.max("key").alias("key2"), F.max_by("place", "key").alias("place2"),
        )
        .filter(F.col("n") >= least)
    )


class _Chain:
    """The words of a slice of texts with the fingerprints of all their windows."""

    def __init__(self, part: pa.RecordBatch, words: Words, bits: int, variants: int):
        self.words, self.mask = words, np.uint64((1 << bits) - 1)
        self.langs = part["lang"].dictionary_encode()
        self.lang_codes = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # one code for each pair of language and word
        pair, self.codes = np.unique(self.lang_codes[words.rows] * len(words.distinct) + words.codes, return_inverse=True)
        of_lang, of_word = np.divmod(pair, len(words.distinct))
        self.chains = []
        for v in range(variants):
            names, spelled = word_hashes(self.langs.dictionary, v)[of_lang], word_hashes(words.distinct, v)[of_word]
            self.chains.append(Polynomial(mixed(names + np.uint64(3) * spelled)[self.codes], v))

    def starts(self, length: int) -> np.ndarray:
        """Words from which ``length`` words lie in one piece."""
        at = np.arange(max(len(self.words) - length + 1, 0))
        return at[self.words.pieces[at] == self.words.pieces[at + length - 1]]

    def prints(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.chains[0].windows(starts, starts + length) & self.mask

    def held(self, table: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """For every word, whether a window from it is listed and ``table`` holds it."""
        out = np.zeros(len(self.words) + 1, bool)
        out[starts[_held(table, self.prints(starts, length) & SHORT)]] = True
        return out


def _parts(batches):
    for batch in batches:
        for first, past in text_slices(batch["text"], SLICE_BYTES):
            part = batch.slice(first, past - first)
            words = coded_words(part["text"], KINDS)
            if len(words):
                yield part, words


def _filter_batches(shared, bits, length, batches):
    for part, words in _parts(batches):
        chain = _Chain(part, words, bits, 1)
        starts = chain.starts(length)
        if length == 1:
            totals = np.bincount(chain.lang_codes[words.rows], minlength=len(chain.langs.dictionary))
            yield _filter_rows(chain.langs.dictionary.cast(pa.string()), np.zeros(len(totals), np.int64), totals)
        else:
            starts = _possible(starts, chain.held(shared.value[-1], chain.starts(length - 1), length - 1))
        fp, counts = np.unique(chain.prints(starts, length) & SHORT, return_counts=True)
        yield _filter_rows(pa.nulls(len(fp), pa.string()), fp.view(np.int64), counts)


def _filter_rows(lang: pa.Array, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(fp, pa.int64()), pa.array(n, pa.int64())], names=["lang", "fp", "n"])


def _possible(starts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Windows whose first and last words but one may be frequent."""
    return starts[shorter[starts] & shorter[starts + 1]]


def _count_batches(shared, bits, longest, batches):
    """Counts of the words and phrases that may be frequent, in each slice of texts."""
    tables = shared.value
    for part, words in _parts(batches):
        chain = _Chain(part, words, bits, 2)
        keys = part["key"].to_numpy(zero_copy_only=False)
        shorter = None
        for length in range(1, longest + 1):
            starts = chain.starts(length)
            if shorter is not None:
                starts = _possible(starts, shorter)
            if length <= len(tables):
                shorter = chain.held(tables[length - 1], starts, length)
                starts = starts[shorter[starts]]
            if len(starts):
                yield _grouped(chain, starts, length, keys)


def _grouped(chain: _Chain, starts: np.ndarray, length: int, keys: np.ndarray) -> pa.RecordBatch:
    """A row for each phrase of a slice: fingerprints, count and one of its places."""
    words = chain.words
    fp = chain.prints(starts, length)
    order = np.argsort(fp)
    fp, starts = fp[order], starts[order]
    new = np.append(True, fp[1:] != fp[:-1])
    for i in range(length):  # the words themselves decide whether two places hold one phrase
        code = chain.codes[starts + i]
        new[1:] |= code[1:] != code[:-1]
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(starts)))
    fp, starts = fp[heads], starts[heads]
    check = chain.chains[1].windows(starts, starts + length)
    place = (words.begins[starts] << 31) | (words.ends[starts + length - 1] - words.begins[starts])
    columns = (fp.view(np.int64), check.view(np.int64), counts, keys[words.rows[starts]], place)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fp", "check", "n", "key", "place"])


# ------------------------------------------------------------------ filter tables


def bit_table(frame: DataFrame, column: str) -> np.ndarray:
    """A bit for the low digits of each value: 16 bits a row, at most 16 MB in all.

    The driver gets at most ``2**MOST_BITS / 64`` numbers, whatever the rows.
    """
    bits = min(max((16 * frame.count()).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    words = frame.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return table


def _held(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


# ------------------------------------------------------------------ from fingerprints to phrases


def _read_phrases(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``(lang, phrase, words, n)``: each phrase read at both of its places.

    Texts that repeat are one row before they meet the places. Two places of one fingerprint with
    different words fail the job.
    """
    once = texts.groupBy("key").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    ends = F.array(F.struct("key", "place"), F.struct(F.col("key2").alias("key"), F.col("place2").alias("place")))
    places = found.select("fp", "check", "n", F.explode(F.array_distinct(ends)).alias("p")).select("fp", "check", "n", "p.*")
    start = F.shiftright("place", 31).cast("int") + 1
    span = F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    piece = F.substring(F.col("text").cast("binary"), start, span).cast("string")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.split(F.translate(piece, upper, lower), r"[\x20\x09]+")
    read = places.join(once, "key").select("fp", "check", "n", "lang", F.array_join(words, " ").alias("phrase"))
    same = read.groupBy("fp", "check", "n").agg(
        F.min("lang").alias("lang"), F.max("lang").alias("lang2"), F.min("phrase").alias("phrase"), F.max("phrase").alias("phrase2")
    )
    clash = F.raise_error(F.concat(F.lit("two phrases share both fingerprints: "), "phrase", F.lit(" / "), "phrase2"))
    agreed = (F.col("phrase") == F.col("phrase2")) & (F.col("lang") == F.col("lang2"))
    phrase = F.when(agreed, F.col("phrase")).otherwise(clash)
    return same.select("lang", phrase.alias("phrase"), "n").select("lang", "phrase", F.split("phrase", " ").alias("words"), "n")


def _joined(words: Column, first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def _scored(phrases: DataFrame) -> DataFrame:
    """Candidates with ``a``, and ``l``, ``r`` and score of the cut that scores lowest.

    The parts of a frequent phrase are frequent, so they are rows of the same table.
    """
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    size = F.size("words")
    cuts = phrases.filter(size > 1).select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    )
    sides = cuts.select(
        "*", _joined(F.col("words"), 1, F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, size).alias("right")
    )
    sides = sides.join(counts.select("lang", F.col("part").alias("left"), F.col("count").alias("l")), ["lang", "left"])
    sides = sides.join(counts.select("lang", F.col("part").alias("right"), F.col("count").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (
        sides.withColumn("score", score)
        .groupBy("lang", "phrase", "words", "a").agg(worst)
        .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    )


def _kept(candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates that no longer candidate covers."""
    size = F.size("words")
    windows = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda i: F.array_join(F.slice(F.col("words"), i, w), " ")),
        )
    )
    inner = candidates.filter(size > 2).select("lang", F.explode(F.array_distinct(windows)).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hidden = F.expr(f"cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) >= cast({covered} as decimal(3,0)) * cast(a as decimal(20,0))")
    return candidates.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(hidden, F.lit(False)))


def _ranked(candidates: DataFrame, totals: DataFrame, best: int | None) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
