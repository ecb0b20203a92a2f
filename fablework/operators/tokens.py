"""Vocabularies, encoding and decoding.

A vocabulary never has more than 65,536 entries, since ids must fit 16 bits; that bound is
what allows vocabularies to be broadcast and merge lists to be kept by the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import computed_once
from ..session import cut_lineage
from . import merging

# Special ids, the byte range, the piece that stands for a blank, id limit.
UNKNOWN, BOS, EOS = 0, 1, 2
SPECIALS = ("<unk>", "<s>", "</s>")
FIRST_BYTE = 3
FIRST_PIECE = 259
BLANK = "▁"
MAX_IDS = 65536
LOOK_UPS = 1 << 15  # maps that words are looked up in
ENCODED_ROWS = 256  # texts that a task encodes at a time

# Word pieces never cross these limits: runs of letters, single digits, other runs; a blank
# goes with what follows it, and a line break stands alone.
CHUNK = rf"\n|{BLANK}?[\p{{L}}\p{{M}}]+|{BLANK}?\p{{N}}|{BLANK}?[^\p{{L}}\p{{M}}\p{{N}}{BLANK}\n]+|{BLANK}+"


# ------------------------------------------------------------------ words


def word_counts(words: DataFrame, column: str = "words") -> DataFrame:
    """``(w, c)`` over all rows of word lists; counted before the shuffle.

    Give the lists as a stored column or by ``computed_once``.
    """
    return words.select(F.explode(column).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def most_frequent(counts: DataFrame, k: int, item: str = "w") -> DataFrame:
    """The ``k`` rows with the highest count, ties by text.

    The count that the k-th row must have is read from the histogram of counts, so the
    final ordering sees the chosen rows and their ties, not a head of every task.
    """
    frequencies = counts.groupBy("c").agg(F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("c"))
    reached = frequencies.withColumn("_sum", F.sum("_n").over(down)).filter(F.col("_sum") >= k)
    least = reached.agg(F.max("c")).scalar()
    return counts.filter(F.col("c") >= F.coalesce(least, F.lit(0))).orderBy(F.desc("c"), item).limit(k)


def rank_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent words, ties by word, with ids from 259 on, below ``size``."""
    if not FIRST_PIECE < size <= MAX_IDS:
        raise ValueError("the vocabulary size must be above 259 and at most 65,536")
    best = most_frequent(counts, size - FIRST_PIECE)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c"), "w"))
    return best.select("w", "c", (place + F.lit(FIRST_PIECE - 1)).cast("int").alias("id"))


def encode_words(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """BOS and the word ids of each row of ``(shard_key, story_id, words)``.

    Words outside the vocabulary become id 0; rows without a list are left out. The vocabulary is bounded, so every
    task holds it as a table of small maps, and a row's words are looked up in the row: nothing is shuffled.
    """
    of = lambda w: F.pmod(F.xxhash64(w), F.lit(LOOK_UPS)).cast("int")
    places = vocab.sparkSession.range(LOOK_UPS).select(F.col("id").cast("int").alias("_at"))
    whole = places.join(vocab.groupBy(of(F.col("w")).alias("_at")).agg(F.collect_list(F.struct("w", "id")).alias("_ids")), "_at", "left")
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_ids")))["_ids"]
    table = whole.agg(F.transform(ordered, lambda entries: F.map_from_entries(entries)).alias("_table"))
    ids = F.transform("words", lambda w: F.coalesce(F.try_element_at(F.get("_table", of(w)), w), F.lit(UNKNOWN)))
    rows = docs.filter(F.col("words").isNotNull()).select("shard_key", "story_id", "words", table.scalar().alias("_table"))
    encoded = rows.select("shard_key", "story_id", F.concat(F.array(F.lit(BOS)), ids).alias("tokens"))
    return computed_once(encoded, "tokens", F.col("tokens"))


# ------------------------------------------------------------------ byte pair encoding


def chunks(text: Column) -> Column:
    """Text as an array of word chunks; joined they give ``▁`` + text with blanks as ``▁``."""
    marked = F.concat(F.lit(BLANK), F.replace(text, F.lit(" "), F.lit(BLANK)))
    return F.regexp_extract_all(marked, F.lit(f"({CHUNK})"), F.lit(1))


def pair_counts(words: DataFrame) -> DataFrame:
    """``(left, right, c)``: how often two pieces stand side by side, weighted by word count.

    ``words`` has ``pieces`` (array) and ``c``.
    """
    # the lambda argument keeps the pieces from being computed for each of their uses
    pairs = F.transform(
        F.array("pieces"),
        lambda p: F.zip_with(
            F.slice(p, 1, F.size(p) - 1),
            F.slice(p, 2, F.size(p) - 1),
            lambda left, right: F.struct(left.alias("left"), right.alias("right")),
        ),
    )
    return (
        computed_once(words.select("c", "pieces"), "pairs", F.element_at(pairs, 1))
        .select("c", F.explode("pairs").alias("p"))
        .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right"))
        .agg(F.sum("c").alias("c"))
    )


def learn_merges(counts: DataFrame, merges: int) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """The first ``merges`` pair merges over the distinct-word table ``(w, c)``.

    Each is the most frequent pair of the state before it, ties by text. Returns the merges with
    their counts and the words ``(w, c, pieces)`` after them; see ``merging.learn``.
    """
    return merging.learn(counts, merges)


def character_counts(counts: DataFrame) -> DataFrame:
    """``(piece, c)`` of single characters over the distinct-word table."""
    spelled = computed_once(counts, "letters", F.regexp_extract_all("w", F.lit(r"([\s\S])"), F.lit(1)))
    return (
        spelled.select("c", F.explode("letters").alias("piece"))
        .groupBy("piece")
        .agg(F.sum("c").alias("c"))
    )


def bpe_vocabulary(counts: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """``(id, piece, score)``: specials, 256 byte pieces, merges by rank, then characters.

    Characters follow by falling count. Merged pieces and characters score minus their
    place; specials and bytes score 0. Line breaks stay bytes.
    """
    spark = counts.sparkSession
    fixed = [(i, piece) for i, piece in enumerate(SPECIALS)]
    fixed += [(FIRST_BYTE + b, f"<0x{b:02X}>") for b in range(256)]
    seen: dict[str, None] = dict.fromkeys(left + right for left, right, _ in merges)
    learned = [(FIRST_PIECE + i, piece) for i, piece in enumerate(seen)]
    head = spark.createDataFrame(fixed + learned, "id int, piece string")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c"), "piece"))
    letters = (
        most_frequent(
            character_counts(counts).filter(F.col("piece") != "\n"), MAX_IDS - FIRST_PIECE - len(learned), "piece"
        )
        .select((place + F.lit(FIRST_PIECE + len(learned) - 1)).cast("int").alias("id"), "piece")
    )
    score = F.when(F.col("id") < FIRST_PIECE, F.lit(0.0)).otherwise(
        (F.lit(FIRST_PIECE) - F.col("id")).cast("double")
    )
    return head.unionByName(letters).withColumn("score", score)


def _word_cutter(merges: list[tuple[str, str, int]]) -> Callable[[str], list[str]]:
    """A function from a word to its pieces by a learned merge list."""
    rank: dict[tuple[str, str], int] = {}
    for i, (left, right, _) in enumerate(merges):
        rank.setdefault((left, right), i)

    def pieces_of(word: str) -> list[str]:
        """The known pair of lowest rank is joined, everywhere from the left, until none is left."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            lowest, turn = heap[0][0], []
            while heap and heap[0][0] == lowest:
                turn.append(heapq.heappop(heap)[1])
            joined = []
            for i in turn:
                j = after[i] if parts[i] is not None else len(parts)
                if j == len(parts) or rank.get((parts[i], parts[j])) != lowest:
                    continue  # a place that has changed since it was noted
                parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
                if after[j] < len(parts):
                    before[after[j]] = i
                joined.append(i)
            for i in joined:
                for left in (before[i], i):
                    right = after[left] if left >= 0 else len(parts)
                    if right < len(parts) and (found := rank.get((parts[left], parts[right]))) is not None:
                        heapq.heappush(heap, (found, left))
        return [p for p in parts if p is not None]

    return pieces_of


def merge_words(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """Pieces of distinct words by a learned merge list: ``(w, pieces)``.

    Runs once per distinct word, whatever its frequency.
    """
    pieces_of = _word_cutter(merges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"w": frame["w"], "pieces": [pieces_of(w) for w in frame["w"]]})

    return words.select("w").mapInPandas(run, "w string, pieces array<string>")


def word_ids(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids of distinct words ``(w, pieces)``; a piece without id becomes its UTF-8 bytes."""
    small = F.broadcast(vocab.filter(F.col("id") >= FIRST_PIECE).select("piece", "id"))
    hexed = F.hex(F.encode("piece", "UTF-8"))
    as_bytes = F.transform(
        F.sequence(F.lit(1), F.octet_length("piece")),
        lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + F.lit(FIRST_BYTE),
    )
    return (
        pieces.select("w", F.posexplode("pieces").alias("pos", "piece"))
        .join(small, "piece", "left")
        .withColumn("ids", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes))
        .groupBy("w")
        .agg(F.flatten(F.sort_array(F.collect_list(F.struct("pos", "ids")))["ids"]).alias("ids"))
    )


def cut_texts(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("shard_key", "story_id")) -> DataFrame:
    """``(_key, words)``: texts cut into word chunks once, in the shared folder.

    ``_key`` holds the keys and a row number, which is written with the row: rows that repeat the keys
    stay apart, and a task that runs again reads the number it had. A null text gives no row.
    """
    row = F.struct(*keys, F.monotonically_increasing_id().alias("_row")).alias("_key")
    present = texts.filter(F.col(text).isNotNull()).select(row, text)
    return cut_lineage(computed_once(present, "words", chunks(F.col(text))).select("_key", "words"))


def encode_text(
    texts: DataFrame,
    ids: DataFrame,
    counts: DataFrame,
    text: str = "text",
    keys: tuple[str, ...] = ("shard_key", "story_id"),
    frequent: int = 20_000,
) -> DataFrame:
    """``(keys, tokens)``: BOS and the ids of each text, from the ids of its distinct words."""
    return encode_cut(cut_texts(texts, text, keys), ids, counts, keys, frequent)


def encode_cut(
    cut: DataFrame, ids: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("shard_key", "story_id"), frequent: int = 20_000
) -> DataFrame:
    """``encode_text`` for texts that ``cut_texts`` has stored.

    A word without ids raises an error. A few words make up most of any text. The
    ``frequent`` most counted words are broadcast, a bounded list, and looked up where the
    text is; only the other words are joined by word. None of them is frequent enough to weigh
    down a task. Rows that repeat the keys keep a text each.
    """
    hot = most_frequent(counts, frequent).select("w")
    hot_ids = F.broadcast(ids.join(F.broadcast(hot), "w", "left_semi").select("w", F.col("ids").alias("_near")))
    spread = cut.select("_key", F.posexplode("words").alias("pos", "w")).join(hot_ids, "w", "left")
    # a word that was found near needs no partner: its key is spread over all tasks
    far = F.when(F.col("_near").isNull(), F.col("w")).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("_key", "pos").cast("string")))
    joined = spread.withColumn("_far", far).join(
        ids.select(F.col("w").alias("_far"), F.col("ids").alias("_ids")), "_far", "left"
    )
    known = F.coalesce("_near", "_ids", F.raise_error(F.concat(F.lit("no ids for the word "), F.col("w"))).cast("array<int>"))
    whole = joined.groupBy("_key").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("pos", known.alias("ids"))))["ids"]).alias("ids")
    )
    return whole.select(
        *[F.col("_key")[k].alias(k) for k in keys], F.concat(F.array(F.lit(BOS)), F.col("ids")).alias("tokens")
    )


def encode_rows(
    texts: DataFrame, vocab: DataFrame, merges: list[tuple[str, str, int]], text: str = "text",
    keys: tuple[str, ...] = ("shard_key", "story_id"), held: int = 200_000,
) -> DataFrame:
    """``(keys, tokens)``: BOS and the ids of each text, as ``encode_text`` gives them, without moving a row.

    Vocabulary and merges, which ids of 16 bits bound, go to every task. A task cuts each distinct word once as long
    as it is among the last ``held`` it met. A piece without id becomes its UTF-8 bytes; a null text gives no row.
    """
    spark = texts.sparkSession
    listed = vocab.select("id", "piece").filter(F.col("id") >= FIRST_PIECE).collect()  # at most MAX_IDS
    shared = spark.sparkContext.broadcast(({r["piece"]: r["id"] for r in listed}, merges))
    rows = computed_once(texts.filter(F.col(text).isNotNull()).select(*keys, text), "words", chunks(F.col(text))).select(*keys, "words")
    schema = rows.select(*keys, F.array(F.lit(BOS)).alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, steps = shared.value
        pieces_of, known = _word_cutter(steps), {}

        def ids_of(word: str) -> np.ndarray:
            found = []
            for piece in pieces_of(word):
                if piece in ids:
                    found.append(ids[piece])
                else:
                    found.extend(b + FIRST_BYTE for b in piece.encode())
            return np.array(found, np.int32)

        for whole in batches:
            for first in range(0, whole.num_rows, ENCODED_ROWS):
                batch = whole.slice(first, ENCODED_ROWS)
                words = batch["words"].flatten().dictionary_encode()
                if len(known) > held:
                    known = {}
                names = words.dictionary.to_pylist()
                lists = [known.get(w) for w in names]
                for i, w in enumerate(names):
                    if lists[i] is None:
                        lists[i] = known[w] = ids_of(w)
                # a word's ids are a stretch of `flat`; BOS stands behind all of them
                flat = np.concatenate([*lists, [BOS]]).astype(np.int32)
                sizes = np.array([*map(len, lists), 1], np.int64)
                begins = np.cumsum(sizes) - sizes
                counts = pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.cumsum(counts) - counts
                order = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, len(lists))
                size = sizes[order]
                past = np.cumsum(size)
                tokens = flat[np.repeat(begins[order] - (past - size), size) + np.arange(past[-1] if len(past) else 0)]
                ends = np.append(0, past)[np.append(0, np.cumsum(counts + 1))]
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], column], names=[*keys, "tokens"])

    return rows.mapInArrow(run, schema)


def decode_tokens(encoded: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ("shard_key", "story_id")) -> DataFrame:
    """``(keys, text)``: pieces joined in order, byte pieces as bytes, the leading blank dropped.

    Token lists are moved whole, once. Rows that share their keys are one text, their tokens in the order of places and then of bytes.
    The vocabulary, which ids of 16 bits bound, goes to every task. Ids outside it give nothing.
    """
    listed = {r["id"]: r["piece"] for r in vocab.select("id", "piece").filter(F.col("id") >= FIRST_BYTE).collect()}  # at most MAX_IDS
    shared = encoded.sparkSession.sparkContext.broadcast(
        {i: bytes.fromhex(p[3:5]) if i < FIRST_PIECE else p.encode() for i, p in listed.items()}
    )
    joined = encoded.filter(F.size("tokens") > 0).groupBy(*keys).agg(F.collect_list("tokens").alias("lists"))
    schema = joined.select(*keys, F.lit(b"").alias("data")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = shared.value
        for batch in batches:
            data = []
            for row in batch["lists"]:
                lists = [one.values.to_pylist() for one in row.values]
                if len(lists) == 1:
                    data.append(b"".join([spelled.get(t, b"") for t in lists[0]]))
                else:
                    placed = sorted((pos, spelled.get(t, b"")) for one in lists for pos, t in enumerate(one))
                    data.append(b"".join([x for _, x in placed]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keys], pa.array(data, pa.binary())], names=[*keys, "data"])

    # blocks may begin or end inside a character; such bytes become replacement characters
    text = F.replace(F.make_valid_utf8(F.col("data").cast("string")), F.lit(BLANK), F.lit(" "))
    return joined.mapInArrow(run, schema).select(*keys, F.substr(text, F.lit(2)).alias("text"))


def decode_rows(rows: DataFrame, vocab: DataFrame, tokens: str = "tokens", name: str = "text") -> DataFrame:
    """Replace the token lists of a column by their texts, as ``decode_tokens`` gives them, without moving a row.

    The vocabulary, which ids of 16 bits bound, goes to every task. Ids outside it give nothing.
    """
    spark = rows.sparkSession
    listed = {r["id"]: r["piece"] for r in vocab.select("id", "piece").filter(F.col("id") >= FIRST_BYTE).collect()}  # at most MAX_IDS
    spelled = [b""] * (max(listed, default=0) + 2)  # the last one for ids outside
    for i, piece in listed.items():
        spelled[i] = bytes([i - FIRST_BYTE]) if i < FIRST_PIECE else piece.encode()
    shared = spark.sparkContext.broadcast(spelled)
    kept = [c for c in rows.columns if c != tokens]
    schema = rows.select(*kept, F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.large_binary())
        last = len(pieces) - 1
        for batch in batches:
            lists = batch[tokens]
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            found = pieces.take(pa.array(np.where((ids >= 0) & (ids < last), ids, last)))
            ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)))
            data = b"".join(found.to_pylist())
            cuts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            texts = [
                data[ends[a] : ends[b]].decode("utf-8", "replace").replace(BLANK, " ")[1:] for a, b in zip(cuts[:-1], cuts[1:])
            ]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(texts, pa.string())], names=[*kept, name])

    return rows.select(*kept, tokens).mapInArrow(run, schema)


# ------------------------------------------------------------------ export


def export_vocabulary(vocab: DataFrame) -> DataFrame:
    """Vocabulary rows in display form with their byte lengths.

    The mark for a blank becomes a blank; BOS and EOS are shown on their own lines.
    ``max_length`` is the longest piece in bytes.
    """
    shown = (
        F.when(F.col("id") == BOS, F.lit("\n<s>\n"))
        .when(F.col("id") == EOS, F.lit("\n</s>\n"))
        .otherwise(F.replace("piece", F.lit(BLANK), F.lit(" ")))
    )
    rows = vocab.select("id", shown.alias("piece"), F.octet_length(shown).alias("n_bytes"), "score")
    return rows.withColumn("max_length", rows.agg(F.max("n_bytes")).scalar())


__all__ = [
    "bpe_vocabulary",
    "character_counts",
    "chunks",
    "cut_texts",
    "decode_tokens",
    "decode_rows",
    "encode_cut",
    "encode_rows",
    "encode_text",
    "encode_words",
    "export_vocabulary",
    "learn_merges",
    "merge_words",
    "pair_counts",
    "rank_vocabulary",
    "word_counts",
    "word_ids",
    "most_frequent",
]
