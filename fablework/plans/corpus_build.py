"""From stories to a tokenized dataset and its training blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import computed_once, word_list
from ..operators import blocks, parse, splits, tokens
from ..operators.render import render
from ..session import cut_lineage
from ..sources.readers import first_shards
from ..sources.writers import write_tokens
from .recipes import Recipe, build_text, dataset_name

# Fixed value: shards the vocabulary is learned from.
VOCABULARY_SHARDS = 10


def vocabulary_texts(stories: DataFrame, shards: int = VOCABULARY_SHARDS, seed: int = 0) -> DataFrame:
    """Text to learn a vocabulary from: every story of the first shards, unfiltered."""
    return render(first_shards(stories, shards).drop("shard_idx"), seed=seed)


def word_vocabulary(texts: DataFrame, size: int) -> DataFrame:
    """Word-level vocabulary of rendered text."""
    sample = computed_once(texts, "words", word_list(F.col("text")))
    return tokens.rank_vocabulary(tokens.word_counts(sample), size)


def word_tokens(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.encode_words(computed_once(texts, "words", word_list(F.col("text"))), vocab)


def chunk_counts(texts: DataFrame) -> DataFrame:
    """Distinct word chunks with their counts, written to the shared folder."""
    return cut_lineage(tokens.word_counts(computed_once(texts.select("text"), "words", tokens.chunks(F.col("text")))))


def learn_vocabulary(texts: DataFrame, size: int):
    """BPE vocabulary of ``size`` ids and its merges, from rendered text.

    Ids are the specials, the bytes, as many merges as fit, and every character.
    """
    counts = chunk_counts(texts)
    letters = tokens.character_counts(counts).filter(F.col("piece") != "\n").count()
    room = size - tokens.FIRST_PIECE - letters
    if room < 0:
        raise ValueError(f"{letters} characters do not fit a vocabulary of {size}")
    merges, _ = tokens.learn_merges(counts, room)
    return tokens.bpe_vocabulary(counts, merges), merges


def bpe_tokens(texts: DataFrame, vocab: DataFrame, merges, keys: tuple[str, ...] = ("shard_key", "story_id")) -> DataFrame:
    """Texts as BPE ids, encoded where they are."""
    return tokens.encode_rows(texts, vocab, merges, keys=keys)


def build_dataset(
    stories: DataFrame, recipe: Recipe, vocab: DataFrame, merges, root: str, vocab_size: int, name: str | None = None, seed: int = 0
) -> str:
    """Filter, edit, render, encode and write one dataset; returns its path."""
    texts = build_text(stories, recipe, seed)
    return write_tokens(bpe_tokens(texts, vocab, merges), root, vocab_size, name or dataset_name(recipe))


def training_stream(encoded: DataFrame, length: int, at_bos: bool = False) -> DataFrame:
    """Training pairs of a tokenized dataset."""
    stream = blocks.token_offsets(encoded)
    cut = blocks.bos_blocks(stream, length) if at_bos else blocks.fixed_blocks(stream, length)
    return blocks.training_pairs(cut, length)


def training_batches(
    pairs: DataFrame, epochs: int, batch_size: int, seed: int = 0, worker: int = 0, rank: int = 0
) -> DataFrame:
    """Training pairs in the shuffled order of each epoch, ``batch_size`` to a batch.

    ``pairs`` should be cut from a stored dataset: block numbers are ordered alone, and tokens
    are joined to their place afterwards.
    """
    ordered = splits.epoch_order(pairs.select("shard_key", "block"), epochs, seed, worker, rank)
    return splits.batches(ordered, batch_size).join(pairs, ["shard_key", "block"])


BATCH = ("batch_id", "place")


def _without_bos(ids: Column) -> Column:
    """Story tokens closed by a line break, which fill up other rows."""
    return F.array_append(F.slice(ids, F.lit(2), F.size(ids)), F.lit(tokens.FIRST_BYTE + 10))


def label_batches(batches: DataFrame, vocab: DataFrame, merges) -> DataFrame:
    """Batches of stories with their labels: ``(batch_id, place, padded, target)``.

    ``batches`` are rows ``(batch_id, place, tokens)`` of blocks that begin with a story. Each is
    decoded, cut down to its story, encoded again and padded on the left with stories of the same batch;
    ``target`` has a 0 or 1 for each feature. A character that the block's end has cut becomes a
    replacement character. Rows that do not parse, or whose features are unknown, are dropped and leave
    their batch smaller; a list that repeats is a row of its own by its place.
    """
    texts = tokens.decode_rows(batches.select(*BATCH, "tokens"), vocab)
    parsed = cut_lineage(parse.labelled_stories(texts).filter(F.size("unknown") == 0).select(*BATCH, "story", "target"))
    rows = bpe_tokens(parsed.select(*BATCH, F.col("story").alias("text")), vocab, merges, BATCH)
    padded = blocks.pad_left(rows.select(*BATCH, "tokens", _without_bos(F.col("tokens")).alias("suffix")))
    return padded.join(parsed.select(*BATCH, "target"), [*BATCH])


def prefix_batches(batches: DataFrame, vocab: DataFrame, merges) -> DataFrame:
    """Batches of prompts to be continued: ``(batch_id, place, padded, prefix, target)``.

    The prompt of a row is its text up to and with the story marker; it is encoded again and padded on the
    left with the stories of the batch. ``target`` is the story. Rows without a story are dropped.
    """
    texts = tokens.decode_rows(batches.select(*BATCH, "tokens"), vocab)
    parsed = cut_lineage(parse.prefix_rows(texts).select(*BATCH, "prefix", "target"))
    both = F.explode(F.array(
        F.struct(F.lit("prefix").alias("part"), F.col("prefix").alias("text")), F.struct(F.lit("story").alias("part"), F.col("target").alias("text"))
    )).alias("p")
    encoded = bpe_tokens(parsed.select(*BATCH, both).select(*BATCH, "p.part", "p.text"), vocab, merges, (*BATCH, "part"))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("tokens")))
    rows = encoded.groupBy(*BATCH).agg(of("prefix").alias("tokens"), of("story").alias("_story"))
    padded = blocks.pad_left(rows.select(*BATCH, "tokens", _without_bos(F.col("_story")).alias("suffix")))
    return padded.join(parsed, [*BATCH])
