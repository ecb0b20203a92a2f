"""Sinks: text, token datasets, labelled sets, chat lines, score cache, summaries, vocabularies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import token_offsets
from ..operators.ordinals import ID_BITS
from ..operators.tokens import MAX_IDS
from . import version_files
from .readers import VOCAB_SCHEMA, escaped_piece


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One rendered text after the other, each ended by a newline."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_story_shards(stories: DataFrame, path: str) -> None:
    """One JSON array a shard, in a file below ``shard=<key>``, stories in the order of their ids.

    A story is a line of its file. One task writes a shard, story after story: it holds no shard, but a large one takes long.
    """
    row = F.struct("story", "summary", "sentence", F.struct("words", "features").alias("instruction"))
    shard = Window.partitionBy("shard")
    lines = stories.select(F.col("shard_key").alias("shard"), "story_id", F.to_json(row).alias("value"))
    lines = lines.withColumn("_place", F.row_number().over(shard.orderBy("story_id", "value"))).withColumn("_n", F.count(F.lit(1)).over(shard))
    begin = F.when(F.col("_place") == 1, F.lit("[")).otherwise(F.lit(","))
    end = F.when(F.col("_place") == F.col("_n"), F.lit("]")).otherwise(F.lit(""))
    lines.select("shard", F.concat(begin, "value", end).alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def in_id_range(tokens: Column) -> Column:
    """The token list itself, or an error when an id does not fit 16 bits."""
    ok = (F.coalesce(F.array_max(tokens), F.lit(0)) < MAX_IDS) & (F.coalesce(F.array_min(tokens), F.lit(0)) >= 0)
    return F.when(ok, tokens).otherwise(F.raise_error(F.lit("a token id does not fit 16 bits")))


def dataset_path(root: str, vocab_size: int, dataset_name: str) -> str:
    return f"{root.rstrip('/')}/tok{vocab_size}/{dataset_name}"


def write_tokens(
    encoded: DataFrame, root: str, vocab_size: int, dataset_name: str, id_bits: int = ID_BITS
) -> str:
    """A tokenized dataset, one folder per shard, with the place of each story in its stream.

    Numbering the stories brings runs of neighbouring ids of a shard together, and as such
    they are written: a big shard by many tasks, few files per shard. Blocks cut from the
    stored dataset then need no further numbering.
    """
    path = dataset_path(root, vocab_size, dataset_name)
    (
        token_offsets(encoded.select("shard_key", "story_id", in_id_range(F.col("tokens")).alias("tokens")), id_bits)
        .write.mode("overwrite")
        .partitionBy("shard_key")
        .parquet(path)
    )
    return path


def read_tokens(spark: SparkSession, root: str, vocab_size: int, dataset_name: str) -> DataFrame:
    """A tokenized dataset; a filter on ``shard_key`` reads only its folders."""
    return (
        spark.read.schema("story_id bigint, tokens array<int>, before bigint, total bigint, shard_key string")
        .parquet(dataset_path(root, vocab_size, dataset_name))
    )


def write_labelled(df: DataFrame, path: str) -> None:
    """A labelled set with its nested columns, one folder per class."""
    df.write.mode("overwrite").partitionBy("label").parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    return found.withColumn("label", F.col("label").cast("double"))


def write_chat_lines(rows: DataFrame, path: str) -> None:
    """``{"messages": […]}`` per line; an older file is replaced."""
    rows.select("messages").write.mode("overwrite").json(path)


ROW_BITS = 14
SCORE_SCHEMA = "cache_id string, score double, content string, error string, attempts int"

#: Folders of the cache: the first digit of a cache id, or two of a large append.
LARGE_APPEND = 1 << 20


def append_scores(scores: DataFrame, path: str, rows: int = 0) -> None:
    """Add scores to the cache table; ids that it holds already are left out.

    Ids repeated within ``scores`` are added once. Two jobs that append at the same time may
    still add an id twice, which ``read_scores`` undoes. ``rows`` is the expected size.
    """
    held = read_scores(scores.sparkSession, path, distinct=False).select("cache_id")
    new = scores.dropDuplicates(["cache_id"]).join(held, "cache_id", "left_anti")
    write_new_scores(new, path, rows)


def write_new_scores(scores: DataFrame, path: str, rows: int = 0) -> None:
    """Add scores of distinct ids that the cache does not hold, one file for each folder they fall into.

    All of them are committed together or not at all.
    """
    empty = {"error": F.lit(None).cast("string"), "attempts": F.lit(None).cast("int")}
    columns = ["cache_id", "score", "content", *[F.col(c) if c in scores.columns else empty[c].alias(c) for c in empty]]
    digits = 2 if rows > LARGE_APPEND else 1
    new = scores.select(*columns, F.substring("cache_id", 1, digits).alias("prefix"))
    new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def _cache_table(spark: SparkSession, path: str) -> DataFrame:
    schema = SCORE_SCHEMA + ", prefix string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_scores(spark: SparkSession, path: str, distinct: bool = True, prefixes: list[str] | None = None) -> DataFrame:
    """``(cache_id, score, content)`` of the cache table, empty when nothing was written yet.

    With ``prefixes`` only the folders that may hold ids beginning so. Prompts that failed are not in it.
    """
    found = _cache_table(spark, path)
    if prefixes is not None:
        found = found.filter(F.col("prefix").isin(sorted({p[:n] for p in prefixes for n in (1, 2)})))
    found = found.filter(F.col("error").isNull()).select("cache_id", "score", "content")
    return found.groupBy("cache_id").agg(F.min(F.struct("score", "content")).alias("s")).select("cache_id", "s.*") if distinct else found


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """``(cache_id, error, attempts)``: the errors of prompts that no run has answered; attempts of all runs."""
    failed = _cache_table(spark, path).filter(F.col("error").isNotNull())
    failed = failed.groupBy("cache_id").agg(F.max("error").alias("error"), F.sum("attempts").alias("attempts"))
    return failed.join(read_scores(spark, path, distinct=False).select("cache_id"), "cache_id", "left_anti")


def compact_scores(spark: SparkSession, path: str, to: str) -> None:
    """Write the cache table to another place, each answered id once, with a file for each folder.

    Point jobs at ``to`` afterwards; the old table stays as it is.
    """
    found = read_scores(spark, path)
    write_new_scores(found, to, found.count())


def write_summary(summary: DataFrame, path: str) -> None:
    """Summary table as CSV with a header."""
    summary.write.mode("overwrite").option("header", True).csv(path)


def write_version_tables(rows: DataFrame, columns: list[str], path: str) -> None:
    """Generation tables as ``v=N/part=M`` folders with one ``{columns, data}`` document each.

    A table of up to ``2**ROW_BITS`` rows is one document. A larger one is cut into parts,
    each with the number of its first row in ``start``, so no document outgrows a task.
    """
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    ordered = F.sort_array(F.collect_list(F.struct("row_idx", cells.alias("cells"))))
    part = F.shiftright("row_idx", ROW_BITS)
    documents = rows.groupBy(F.col("version").alias("v"), part.alias("part")).agg(
        F.to_json(
            F.struct(
                F.array(*[F.lit(c) for c in columns]).alias("columns"),
                ordered["cells"].alias("data"),
                F.min("row_idx").alias("start"),
            )
        ).alias("value")
    )
    if version_files.file_system(path) is None:
        documents.write.mode("overwrite").partitionBy("v", "part").text(path)
    else:
        version_files.write_documents(documents, path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """``piece<TAB>score`` lines in id order, as one file: a vocabulary is bounded.

    A backslash, TAB or line break inside a piece is written as ``\\\\``, ``\\t`` or ``\\n``.
    """
    score = F.regexp_replace(F.col("score").cast("string"), r"\.0$", "")
    (
        vocab.repartitionByRange(1, "id")
        .sortWithinPartitions("id")
        .select(F.concat(escaped_piece(F.col("piece")), F.lit("\t"), score).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


__all__ = [
    "VOCAB_SCHEMA",
    "append_scores",
    "compact_scores",
    "dataset_path",
    "in_id_range",
    "read_failures",
    "read_labelled",
    "read_scores",
    "read_tokens",
    "write_chat_lines",
    "write_labelled",
    "write_new_scores",
    "write_story_shards",
    "write_summary",
    "write_text",
    "write_tokens",
    "write_version_tables",
    "write_vocabulary",
]
