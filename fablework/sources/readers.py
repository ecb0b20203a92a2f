"""Readers for story shards, token shards, tables, vocabularies and prompt blocks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import json_ranges, version_files

STORY_SCHEMA = T.StructType(
    [
        T.StructField("story", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField(
            "instruction",
            T.StructType(
                [
                    T.StructField("words", T.ArrayType(T.StringType())),
                    T.StructField("features", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


#: A story id is the hash of its shard above and the place in the shard below this bit.
PLACE_BITS = 32
#: Up to so many shards their list is sent to every task; the driver's file listing is as long.
LISTED_SHARDS = 1_000_000
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def shard_name(path: Column) -> Column:
    """``k`` of a path with a folder ``shard=k``, else the file's name."""
    folder = F.url_decode(F.replace(F.regexp_extract(path, r"/shard=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))
    return F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1))


def raw_shards(found: DataFrame) -> DataFrame:
    """Parsed rows of a batch or stream of shards, with shard and file."""
    path = F.col("_metadata.file_path")
    return found.select(*found.columns, shard_name(path).alias("shard_key"), path.alias("shard_path"))


def shape_stories(raw: DataFrame, broken: str = "fail", shards: int | None = None) -> DataFrame:
    """Parsed shard rows as stories with ids.

    An unreadable shard is one unreadable record. It fails the job, unless ``broken`` is
    ``skip`` (``broken_shards`` lists them). An id depends on the name of the shard and the
    place in it alone, not on other files or on how files are packed into tasks: a file is read
    by one task in order, so the place is the row's number less the least one of its shard.
    ``shards`` is the number of shards, if known.
    """
    unreadable = F.col("_corrupt_record").isNotNull()
    # reads a second column, as Spark does not parse for the record's state alone
    readable = ~unreadable & (F.coalesce(F.length("story"), F.lit(0)) >= 0)
    stop = F.raise_error(F.concat(F.lit("shard cannot be read: "), F.col("shard_path"))).cast("boolean")
    rows = raw.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.filter(readable if broken == "skip" else F.when(unreadable, stop).otherwise(readable))
    starts = rows.groupBy("shard_key").agg(F.min("_row").alias("_first"))
    if shards is not None and shards <= LISTED_SHARDS:
        starts = F.broadcast(starts)
    key = F.shiftleft(F.xxhash64("shard_key").bitwiseAND(F.lit((1 << 31) - 1)), PLACE_BITS)
    return rows.join(starts, "shard_key").select(
        "shard_key",
        key.bitwiseOR(F.col("_row") - F.col("_first")).alias("story_id"),
        "story",
        "summary",
        "sentence",
        F.col("instruction.words").alias("words"),
        F.col("instruction.features").alias("features"),
    )


def place_in_shard(story_id: Column) -> Column:
    """0-based place of a story that ``shape_stories`` numbered."""
    return story_id.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def shard_options(reader):
    """Settings of a batch or stream reader for folders of shards."""
    return (
        reader.schema(STORY_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.{json,txt}")
        .option("recursiveFileLookup", True)
    )


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks for each core; Spark takes a task for each of up to 10,000 folders."""
    usual = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(usual), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_TASKS, usual)


def story_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard_key, path, length)`` of the shards of a folder, as listed when this is called; no file is opened."""
    with _few_listing_tasks(spark):
        found = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,txt}").option("recursiveFileLookup", True).load(folder)
        )
    return found.select(shard_name(F.col("_metadata.file_path")).alias("shard_key"), "path", "length")


def _read_files(spark: SparkSession, paths: list[str], broken: str) -> DataFrame:
    with _few_listing_tasks(spark):
        found = raw_shards(shard_options(spark.read).json(paths))
    return shape_stories(found, broken, len(found.inputFiles()))


def read_large_shards(
    spark: SparkSession, folder: str, shards: int | None = None, broken: str = "fail", split_bytes: int = json_ranges.SPLIT_BYTES
) -> DataFrame:
    """The rows of ``read_story_shards``, with every file read in ranges of ``split_bytes`` by many tasks.

    Each file is read twice: where strings and brackets begin must be known before it can be cut.
    """
    files = story_files(spark, folder)
    if shards is not None:
        files = files.orderBy("shard_key").limit(shards)
    named = json_ranges.array_elements(files.select("path", "length"), split_bytes).join(
        F.broadcast(files.select("path", "shard_key")), "path"  # as long as the driver's listing
    )
    parsed = F.from_json("text", STORY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = named.select("shard_key", "path", "place", "error", parsed.alias("s"))
    bad = F.col("error").isNotNull() | F.col("s._corrupt_record").isNotNull()
    if broken == "skip":
        rows = rows.join(rows.filter(bad).select("path").distinct(), "path", "left_anti")
    else:
        stop = F.raise_error(F.concat(F.lit("shard cannot be read: "), F.col("path"))).cast("boolean")
        rows = rows.filter(F.when(bad, stop).otherwise(F.lit(True)))
    key = F.shiftleft(F.xxhash64("shard_key").bitwiseAND(F.lit((1 << 31) - 1)), PLACE_BITS)
    return rows.select(
        "shard_key", key.bitwiseOR(F.col("place")).alias("story_id"), "s.story", "s.summary", "s.sentence",
        F.col("s.instruction.words").alias("words"), F.col("s.instruction.features").alias("features"),
    )


def read_story_shards(
    spark: SparkSession, folder: str, shards: int | None = None, broken: str = "fail"
) -> DataFrame:
    """Stories of a folder of JSON-array shards; with ``shards`` only the first so many are opened.

    A file is read by one task (``read_large_shards`` cuts large ones).

    ``story_id`` grows along a shard. A shard that cannot be parsed raises an error when it
    is read, or is left out with ``broken="skip"``.
    """
    if shards is None:
        return _read_files(spark, [folder], broken)
    wanted = story_files(spark, folder).orderBy("shard_key").limit(shards).collect()
    return _read_files(spark, [r["path"] for r in wanted], broken)


def read_until(spark: SparkSession, folder: str, dataset_size: int, broken: str = "fail") -> DataFrame:
    """Whole shards in name order until more than twice ``dataset_size`` stories are loaded.

    The folder is listed once. Shards are counted in growing runs; those after the run that reaches the bound are not opened.
    """
    taken: list[tuple[str, str]] = []
    loaded, step = 0, 8
    files = story_files(spark, folder)
    while loaded <= 2 * dataset_size:
        rest = files.filter(F.col("shard_key") > F.lit(taken[-1][0])) if taken else files
        run = [(r["shard_key"], r["path"]) for r in rest.orderBy("shard_key").limit(step).collect()]
        if not run:
            break
        counts = dict(shard_counts(_read_files(spark, [path for _, path in run], broken)).collect())
        for key, path in run:
            if loaded > 2 * dataset_size:
                break
            taken.append((key, path))
            loaded += counts.get(key, 0)
        step *= 2
    return _read_files(spark, [path for _, path in taken], broken)


def broken_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard_key, path)`` of shards that cannot be parsed."""
    with _few_listing_tasks(spark):
        raw = raw_shards(shard_options(spark.read).json(folder))
    unreadable = F.col("_corrupt_record").isNotNull() & (F.coalesce(F.length("story"), F.lit(0)) >= 0)
    return raw.filter(unreadable).select("shard_key", F.col("shard_path").alias("path")).distinct()


def shard_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("shard_key").agg(F.count(F.lit(1)).alias("n_rows"))


def shard_index(df: DataFrame) -> DataFrame:
    """``(shard_key, shard_idx, rows)``: 0-based rank of each shard in name order.

    Ranks the list of shards, never the rows.
    """
    counts = shard_counts(df)
    by_name = Window.partitionBy(F.lit(0)).orderBy("shard_key")
    return counts.withColumn("shard_idx", (F.row_number().over(by_name) - 1).cast("bigint"))


def with_shard_index(df: DataFrame) -> DataFrame:
    """Add ``shard_idx`` to every row."""
    return df.join(shard_index(df).select("shard_key", "shard_idx"), "shard_key")


def first_shards(df: DataFrame, count: int) -> DataFrame:
    """Rows of the first ``count`` shards in name order, of a table; see ``read_story_shards`` for files."""
    wanted = shard_index(df).filter(F.col("shard_idx") < count).select("shard_key", "shard_idx")
    return df.join(wanted, "shard_key")


def early_stop_scan(df: DataFrame, dataset_size: int) -> DataFrame:
    """Whole shards in order until more than twice ``dataset_size`` rows are loaded."""
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("shard_key").rowsBetween(Window.unboundedPreceding, -1)
    )
    loaded = (
        shard_index(df)
        .withColumn("loaded_before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0).cast("bigint")))
        .filter(F.col("loaded_before") <= 2 * dataset_size)
        .select("shard_key")
    )
    return df.join(loaded, "shard_key", "left_semi")


def read_version_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables stored below ``v=N`` folders as documents with ``columns`` and ``data``.

    Versions count as long as none is missing: reading stops before the first gap. Rows
    come back as a map from column name to value.
    """
    document = "columns array<string>, data array<array<string>>, start bigint"
    texts = version_files.read_documents(spark, folder)
    if texts is None:
        raw = spark.read.schema(f"{document}, v int").option("multiLine", True).json(folder)
    else:  # a file holds a document or an array of them; a broken one is a row of nulls
        kind = f"array<struct<{document.replace(' array', ':array').replace(' bigint', ':bigint')}>>"
        parsed = F.coalesce(F.from_json("text", kind), F.array(F.lit(None).cast(kind[6:-1])))
        raw = texts.filter(F.trim("text") != "").select("v", F.explode(parsed).alias("d")).select("d.*", "v")
    return version_rows(contiguous_versions(raw, "v"), "v")


def contiguous_versions(df: DataFrame, version: str) -> DataFrame:
    """Rows of the versions 0, 1, … up to the first one that is missing.

    Only the list of versions is numbered; the rows are filtered against the number of
    versions in the unbroken run.
    """
    listed = df.select(F.col(version).alias("_v")).distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_v")) - 1
    unbroken = (
        listed.filter(F.col("_v") >= 0)
        .withColumn("_place", place)
        .agg(F.count_if(F.col("_v") == F.col("_place")).alias("n"))
    )
    return df.filter((F.col(version) >= 0) & (F.col(version) < unbroken.scalar()))


def version_rows(df: DataFrame, version: str = "v") -> DataFrame:
    """One row per table row, values keyed by column name."""
    place = F.coalesce("start", F.lit(0)) + F.col("pos")
    return df.select(
        F.col(version).alias("version"), "columns", "start", F.posexplode("data").alias("pos", "cells")
    ).select("version", place.alias("row_idx"), F.map_from_arrays("columns", "cells").alias("row"))


VOCAB_SCHEMA = "piece string, score double"


def escaped_piece(piece: Column) -> Column:
    """A piece without TAB and line break, which mean something in a vocabulary file."""
    for plain, written in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        piece = F.replace(piece, F.lit(plain), F.lit(written))
    return piece


def _unescaped_piece(piece: Column) -> Column:
    parts = F.transform(
        F.split(piece, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")),
    )
    return F.array_join(parts, "\\")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file with one ``piece<TAB>score`` line per id; ids are line numbers.

    A vocabulary has at most 65,536 lines (ids must fit 16 bits), so the file is read whole
    by one task and numbered by position, which a split read could not do.
    """
    lines = F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1))
    cells = F.split(F.col("line"), "\t", -1)
    return (
        spark.read.text(path, wholetext=True)
        .select(lines.alias("id", "line"))
        .select("id", _unescaped_piece(F.element_at(cells, 1)).alias("piece"), F.element_at(cells, 2).cast("double").alias("score"))
    )


def shot_blocks(text: DataFrame, shots: int, column: str = "value") -> DataFrame:
    """The first ``2 * shots`` blank-line separated blocks of each text, joined again."""
    blocks = F.slice(F.split(column, "\n\n", -1), 1, 2 * shots)
    return text.withColumn("shots", F.array_join(blocks, "\n\n"))


def read_shot_blocks(spark: SparkSession, path: str, shots: int) -> DataFrame:
    return shot_blocks(spark.read.text(path, wholetext=True), shots).select("shots")


def read_runs(
    spark: SparkSession, runs_path: str, history_path: str | None = None, tag: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Run table and, only when asked for, the histories; NaN metrics become null."""
    found = spark.read.parquet(runs_path)
    if tag is not None:
        found = found.filter(F.array_contains("tags", tag))
    return nan_to_null(found), nan_to_null(spark.read.parquet(history_path)) if history_path else None


def nan_to_null(df: DataFrame) -> DataFrame:
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if f.dataType.simpleString() in ("double", "float")
    }
    return df.withColumns(fixed) if fixed else df


__all__ = [
    "broken_shards",
    "contiguous_versions",
    "early_stop_scan",
    "first_shards",
    "nan_to_null",
    "read_large_shards",
    "read_runs",
    "read_shot_blocks",
    "read_story_shards",
    "read_until",
    "read_version_tables",
    "read_vocabulary",
    "place_in_shard",
    "raw_shards",
    "shape_stories",
    "shard_counts",
    "shard_index",
    "shard_options",
    "story_files",
    "shot_blocks",
    "version_rows",
    "with_shard_index",
]
