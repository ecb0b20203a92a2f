"""New story shards through the same pipeline as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.recipes import Recipe, build_text
from ..sources.readers import raw_shards, shape_stories, shard_options


#: The files that are present when a stream is built take about so many triggers, and no more.
MOST_TRIGGERS = 8


def _trigger_files(spark: SparkSession, folder: str, files_per_trigger: int) -> int:
    """``files_per_trigger``, or more where the present files would take more than ``MOST_TRIGGERS``.

    A trigger costs its logs, plans and state commits however few rows it has. Their number must not grow with the table.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    present = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getFileCount()
    return max(files_per_trigger, -(-present // MOST_TRIGGERS))


def stream_tables(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive, oldest first, ``files_per_trigger`` (or a share of a large folder) at a time."""
    files = _trigger_files(spark, folder, files_per_trigger)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_story_shards(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Parsed rows of JSON-array shards as they arrive; ``write_texts`` makes stories of them."""
    files = _trigger_files(spark, folder, files_per_trigger)
    return raw_shards(shard_options(spark.readStream).option("maxFilesPerTrigger", files).json(folder))


def write_texts(stream: DataFrame, recipe: str | Recipe, path: str, checkpoint: str, seed: int = 0):
    """Append rendered text of every new story; runs until the present files are used up.

    Shard rows get the ids that a batch read gives them. A trigger writes a folder of its own and
    replaces it when it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        # the shards of a trigger are a share of the driver's listing
        found = shape_stories(batch, shards=0) if "_corrupt_record" in batch.columns else batch
        build_text(found, recipe, seed).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_rows(stream: DataFrame, path: str, checkpoint: str):
    """Append the rows of a stateless stream to a growing table."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
