"""The engine's input tables, derived from the sample tables on disk.

A production job reads story shards, run tables and generation tables with
``fablework.sources.readers``. These views give the same schemas from the parquet tables
used for checking: every row and the whole text of each document take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import computed_once, uniform, word_list
from ..operators.ordinals import id_bucket, ordinal

MODEL = "rule-model"
QUESTION = "Q?"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents_table(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, spread over the cores when the scan alone would leave some idle.

    A small file with a single row group is read by one task, which would then do all the
    text work. A large input has more splits than there are cores and stays where it is.
    """
    found = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores, "doc_id") if found.rdd.getNumPartitions() < cores else found


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def stories(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated stories: one per document, the source being the shard.

    Annotations come from the content: the label table, the language, quotes, digits,
    the length and the last character. The summary is the first line; labelled documents
    also carry their last line as the sentence to use.
    """
    documents = documents_table(spark, folder)
    labels = table(spark, folder, "labels")
    lines = F.split("text", "\n", -1)
    return (
        computed_once(documents.join(labels, "doc_id", "left"), "_w", word_list(F.col("text")))
        .select(
            F.col("doc_id").alias("story_id"),
            F.col("source").alias("shard_key"),
            F.col("text").alias("story"),
            F.element_at(lines, 1).alias("summary"),
            F.when(F.col("quality").isNotNull(), F.element_at(lines, -1)).alias("sentence"),
            _present(F.array_min("_w"), F.try_element_at("_w", F.lit(-1)), F.array_max("_w")).alias("words"),
            _present(
                F.when(F.col("quality") == 1, F.lit("Twist")),
                F.when((F.col("lang") == "de") | (F.coalesce("toxic", F.lit(0)) == 1), F.lit("Foreshadowing")),
                F.when(F.contains("text", F.lit('"')) | F.contains("text", F.lit("!")), F.lit("Dialogue")),
                F.when(~F.endswith("text", F.lit(".")), F.lit("BadEnding")),
                F.when((F.col("lang") == "en") & (F.col("n_chars") > 2000), F.lit("MoralValue")),
                F.when(F.col("text").rlike("[0-9]"), F.lit("Conflict")),
            ).alias("features"),
        )
    )


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as ordered word lists."""
    named = documents_table(spark, folder).select(
        F.col("source").alias("shard_key"), F.col("doc_id").alias("story_id"), "text"
    )
    return computed_once(named, "words", word_list(F.col("text"))).drop("text")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """One metric history per user: events in order are the logged iterations."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "ts")
    numbered = ordinal(events, ["user_id"], ["event_id"], [id_bucket(F.col("event_id"))])
    step = F.col("idx") * 10
    return numbered.select(
        F.col("user_id").alias("run_id"),
        step.alias("iter"),
        (F.col("value") / 100).alias("loss_test"),
        F.when(F.col("event_type") == "purchase", step).alias("iter_num_gen"),
        F.when(F.col("event_type").isin("purchase", "view"), F.col("value") / 500).alias("gen_score"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("clock_us"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per user; its last event is its state, its mean value a summary metric."""
    u = F.col("run_id")
    per_user = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("run_id"))
        .agg(
            F.max_by("event_type", "event_id").alias("last_type"),
            (F.max_by("value", "event_id") / 100).alias("final_loss"),
            F.count(F.lit(1)).alias("steps"),
        )
    )
    pick = lambda c, n, *values: reduce(
        lambda acc, iv: acc.when(c % n == iv[0], F.lit(iv[1])), list(enumerate(values))[1:], F.when(c % n == 0, F.lit(values[0]))
    )
    return per_user.select(
        "run_id",
        F.concat(F.lit("base91M-run-"), u.cast("string")).alias("name"),
        F.when(F.col("last_type") == "error", "failed").when(F.col("last_type") == "signup", "crashed").otherwise("finished").alias("state"),
        pick(u, 3, 1e-5, 1e-4, 1e-3).alias("learning_rate"),
        pick(u, 4, "filter-Twist", "filter-adv-Twist", "filter-mix-Twist-Foreshadowing", "specialise-Twist").alias("dataset_name"),
        F.concat(F.lit("/cache/base91M-run-"), (u % 7).cast("string"), F.lit("/out/x")).alias("model_dir"),
        F.array(F.lit("exp2"), F.when(u % 2 == 0, F.lit("deletion")).otherwise(F.lit("recovery"))).alias("tags"),
        F.when(F.col("steps") > 60, F.lit(True)).alias("lr_scheduling"),
        "final_loss",
        "steps",
    )


def deletion_models(spark: SparkSession, folder: str) -> DataFrame:
    """Deletion models: runs 0 to 6 are the ones named in ``model_dir``."""
    found = runs(spark, folder)
    return found.select(
        F.col("name").alias("model"),
        F.col("dataset_name").alias("deletion_dataset"),
        F.col("learning_rate").alias("deletion_lr"),
    )


def generations(spark: SparkSession, folder: str) -> DataFrame:
    """Generation tables: a conversation is a version, a turn is a row."""
    c = table(spark, folder, "conversations")
    tail = F.when(F.col("role") == "assistant", F.lit("\nFeatures: Twist")).otherwise(F.lit(""))
    return c.select(
        F.col("conv_id").alias("version"),
        F.col("turn").alias("row_idx"),
        F.col("role"),
        F.concat("text", tail).alias("generation"),
        (F.col("conv_id") * 300).alias("iter_num"),
    )


def labelled(spark: SparkSession, folder: str, feature: str = "Twist") -> DataFrame:
    from ..operators.predicates import label_by_feature

    return label_by_feature(stories(spark, folder), feature)


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """A raw classifier answer per document, its wording drawn by hash."""
    u = uniform(7, "answer", F.col("doc_id"))
    answer = (
        F.when(u < 0.2, "Yes").when(u < 0.4, " no.").when(u < 0.6, "YES!").when(u < 0.8, "It is unclear").otherwise("Unknown")
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("story_id"),
        F.concat(F.lit("Reason. Q? Perhaps. Q? "), answer).alias("content"),
    )


def probe_logits(spark: SparkSession, folder: str, features: int = 6) -> DataFrame:
    """Probe outputs in long form; each six embedding entries serve as a layer's logits."""
    slots = F.posexplode("embedding")
    flat = table(spark, folder, "embeddings").select("vec_id", "label", slots.alias("slot", "entry"))
    feature = (F.col("slot") % features).cast("int")
    return flat.select(
        F.col("vec_id").alias("example_id"),
        F.floor(F.col("slot") / features).cast("int").alias("layer"),
        feature.alias("feature"),
        (F.col("entry").cast("double") * 10).alias("logit"),
        F.when(F.col("label") % features == feature, 1).otherwise(0).alias("target"),
    )


def class_logits(spark: SparkSession, folder: str) -> DataFrame:
    """One row of class logits per example, with the class as target."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"),
        "label",
    )
