"""Folders ``v=N/part=M`` of one JSON document each, written and read by tasks.

There are as many folders as versions, and Spark's own writer and listing pay tens of milliseconds for each of them, the writer's
commit and the list of files on the driver. Here a task makes and opens its files with ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_files import _open

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Folders that a reading task has about, and bytes of text in a batch.
TASK_FOLDERS, BATCH_BYTES = 1000, 8 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a path and the path on it; none where only Spark knows it."""
    try:
        system, place = _open(path)
    except (pa.ArrowException, OSError):
        return None
    return system, place.rstrip("/")


def write_documents(documents: DataFrame, path: str) -> None:
    """Each row ``(v, part, value)`` as a file below ``path``, which is emptied first; a row for each ``(v, part)``.

    A file appears under its name when it is whole, so that a task which runs again, or twice, changes nothing.
    """
    system, root = file_system(path)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            for v, part, value in zip(*(batch[c].to_pylist() for c in ("v", "part", "value"))):
                folder = "/".join([root, *(f"{n}={NO_VALUE if x is None else quote(x)}" for n, x in (("v", v), ("part", part)))])
                system.create_dir(folder, recursive=True)
                attempt = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write(value.encode("utf-8", "surrogatepass") + b"\n")
                system.move(attempt, f"{folder}/table.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    named = documents.select(F.col("v").cast("string"), F.col("part").cast("string"), "value")
    named.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
    system.open_output_stream(f"{root}/_SUCCESS").close()


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def read_documents(spark: SparkSession, folder: str) -> DataFrame | None:
    """``(v, text)`` of each file below the folders ``v=N``; none where the folder holds anything else, or only Spark can open it."""
    at = file_system(folder)
    if at is None or at[0].get_file_info(at[1]).type != fs.FileType.Directory:
        return None
    entries = [x for x in at[0].get_file_info(fs.FileSelector(at[1])) if not _hidden(x.base_name)]
    if not entries or any(x.type != fs.FileType.Directory or not x.base_name.startswith("v=") for x in entries):
        return None
    names = sorted(x.base_name for x in entries)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        versions: list[str | None] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for name in batch["name"].to_pylist():
                top = f"{root}/{name}"
                v = unquote(name[2:])
                for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
                    if info.type != fs.FileType.File or any(map(_hidden, info.path[len(top) :].strip("/").split("/"))):
                        continue
                    with system.open_input_stream(info.path) as file:
                        data = file.read()
                    versions.append(None if v == NO_VALUE else v)
                    texts.append(data.decode(json.detect_encoding(data), "replace"))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield _texts(versions, texts)
                        versions, texts, size = [], [], 0
        yield _texts(versions, texts)

    tasks = min(max(spark.sparkContext.defaultParallelism, -(-len(names) // TASK_FOLDERS)), len(names))
    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())})).repartition(tasks)
    return listed.mapInArrow(read, "v string, text string").select(F.col("v").cast("int").alias("v"), "text")


def _texts(versions: list[str | None], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(versions, pa.string()), pa.array(texts, pa.string())], names=["v", "text"])
