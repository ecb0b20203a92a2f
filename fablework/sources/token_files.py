"""Token shards as little-endian 16-bit files, read in byte ranges and written with a commit.

A data source of its own: ``spark.read.format("token_bins")`` and ``df.write.format("token_bins")``
after ``register(spark)``. A shard is a file ``<shard>.bin``, or numbered files ``<shard>.00001.bin`` when
it is long, so that no task writes more than ``file_tokens`` tokens. Files are opened by the tasks
with ``pyarrow.fs``, which knows local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)

# Bytes of a token, the end of a file name.
TOKEN_BYTES, ENDING = 2, ".bin"
SCHEMA = "shard_key string, before bigint, total bigint, tokens array<int>"

SPLIT_BYTES = 128 << 20  # that a task reads
PIECE_TOKENS = 1 << 16  # of a row
FILE_TOKENS = 1 << 28  # of a file
_NUMBERED = re.compile(r"(.+)\.(\d{5})$")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A file that can be read at any place."""
    system, place = _open(path)
    return system.open_input_file(place)


def file_name(shard: str, part: int) -> str:
    """File of a part of a shard; part 0 has no number, so a short shard is one plainly named file."""
    if _NUMBERED.match(shard):  # would be taken for a part of another shard
        shard += "%"
    return quote(shard, safe=" %") + (f".{part:05d}" if part else "") + ENDING


def shard_part(name: str) -> tuple[str, int]:
    stem = unquote(name[: -len(ENDING)])
    numbered = _NUMBERED.match(stem)
    shard, part = (numbered[1], int(numbered[2])) if numbered else (stem, 0)
    return (shard[:-1] if shard.endswith("%") and _NUMBERED.match(shard[:-1]) else shard), part


@dataclass
class Range(InputPartition):
    """Bytes ``[first, past)`` of a file; ``before`` tokens of the shard lie ahead of the file."""

    path: str
    shard: str
    before: int
    total: int
    first: int
    past: int

    def __init__(self, path, shard, before, total, first, past):
        super().__init__(None)
        self.path, self.shard, self.before, self.total, self.first, self.past = path, shard, before, total, first, past


class TokenFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES)) // TOKEN_BYTES * TOKEN_BYTES
        self.piece = int(options.get("piece_tokens", PIECE_TOKENS))
        self.shards: set[str] | None = None

    def pushFilters(self, filters):
        """A filter on the shard leaves the files of other shards closed."""
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("shard_key",):
                wanted = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.shards = wanted if self.shards is None else self.shards & wanted
            else:
                yield one

    def files(self) -> dict[str, list[tuple[int, str, int]]]:
        """``(part, path, tokens)`` of each shard, parts in order; a missing part is an error."""
        system, folder = _open(self.folder)
        found: dict[str, list[tuple[int, str, int]]] = {}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.File and info.base_name.endswith(ENDING):
                if info.size % TOKEN_BYTES:
                    raise ValueError(f"{info.base_name} has an odd number of bytes")
                shard, part = shard_part(info.base_name)
                if self.shards is None or shard in self.shards:
                    found.setdefault(shard, []).append((part, info.path, info.size // TOKEN_BYTES))
        for shard, parts in found.items():
            parts.sort()
            if [p[0] for p in parts] != list(range(len(parts))):
                raise ValueError(f"a part of shard {shard} is missing")
        return found

    def partitions(self) -> list[InputPartition]:
        ranges: list[InputPartition] = []
        for shard, parts in sorted(self.files().items()):
            total, before = sum(p[2] for p in parts), 0
            for _, path, tokens in parts:
                size = tokens * TOKEN_BYTES
                ranges += [Range(path, shard, before, total, i, min(i + self.split, size)) for i in range(0, size, self.split)]
                before += tokens
        return ranges or [Range("", "", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.past:
            return
        system, _ = _open(self.folder)
        with system.open_input_file(partition.path) as file:
            at = partition.first
            while at < partition.past:
                size = min(self.piece * TOKEN_BYTES, partition.past - at)
                data = file.read_at(size, at)
                if len(data) != size:
                    raise OSError(f"{partition.path} ends at byte {at + len(data)}, before {partition.past}")
                ids = pa.array(np.frombuffer(data, "<u2").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                start = partition.before + at // TOKEN_BYTES
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.shard]), pa.array([start], pa.int64()), pa.array([partition.total], pa.int64()), lists],
                    names=["shard_key", "before", "total", "tokens"],
                )
                at += size


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they lie and how they will be called."""

    files: list[tuple[str, str]]


class TokenFilesWriter(DataSourceArrowWriter):
    """Tasks write below a folder of their job; the commit moves what they report and drops the rest."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.folder)
        attempt = f"{folder.rstrip('/')}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        files: list[tuple[str, str]] = []
        name, out = None, None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    wanted = file_name(batch["shard_key"][i].as_py(), batch["part"][i].as_py())
                    if wanted != name:
                        if out is not None:
                            out.close()
                        if any(wanted == done for _, done in files):
                            raise ValueError("rows of a file must come one after the other")
                        name, out = wanted, system.open_output_stream(f"{attempt}/{wanted}")
                        files.append((f"{attempt}/{wanted}", wanted))
                    out.write(as_bytes(batch["tokens"][i].values))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.folder)
        folder = folder.rstrip("/")
        system.create_dir(folder, recursive=True)
        old = [i for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.endswith(ENDING)]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.folder} holds token files; use mode overwrite")
        for info in old:
            system.delete_file(info.path)
        for message in messages:
            for path, name in message.files if message else []:
                system.move(path, f"{folder}/{name}")
        self.abort(messages)
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.folder)
        path = f"{folder.rstrip('/')}/{self.job}"
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class TokenFiles(DataSource):
    """``token_bins``: rows ``(shard_key, before, total, tokens)``, a piece of a shard's stream each."""

    @classmethod
    def name(cls) -> str:
        return "token_bins"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenFilesReader:
        return TokenFilesReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenFilesWriter:
        return TokenFilesWriter(self.options, overwrite)


def as_bytes(ids: pa.Array) -> bytes:
    """Ids as little-endian 16-bit numbers; others are an error."""
    values = ids.to_numpy(zero_copy_only=False)
    if ids.null_count or (len(values) and (values.min() < 0 or values.max() > 0xFFFF)):
        raise ValueError("a token id does not fit 16 bits")
    return values.astype("<u2").tobytes()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFiles)


def write_token_bins(stream: DataFrame, folder: str, file_tokens: int = FILE_TOKENS) -> None:
    """Write the token stream of each shard, ``(shard_key, before, tokens)``, as 16-bit files.

    ``before`` is a row's place in the stream (``token_offsets``). A shard is cut into files of
    ``file_tokens``, rows that cross a border in two, and each file is written by one task from sorted rows.
    An older dataset in the folder is replaced when all files are written. Empty shards give no file.
    """
    register(stream.sparkSession)
    size = F.size("tokens").cast("bigint")
    last = F.floor((F.col("before") + size - 1) / F.lit(file_tokens)).cast("bigint")
    first = F.floor(F.col("before") / F.lit(file_tokens)).cast("bigint")
    rows = stream.filter(F.size("tokens") > 0).select(
        "shard_key", "before", F.col("tokens").cast("array<int>").alias("tokens"), F.explode(F.sequence(first, last)).alias("part")
    )
    start = F.greatest(F.col("part") * file_tokens - F.col("before"), F.lit(0).cast("bigint"))
    end = F.least((F.col("part") + 1) * file_tokens - F.col("before"), size)
    cut = rows.select("shard_key", "part", "before", F.slice("tokens", (start + 1).cast("int"), (end - start).cast("int")).alias("tokens"))
    (
        cut.repartition("shard_key", "part").sortWithinPartitions("shard_key", "part", "before")
        .select("shard_key", "part", "tokens").write.format("token_bins").mode("overwrite").save(folder)
    )


def read_token_bins(spark: SparkSession, folder: str, piece_tokens: int = PIECE_TOKENS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Token files as pieces of the stream of each shard: ``(shard_key, before, total, tokens)``.

    A task reads ``split_bytes`` of a file and a row holds ``piece_tokens``, so neither grows with the
    file. Any folder of ``*.bin`` files with 16-bit ids can be read. A filter on ``shard_key`` opens the
    files of these shards only. The rows can be cut into blocks as they are (``blocks.fixed_blocks``,
    ``blocks.bos_blocks`` with ``bos``).
    """
    register(spark)
    options = {"piece_tokens": str(piece_tokens), "split_bytes": str(split_bytes)}
    return spark.read.format("token_bins").options(**options).load(folder)
