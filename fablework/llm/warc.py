"""WARC archives: a writer that stores equal payloads once, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablework.session import fresh_path

from .common import stored

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"

RECORD_SCHEMA = (
    "archive string, record_id string, record_type string, page_id bigint, target_uri string, "
    "payload_bytes bigint, payload_digest string, refers_to_id string, verified boolean"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _one_line(value: str) -> str:
    """A header value without control characters, which would end or break the header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, first_id: int | None, revisit: bool, date: str
) -> bytes:
    """One record as one gzip member; a revisit holds the HTTP header only."""
    digest = base32_sha1(payload)
    http = BREAK.join([
        b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
        b"Content-Length: %d" % len(payload), BREAK,
    ])
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(url) if url else f"urn:page:{page_id}",
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        **({"WARC-Refers-To": _record_id(first_id, digest), "WARC-Profile": PROFILE} if revisit else {}),
        **({"X-Page-Id": str(page_id)} if page_id is not None else {}),
        "Content-Length": str(len(block)),
    }
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers.items()), BREAK]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(BREAK.join(lines) + block + BREAK + BREAK) + packer.flush()


def write_archives(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = 256 << 20,
) -> DataFrame:
    """Write one record a row to ``.warc.gz`` files below ``folder``; returns ``archive, records, bytes``.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, those with the smallest id
    are responses, all others revisits that refer to it; without any id in the group all are
    responses. Smaller payloads are all responses. A null payload is an empty one.

    The smallest id of each payload is found by hash and joined back, where adaptive
    execution splits the task of a payload that very many pages share. Files carry the
    task's attempt in their name and count only when the table of archives lists them, so
    that a task that is lost or runs twice leaves no half-written archive behind.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("hash"),
    )
    firsts = rows.groupBy("hash").agg(F.min("page_id").alias("first_id"))
    large = F.octet_length("payload") >= min_revisit_bytes
    typed = rows.join(firsts, "hash").select(
        "page_id", "url", "payload", "first_id",
        (large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )

    def write(batches):
        context = TaskContext.get()
        stem = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, count, size, number = None, 0, 0, 0
        for batch in batches:
            for page_id, url, text, first_id, revisit in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                data = record_bytes(page_id, url, text.encode("utf-8"), first_id, revisit, date)
                if out is None:
                    path = f"{stem}-{number:05d}.warc.gz"
                    out, count, size, number = _create(path), 0, 0, number + 1
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield _manifest(path, count, size)
        if out is not None:
            out.close()
            yield _manifest(path, count, size)

    return stored(typed.mapInArrow(write, "archive string, records bigint, bytes bigint"), "warc-archives")


def _manifest(path: str, count: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": [path], "records": [count], "bytes": [size]})


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _create(path: str):
    store, inner = _filesystem(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


class RecordError(ValueError):
    """An archive that breaks the format or a digest that does not match."""


def _members(stream, step: int):
    """For each gzip member an iterator over its decompressed chunks; memory is bounded by ``step``."""
    data = stream.read(step)
    while data:
        unpacker = zlib.decompressobj(31)

        def chunks():
            nonlocal data
            while not unpacker.eof:
                if not data:
                    data = stream.read(step)
                    if not data:
                        raise RecordError("the archive ends inside a record")
                part = unpacker.decompress(data, step)
                data = unpacker.unconsumed_tail
                if unpacker.eof:
                    data = unpacker.unused_data
                if part:
                    yield part

        yield chunks()
        if not data:
            data = stream.read(step)


def read_records(stream, step: int = 1 << 20, keep_payload: bool = False):
    """The records of an open archive, in order, as dictionaries.

    Members are decompressed piece by piece; ``Content-Length`` frames the block, whose
    digest and whose payload's digest are computed on the way. ``verified`` is false when one
    of them differs. A broken frame raises ``RecordError``.
    """
    for chunks in _members(stream, step):
        buffer = b""
        while BREAK + BREAK not in buffer:
            more = next(chunks, None)
            if more is None:
                raise RecordError("a record without the end of its header")
            buffer += more
        head, _, rest = buffer.partition(BREAK + BREAK)
        version, *lines = head.split(BREAK)
        if version != VERSION:
            raise RecordError(f"not a record: {version[:40]!r}")
        headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass")
                   for k, _, v in (line.partition(b":") for line in lines)}
        length = int(headers["content-length"])
        block_hash, payload_hash, seen, payload_bytes, http = hashlib.sha1(), hashlib.sha1(), 0, 0, b""
        kept: list[bytes] = []
        in_payload, tail = False, b""
        while rest is not None:
            part, beyond = rest[: length - seen], rest[length - seen :]
            tail += beyond
            if len(tail) > 4:
                raise RecordError("data after the block")
            seen += len(part)
            block_hash.update(part)
            if not in_payload:
                http += part
                if BREAK + BREAK in http:
                    _, _, part = http.partition(BREAK + BREAK)
                    in_payload = True
                else:
                    part = b""
            payload_hash.update(part)
            payload_bytes += len(part)
            if keep_payload and part:
                kept.append(part)
            rest = next(chunks, None)
        if seen != length or tail != BREAK + BREAK:
            raise RecordError("the block is shorter than its Content-Length")
        revisit = headers["warc-type"] == "revisit"
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        own = base64.b32encode(payload_hash.digest()).decode()
        block = base64.b32encode(block_hash.digest()).decode()
        page = headers.get("x-page-id")
        yield {
            "record_id": headers["warc-record-id"], "record_type": headers["warc-type"],
            "page_id": int(page) if page is not None else None, "target_uri": headers.get("warc-target-uri"),
            "payload_bytes": None if revisit else payload_bytes, "payload_digest": digest,
            "refers_to_id": headers.get("warc-refers-to"),
            "verified": block == headers["warc-block-digest"].removeprefix("sha1:") and (revisit or own == digest),
            **({"payload": b"".join(kept)} if keep_payload else {}),
        }


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all files named in ``archive``, a task for each few files.

    A revisit has no ``payload_bytes`` (see ``resolved``). With ``with_payload`` the payloads
    come along, else a record of any size is read in bounded memory. A record whose digest
    doesn't match raises an error.
    """
    schema = RECORD_SCHEMA + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    most = 64 if with_payload else 4096

    def read(batches):
        for batch in batches:
            for path in batch["archive"].to_pylist():
                store, inner = _filesystem(path)
                with store.open_input_stream(inner) as stream:
                    rows: list[dict] = []
                    for record in read_records(stream, keep_payload=with_payload):
                        if not record["verified"]:
                            raise RecordError(f"digest of {record['record_id']} in {path}")
                        rows.append({"archive": path, **record})
                        if len(rows) >= most:
                            yield _records(rows, names)
                            rows = []
                    if rows:
                        yield _records(rows, names)

    files = max(1, archives.count())
    return archives.select("archive").repartition(min(files, 10_000), "archive").mapInArrow(read, schema)


def _records(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names
    )


def resolved(records: DataFrame) -> DataFrame:
    """One row a record with the page that a revisit refers to and the length of its payload.

    Fails when a revisit refers to a response that is not in the archives.
    """
    responses = records.filter(F.col("record_type") == "response").groupBy("record_id").agg(
        F.first("page_id").alias("first_id"), F.first("payload_bytes").alias("first_bytes"), F.lit(True).alias("found")
    )
    # the planner takes the small table of archives for the size of what is read from them
    joined = records.join(
        responses.withColumnRenamed("record_id", "refers_to_id").hint("merge"), "refers_to_id", "left"
    )
    lost = F.raise_error(F.concat(F.lit("no response for "), F.col("record_id"))).cast("bigint")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(~revisit, F.col("payload_bytes")).when(F.col("found"), F.col("first_bytes")).otherwise(lost).alias("payload_bytes"),
        "payload_digest", "record_type",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, **columns: str) -> DataFrame:
    """Write every row of ``pages`` to archives in the shared folder and read them back.

    Nulls: a null payload is empty, a null url becomes ``urn:page:<id>``, a row without id is
    written without one (never the smallest of its group). Repeated rows give a record each; rows
    that share payload and smallest id are all responses. An empty table gives no archive
    and no rows. Other columns are not read.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return resolved(read_archives(write_archives(pages, folder, min_revisit_bytes, **columns)))
