"""WARC archives: records written in parts, read back as a table of chunks.

Each task streams its pages into one archive in the shared folder, one gzip
member per record, and reports its path; only reported archives are read, so a
task that is run twice leaves nothing double. Reading is a stream too: a record
becomes rows (record, chunk number, bytes), no larger than ``chunk_bytes`` each,
that carry the running length and SHA-1 of the payload; the last one is checked
against the digest in the header.

Equal payloads of at least ``min_revisit_bytes`` are stored once: the record of
the largest page_id is the response, the others are revisits that refer to it.

Defined cases: a null html is an empty payload. Rows that share the largest id of
equal payloads are responses all. Null ids never win, unless a payload has no
other; then its records are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import table
from labelway.session import scratch_path, stage_table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass(frozen=True)
class WarcConfig:
    min_revisit_bytes: int = 0
    chunk_bytes: int = 1 << 20
    level: int = 4


def storage(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_types(pages: DataFrame, cfg: WarcConfig) -> DataFrame:
    """Pages with digest, length, type and, for revisits, the response's id.

    The largest id per digest is a map-side combined maximum over narrow rows;
    payloads move once, to meet the groups of two or more.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= cfg.min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "html", F.unhex("digest").alias("digest"), "payload_bytes",
        F.when(revisit, F.col("response_id")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def header(page_id, url, digest: bytes, length: int, refers_to) -> bytes:
    """Header lines of a record up to the blank line."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%')}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        lines.append(f"Content-Length: {len(HTTP) + length}")
    else:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", "Content-Length: 0"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes one archive per task; (path, records) of each, written when this is evaluated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = storage(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        records, out = 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, length, refers_to = (c[i] for c in batch.columns)
                refers_to = refers_to.as_py()
                out = out or fs.open_output_stream(path, compression=None)
                with gzip.GzipFile("", "wb", cfg.level, out, mtime=0) as member:
                    member.write(header(page_id.as_py(), url.as_py(), digest.as_py(), length.as_py(), refers_to))
                    if refers_to is None:
                        member.write(HTTP)
                        payload = memoryview(html.as_buffer()) if length.as_py() else b""
                        for at in range(0, len(payload), cfg.chunk_bytes):
                            member.write(payload[at : at + cfg.chunk_bytes])
                    member.write(b"\r\n\r\n")
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

    return with_types(pages, cfg).mapInArrow(run, "path string, records long")


def chunks(stream: io.BufferedIOBase, cfg: WarcConfig) -> Iterator[dict]:
    """Rows of the records of one archive, in order."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        if left:
            while True:  # the head of the HTTP message is no payload
                line = stream.readline()
                left -= len(line)
                if not line.strip():
                    break
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        refers_to = fields.get("warc-refers-to")
        row = {
            "record_id": fields["warc-record-id"],
            "record_type": fields["warc-type"],
            "refers_to": refers_to,
            "uri": fields["warc-target-uri"],
            "payload_digest": digest,
        }
        if row["record_type"] == "revisit":
            yield row | {
                "chunk": 0, "data": b"", "bytes_so_far": int(fields["x-payload-length"]),
                "digest_so_far": digest, "last": True,
            }
            continue
        running, done, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, cfg.chunk_bytes)) if left else b""
            if left and not data:
                raise ValueError(f"record cut off: {row['record_id']}")
            left -= len(data)
            done += len(data)
            running.update(data)
            so_far = base32(running.digest())
            if not left and so_far != digest:
                raise ValueError(f"damaged payload: {row['record_id']}")
            yield row | {
                "chunk": number, "data": data, "bytes_so_far": done, "digest_so_far": so_far, "last": not left,
            }
            number += 1
            if not left:
                break


FIELDS = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()),
        ("payload_digest", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ]
)


def read_archives(paths: DataFrame, folder: str, cfg: WarcConfig = WarcConfig(), data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``paths`` (path); ``data=False`` leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = storage(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 18) as raw:
                    for row in chunks(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18), cfg):
                        held += len(row["data"])
                        rows.append(row if data else row | {"data": None})
                        if len(rows) >= 1000 or held >= 4 * cfg.chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, FIELDS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)

    # paths are few bytes but much work: a given number of partitions is not coalesced
    return paths.select("path").repartition(max(1, paths.count()), "path").mapInArrow(
        run,
        "record_id string, record_type string, refers_to string, uri string, payload_digest string, "
        "chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean",
    )


def q_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    written = stage_table(write_archives(table(spark, sf_dir, "pages"), folder), "warc-paths")

    def page(c: str):
        return F.regexp_extract(c, r"urn:x-page:(-?\d+|null)", 1).try_cast("long")

    return read_archives(written, folder, data=False).filter("last").select(
        page("record_id").alias("page_id"),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
