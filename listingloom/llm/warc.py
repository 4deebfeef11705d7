"""WARC archives: written as one gzip stream each, then normalised to a member per record with an offset index.

An archive is a row (name, content); tables of archives are written and read by Spark, so a lost task leaves nothing half
done. export() copies the rows to .warc.gz files and their index to .index.jsonl files where files are wanted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.session import hinted, materialize

#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 8 << 20
#: Payloads under so many bytes are never revisits.
LEAST_PAYLOAD = 100
DATE = "1970-01-01T00:00:00Z"
_LEVEL = 2
_NAMESPACE = uuid.UUID("b3f0a2a4-6f0e-4e8c-9a43-0d5c1a6c5d11")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its HTTP header and payload, or a revisit record with the header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {target}')}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
        *([] if refers_to is None else [f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, inflated once and in pieces."""
    data = memoryview(content)
    stream, at = zlib.decompressobj(31), 0
    while at < len(data) or stream.unconsumed_tail:
        given = stream.unconsumed_tail or data[at : at + piece]
        at += 0 if stream.unconsumed_tail else len(given)
        yield stream.decompress(given, piece)
        if stream.eof:
            at -= len(stream.unused_data)
            stream = zlib.decompressobj(31)


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each with its header, block and the two line ends after it."""
    held = bytearray()
    need = None
    for piece in inflated(content):
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                header = bytes(held[:end]).lower()
                length = next(line for line in header.split(b"\r\n") if line.startswith(b"content-length:"))
                need = end + 4 + int(length.split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """A record's fields, its payload, and the length that its HTTP header gives the payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, payload, length


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, count, size = TaskContext.get().partitionId(), 0, 0
    stream, out = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{count:05d}"]), pa.array([b"".join(out) + stream.flush()], pa.binary())], ["name", "content"])

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                out.append(stream.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    count, size = count + 1, 0
                    stream, out = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), []
    if size:
        yield close()


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
            members, index, at = [], [], 0
            for raw in records(content.as_py()):
                member = zlib.compress(raw, _LEVEL, 31)
                members.append(member)
                index.append({"record_id": parse(raw)[0]["WARC-Record-ID"], "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([b"".join(members)], pa.binary()), pa.array([index], pa.list_(entry))], ["name", "content", "index"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, index in zip(batch.column("content"), batch.column("index"), strict=True):
            data, rows = content.as_py(), []
            for e in index.as_py():
                fields, payload, length = parse(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record {fields['WARC-Record-ID']} isn't what was written")
                number = lambda k: int(x) if (x := fields.get(k)) else None  # noqa: B023, E731
                rows.append((number("Page-ID"), length, digest, fields["WARC-Type"], number("Refers-To-Page-ID")))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame) -> DataFrame:
    """(name, content): archives of one gzip stream each, with a record per row of pages.

    Of equal payloads of LEAST_PAYLOAD bytes or more, the record with the smallest page_id is the response. Rows that
    repeat that page_id are responses too; rows without one are revisits if any row with an id has their payload. A null
    html is an empty payload, a null url an empty one. Payloads are written whole, very long ones too; an empty table gives
    no archives. The first pages of repeated payloads are broadcast while they are under BROADCAST_BYTES; beyond that pages
    are shuffled once by their digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    firsts = rows.where(F.col("n") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    found = rows.join(hinted(materialize(firsts, "first-pages")), "digest", "left")
    refers_to = F.when((F.col("page_id") != F.col("first")) | F.col("page_id").isNull(), F.col("first"))
    return found.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).mapInArrow(_write, "name string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(name, content, index): each record its own gzip member, and where each member lies."""
    return archives.select("name", "content").mapInArrow(_normalise, "name string, content binary, index array<struct<record_id:string,offset:long,length:long>>")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read through the index."""
    return archives.select("content", "index").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write normalised archives as files of folder (any file system pyarrow knows) and return their names and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, content, index in zip(*(batch.column(c) for c in ("name", "content", "index")), strict=True):
                data = content.as_py()
                lines = "".join(json.dumps(e) + "\n" for e in index.as_py()).encode()
                for suffix, body in ((".warc.gz", data), (".index.jsonl", lines)):
                    part = f"{base}/{name}{suffix}.{TaskContext.get().taskAttemptId()}"
                    with system.open_output_stream(part, compression=None) as f:
                        f.write(body)
                    system.move(part, f"{base}/{name}{suffix}")
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([len(data)], pa.int64())], ["name", "bytes"])

    return archives.mapInArrow(run, "name string, bytes long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialize(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return read_archives(materialize(normalise(written), "members"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
