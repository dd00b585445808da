"""WARC archives: a writer, and a sequential reader.

One gzip member holds one record. The reader decompresses incrementally,
frames blocks by their content length and verifies block and payload digests.
Pages of equal payload are stored once; the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, shared_dir

#: A new archive begins once one holds this many compressed bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes read from an archive at once.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is damaged."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return "<urn:page:" + ("null" if page_id is None else str(page_id)) + ">"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def safe_header(value: str) -> str:
    """White space and control characters percent-encoded, as they would end a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {safe_header(url)}"]),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream of chunks."""
    z, parts = None, []
    for chunk in chunks:
        while chunk:
            if z is None:
                z, parts = zlib.decompressobj(31), []
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            if not z.eof:
                break
            yield b"".join(parts)
            chunk, z = z.unused_data, None
    if z is not None:
        raise WarcError("the archive ends within a record")


def headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n")) if k}


def parse(data: bytes) -> dict:
    """One record, its length and digests verified."""
    if not data.startswith(b"WARC/1."):
        raise WarcError("no WARC version line")
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = headers(head.partition(b"\r\n")[2])
    size = int(fields.get("content-length", "-1"))
    if not gap or size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block doesn't end where Content-Length says")
    block = rest[:size]
    if fields.get("warc-block-digest", "") != "sha1:" + base32_sha1(block):
        raise WarcError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = int(headers(http.partition(b"\r\n")[2]).get("content-length", "-1"))
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise WarcError("payload digest or length differs")
    return {
        "page_id": page_of(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of(fields.get("warc-refers-to")) if kind == "revisit" else None,
    }


def records(chunks: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive one after the other."""
    return map(parse, members(chunks))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record for each row of ``pages``; returns (path, records) of the archives written.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page_id is the response. A null html is an empty payload.
    Rows that share that page_id and payload are all responses; a null
    page_id revisits, unless no equal payload has an id. Only digests that
    occur more than once are joined to the pages. A task that is run again
    writes archives of another name; the returned list holds the right ones.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    again = (
        pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    )
    again = maybe_broadcast(materialize(again, "warc-digests"))
    rows = pages.join(again, "digest", "left").select(
        "page_id", "url", "payload", "first",
        (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        stream, path, held, count = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if stream is None:
                    path, held, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = fs.open_output_stream(f"{base}/{path}", compression=None)
                data = member(*(x.as_py() for x in row), date)
                stream.write(data)
                held, count = held + len(data), count + 1
                if held >= ARCHIVE_BYTES:
                    stream.close()
                    done.append((path, count))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return materialize(rows.mapInArrow(run, "path string, records long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read the archives named by ``archives`` in ``folder``: page_id, payload_bytes, payload_digest, record_type, refers_to and url.

    Each archive is read as a stream, CHUNK bytes at a time; one record is
    held, however long its payload, and a damaged one raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for r in records(iter(lambda s=stream: s.read(CHUNK), b"")):
                        rows.append({k: r[k] for k in schema.names})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("path").mapInArrow(run, READ)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type and
    refers_to, one row for each row of ``pages``; none for an empty table.
    Null and empty html are payloads of no bytes; payloads of any length are
    one record. Ties of page_id and payload are all responses; a null
    page_id revisits what has one, else is a response. Other columns are not
    looked at.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, min_bytes), folder).drop("url")
