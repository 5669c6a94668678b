"""WARC archives: writer and sequential reader (operator 6).

An archive is a file of gzip members, one per record.  The reader walks it with
one incremental zlib decompressor: it takes a bounded piece of the file, ends a
record where its member ends, frames the block by Content-Length and checks
block and payload digests.  Memory holds one record, never a whole archive.

Archives are in the shared folder.  A writer task names its file with a fresh
id and reports it; only reported files are read, so a task that is run again
after a lost executor leaves a stray file at most, never a double record.

Defined results: null HTML is an empty payload; payloads under
``least`` bytes (100) are never revisits; of equal payloads the row with the
smallest page_id is the response, null ids coming last; repeated rows with that
same page_id are all responses.  Empty tables give no archive and no rows.  A very
long page is one record like others.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written

PIECE = 1 << 16
ARCHIVE_BYTES = 256 << 20
SOFTWARE = "quarry"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def members(stream: BinaryIO, piece: int = PIECE) -> Iterator[bytes]:
    """The decompressed gzip members of ``stream``, one at a time."""
    rest = b""
    while True:
        data = rest or stream.read(piece)
        rest = b""
        if not data:
            return
        z, parts = zlib.decompressobj(31), []
        while True:
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            if z.eof:
                rest = z.unused_data
                break
            data = stream.read(piece)
            if not data:
                raise WarcError("archive ends within a gzip member")
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record; the block's length and digest are verified."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers.get("content-length", "-1"))
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} does not frame the block")
    block = rest[:n]
    if headers.get("warc-block-digest", sha256(block)) != sha256(block):
        raise WarcError("block digest differs")
    return headers, block


def read_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    for data in members(stream):
        yield parse_record(data)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>",
        "WARC-Date": "2000-01-01T00:00:00Z",
        # A header is one line: what a URL may hold besides is percent-coded.
        "WARC-Target-URI": "".join(f"%{b:02X}" if b < 33 or b > 126 else chr(b) for b in (url or "").encode()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": sha256(block),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Page-ID": name,
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record_bytes(headers, block)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, payload, digest, size, revisit, refers_to) as archives; returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit", "size")]
            for i in range(b.num_rows):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = page_record(*(c[i].as_py() for c in cols))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit", "size").mapInArrow(write, "path string, records long")


READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(listing: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``listing`` (path, records); raises where digests, frames or counts differ."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_archive(stream):
                        http, payload = http_parts(block)
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"]
                        if kind == "response" and (digest != sha256(payload) or int(http["content-length"]) != len(payload)):
                            raise WarcError(f"payload digest or length differs in {path}")
                        page, refers = headers["warc-page-id"], headers.get("warc-refers-to", "")
                        rows.append((None if page == "null" else int(page), headers["warc-target-uri"], kind, int(http["content-length"]), digest.removeprefix("sha256:"), int(refers[10:-1]) if refers else None, payload if payloads and kind == "response" else None))
                        n, held = n + 1, held + len(payload) * payloads
                        if len(rows) >= 4096 or held > 32 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{path} holds {n} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # One archive per task: each is read from its start.
    return listing.repartition(max(1, min(listing.count(), 10_000))).mapInArrow(read, READ_SCHEMA)


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows to write: payload, its digest and size, and which response a repeat refers to.

    Only (digest, page_id) is grouped, with a combined minimum, and only digests
    that occur twice come back, to rows of ids and digests.  Payloads travel by id
    and digest, so the copies of a page stay apart.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    keys = rows.where(F.col("size") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    repeats = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    repeats = repeats.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    # A missing id joins by a digest that no row has with another id.
    key = lambda i, d: [F.coalesce(i, F.lit(0)), F.when(i.isNull(), F.concat(F.lit("null:"), d)).otherwise(d)]
    match = [a == b for a, b in zip(key(F.col("page_id"), F.col("digest")), key(F.col("_id"), F.col("_digest")), strict=True)]
    rows = rows.join(repeats, match, "left")
    revisit = F.col("first").isNotNull()
    return rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 100, payloads: bool = False) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    listing = written(write_archives(with_revisits(pages, least), folder), "archives")
    out = read_archives(listing, folder, payloads)
    return out if payloads else out.drop("payload")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
