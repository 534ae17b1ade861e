"""WARC archives, and their records as a table of chunks.

Writing: each task writes gzipped WARC/1.1 files in the shared folder, one gzip member per
record, under names of its own, and returns a manifest row for each file it closed. Only files
of the manifest are read, so what a lost or repeated task left behind does no harm. Of records
with equal payloads of at least min_bytes, the one with the smallest id is a response and the
others are revisits that refer to it and have no payload.

Reading: a file is inflated and parsed as a stream. A payload comes out as rows (record_id,
chunk_no, data) of at most chunk_bytes, each with the length and SHA-1 of the payload so far,
so that no record is ever held whole; the last row of a record has its full digest. A revisit
is one row without data, with the length and digest that its headers carry.

Defined results: a null payload is empty; a null id is written as "-", sorts after others and
comes back null; of rows with equal id and payload one is the response; an empty table gives
an empty archive and an empty result; other columns are ignored; a null url is empty; a very long
payload is one record, written and read in pieces of 64 kB.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import deal, materialize, new_path

CHUNK = 1 << 16
CHUNK_SCHEMA = (
    "record_id string, chunk_no long, page_id long, url string, record_type string, refers_to long, data binary, bytes_so_far long, "
    "digest_so_far string, is_last boolean"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest (hex), revisit and refers_to of each row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    keyed = base.select("page_id", "row", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    keyed = materialize(keyed, "warc-digests")
    first = keyed.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = keyed.join(first.select(F.col("digest").alias("f_digest"), "first"), F.col("digest") == F.col("f_digest")).filter(F.col("row") != F.col("first.row"))
    again = materialize(again.select(F.col("row").alias("r_row"), F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("first_row")), "warc-revisits")
    joined = base.join(again, F.col("row") == F.col("r_row"), "left")
    return joined.select("page_id", "url", "payload", "row", F.col("r_row").isNotNull().alias("revisit"), "refers_to", "first_row")


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}:{row}>"


def _page(record_id: str) -> int | None:
    part = record_id.strip("<>").split(":")[2]
    return None if part == "-" else int(part)


def record_head(page_id, url, row, revisit, refers_to, first_row, n_bytes: int, digest: bytes) -> bytes:
    """WARC and HTTP headers of a record; the payload of a response follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    uri = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, row)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(digest)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, first_row)}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else n_bytes)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    out, path, records, size = None, "", 0, 0

    def closed() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        meta = [columns[n].to_pylist() for n in ("page_id", "url", "row", "revisit", "refers_to", "first_row")]
        for i, payload in enumerate(columns["payload"]):
            if out is None:
                path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(path, compression=None)
            buf = memoryview(payload.as_buffer())
            head = record_head(*(m[i] for m in meta), len(buf), hashlib.sha1(buf).digest())
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            parts = [head] if meta[3][i] else [head, *(buf[k : k + CHUNK] for k in range(0, len(buf), CHUNK))]
            for part in parts:
                size += out.write(gz.compress(part)) or 0
            size += out.write(gz.compress(b"\r\n\r\n") + gz.flush()) or 0
            records += 1
            if size >= file_bytes:
                yield closed()
                out = None
    if out is not None:
        yield closed()


def write_warc(
    pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 1 << 28, level: int = 1, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write archives below folder (a URI that all executors reach) and return the manifest: path, records, bytes."""
    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes)
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return materialize(marked.mapInArrow(lambda b: _write(b, folder, file_bytes, level), "path string, records long, bytes long"), "warc-manifest")


class _Stream:
    """Inflated bytes of a file of gzip members, read in pieces."""

    def __init__(self, raw) -> None:
        self.raw, self.gz, self.buf, self.left = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Add up to CHUNK bytes to buf; false at the end of the file."""
        while True:
            if not self.left:
                self.left = self.raw.read(CHUNK)
                if not self.left:
                    return False
            got = self.gz.decompress(self.left, CHUNK)
            self.left = self.gz.unconsumed_tail
            if self.gz.eof:
                self.left, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if got:
                self.buf += got
                return True

    def head(self) -> list[str] | None:
        """Lines up to an empty line, which is read too; None at the end of the file."""
        while b"\r\n\r\n" not in self.buf:
            if not self.more():
                return None
        head, _, self.buf = self.buf.partition(b"\r\n\r\n")
        return head.decode().split("\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of at most CHUNK."""
        while n:
            if not self.buf and not self.more():
                raise EOFError("the archive ends within a record")
            part, self.buf = self.buf[: min(n, CHUNK)], self.buf[min(n, CHUNK) :]
            n -= len(part)
            yield part


def records(raw, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of an open archive, in the order of CHUNK_SCHEMA."""
    stream = _Stream(raw)
    while (lines := stream.head()) is not None:
        warc = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        name, left = warc["WARC-Record-ID"], int(warc["Content-Length"])
        before = stream.head()
        http = dict(x.split(": ", 1) for x in before[1:] if ": " in x)
        left -= sum(len(x.encode()) + 2 for x in before) + 2
        start = (name, _page(name), warc.get("WARC-Target-URI", ""), warc["WARC-Type"])
        if warc["WARC-Type"] == "revisit":
            digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
            yield name, 0, *start[1:], _page(warc["WARC-Refers-To"]), None, int(http["Content-Length"]), digest, True
        else:
            sha, n, no, held = hashlib.sha1(), 0, 0, b""
            for part in stream.take(left):
                held += part
                while len(held) >= chunk_bytes and n + chunk_bytes < left:
                    data, held = held[:chunk_bytes], held[chunk_bytes:]
                    sha.update(data)
                    n += len(data)
                    yield name, no, *start[1:], None, data if with_data else None, n, base32(sha.digest()), False
                    no += 1
            sha.update(held)
            yield name, no, *start[1:], None, held if with_data else None, n + len(held), base32(sha.digest()), True
        for _ in stream.take(4):
            pass


def _read(batches: Iterator[pa.RecordBatch], folder: str, chunk_bytes: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[tuple] = []
            held = 0
            with store.open_input_stream(path, compression=None) as raw:
                for row in records(raw, chunk_bytes, with_data):
                    rows.append(row)
                    held += len(row[6] or b"") + 200
                    if held >= 1 << 22:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)


def read_chunks(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK, with_data: bool = True, tasks: int = 20_000) -> DataFrame:
    """The chunked record table of the archives in a manifest, a task for each archive, up to `tasks`."""
    files = deal(manifest.select("path"), manifest.count(), tasks)
    return files.mapInArrow(lambda b: _read(b, folder, chunk_bytes, with_data), CHUNK_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from its archive."""
    folder = new_path(pages.sparkSession, "warc")
    chunks = read_chunks(write_warc(pages, folder, min_bytes), folder, with_data=False)
    return chunks.filter("is_last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) || '0' AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((CAST('0x' || substr(h, 5 * i // 4 + 1, 2) AS INTEGER) >> (3 - 5 * i % 4)) & 31) + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
