"""WARC archives as a chunked record table.

A row is a piece of the archive's bytes: record number, chunk number, data, and
what an incremental digest has seen of the payload up to the end of this chunk.
The data of a record's chunks in order are the record's bytes in the file
format, end marks included, so a table in (record, chunk) order is a valid
archive. No record is ever built whole: the writer slices the payload it got,
the reader digests chunk after chunk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from itertools import count
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Payload bytes in a chunk; payloads shorter than LEAST are never revisits; bytes of the batches that a task yields.
CHUNK, LEAST, BATCH = 64 << 10, 1000, 8 << 20
#: Bytes that the head of a record in a file may have.
HEAD = 16 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "record long, chunk int, data binary, payload_so_far long, sha1_so_far string, last boolean"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
_NAMES = [f.split()[0] for f in ARCHIVE.split(", ")]


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}/{sha1}'.encode()).digest()[:16], version=5)}>"


def head(page_id: int | None, url: str | None, n: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """The header lines of a record, and those of the HTTP response that it holds."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """The fields of a record and of its HTTP response (prefixed with http:), and where the payload starts."""
    end = data.index(b"\r\n\r\n") + 4
    stop = data.index(b"\r\n\r\n", end) + 4
    fields = {}
    for prefix, part in (("", data[:end]), ("http:", data[end:stop])):
        for line in part.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:  # white space around a value isn't part of it, but a url is given back as it was
                name = name.lower()
                fields[prefix + name] = value.removeprefix(" ") if name == "warc-target-uri" else value.strip()
    return fields, stop


def chunk_rows(record: int, page_id: int | None, url: str | None, payload: memoryview, sha1: str, refers_to: int | None, revisit: bool, size: int) -> Iterator[tuple]:
    """The table rows of one record; each copies no more than a chunk of the payload."""
    if revisit:
        yield record, 0, head(page_id, url, len(payload), sha1, refers_to, True) + b"\r\n\r\n", 0, hashlib.sha1().hexdigest(), True
        return
    digest, n = hashlib.sha1(), len(payload)
    for k, at in enumerate(range(0, max(n, 1), size)):
        part = payload[at : at + size]
        digest.update(part)
        last = at + size >= n
        data = (head(page_id, url, n, sha1, None, False) if not k else b"") + part.tobytes() + (b"\r\n\r\n" if last else b"")
        yield record, k, data, at + len(part), digest.hexdigest(), last


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    for row in rows:
        held.append(row)
        weight += len(row[2]) + 100
        if weight > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=_NAMES)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=_NAMES)


def to_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK, least: int = LEAST) -> DataFrame:
    """The archive (a lazy chunk table) of all rows of pages.

    Null payloads are empty, null urls have no target line, null ids no id line;
    line breaks in a url are percent-encoded.
    Of records with equal payloads of at least `least` bytes that with the
    largest id is the response; rows that repeat its id and payload are
    responses too, all others are revisits of it. Null ids are smallest.
    An empty table gives an empty archive. Other columns aren't looked at.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    own = own.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    big = own.where(F.octet_length("payload") >= least)
    equal = big.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1").select(F.col("sha1").alias("_s"), "first")
    # Stored, so that the join knows its true size; payloads are shuffled only if that is too large to send around.
    rows = own.join(stored(equal, "equal"), F.col("sha1") == F.col("_s"), "left")
    rows = rows.withColumn("revisit", F.col("_s").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).drop("_s")
    rows = rows.withColumn("record", F.monotonically_increasing_id()).select("record", "page_id", "url", "payload", "sha1", "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                payloads = b.column("payload")
                rest = [b.column(n).to_pylist() for n in ("record", "page_id", "url", "sha1", "first", "revisit")]
                for i, (record, page_id, url, sha1, first, revisit) in enumerate(zip(*rest)):
                    yield from chunk_rows(record, page_id, url, memoryview(payloads[i].as_buffer()), sha1, first, revisit, size)

        yield from _batches(each())

    return rows.mapInArrow(run, ARCHIVE)


def _check(fields: dict[str, str], n: int, sha1: str) -> tuple:
    """One row of RECORDS from a record's fields and what its payload chunks came to."""
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    length = int(fields["http:content-length"])
    if kind == "response" and (sha1 != stated or n != length):
        raise ValueError(f"record {fields['warc-record-id']}: {n} bytes with digest {sha1}, not {length} with {stated}")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
    return int(page) if page is not None else None, fields.get("warc-target-uri"), length, stated, kind, int(refers) if refers is not None else None, fields["warc-record-id"]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests chunk after chunk. A record's chunks come one after the other, in order."""
    fields: dict[str, str] = {}
    digest, n, expected, whole = hashlib.sha1(), 0, (None, 0), True
    for b in batches:
        out = []
        datas = b.column("data")
        for i, (record, k, so_far, last) in enumerate(zip(*(b.column(c).to_pylist() for c in ("record", "chunk", "sha1_so_far", "last")))):
            data = memoryview(datas[i].as_buffer())
            if k == 0:
                if not whole:
                    raise ValueError(f"record {expected[0]}: chunk {expected[1]} and what follows are missing")
                fields, at = parse_head(bytes(data))  # the head and a chunk at most
                digest, n = hashlib.sha1(), 0
            else:
                at = 0
                if expected != (record, k):
                    raise ValueError(f"record {record}: chunk {k} doesn't follow")
            expected, whole = (record, k + 1), last
            if last and bytes(data[-4:]) != b"\r\n\r\n":
                raise ValueError(f"record {record}: no end mark")
            part = data[at : len(data) - 4 * last]
            digest.update(part)
            n += len(part)
            if digest.hexdigest() != so_far:
                raise ValueError(f"record {record}: chunk {k} is damaged")
            if last:
                out.append(_check(fields, n, digest.hexdigest()))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])
    if not whole:
        raise ValueError(f"record {expected[0]}: chunk {expected[1]} and what follows are missing")


def read_archive(archive: DataFrame, records: int | None = None) -> DataFrame:
    """Every record of an archive, verified: all chunks there, in order, digests as stated.

    A record that lacks a chunk, its last ones included, is an error when the
    result is read. A record that is missing as a whole leaves no trace in the
    archive: who knows how many were written gives `records`, and another
    number of record ends is an error at once. A record of one chunk is read
    where it lies; only chunks of longer ones are brought together.
    """
    if records is not None and (found := archive.where("last").count()) != records:
        raise ValueError(f"{found} records in the archive, {records} were written")
    single = (F.col("chunk") == 0) & F.col("last")
    long = archive.where(~single).repartition("record").sortWithinPartitions("record", "chunk")
    return archive.where(single).mapInArrow(_records, RECORDS).union(long.mapInArrow(_records, RECORDS))


def write_files(archive: DataFrame, folder: str, files: int = 4) -> None:
    """The archive as `files` files part-n.warc.gz, one gzip member a record, in a folder that all executors reach."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = Path(folder) / f"part-{TaskContext.get().partitionId()}.warc.gz"
        part = path.with_suffix(f".{TaskContext.get().taskAttemptId()}")
        member = None
        with part.open("wb") as raw:
            for b in batches:
                for data, last in zip(b.column("data"), b.column("last").to_pylist()):
                    member = member or gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
                    member.write(memoryview(data.as_buffer()))
                    if last:
                        member.close()
                        member = None
        part.rename(path)  # a second attempt replaces the file by an equal one
        yield pa.RecordBatch.from_arrays([pa.array([str(path)])], names=["path"])

    archive.repartition(files, "record").sortWithinPartitions("record", "chunk").mapInArrow(run, "path string").count()


def _line(f: BinaryIO, path: str, most: int = HEAD) -> bytes:
    """A line of a head with its end; an error where the file or `most` bytes end before it does."""
    line = f.readline(most)
    if not line.endswith(b"\n") and len(line) < most:
        raise EOFError(f"{path} ends within the head of a record")
    return line


def _record_head(f: BinaryIO, path: str) -> tuple[bytes, int]:
    """The next record's head with its empty line, and the length of what follows; nothing at the end of the file."""
    head = f.readline(HEAD)
    if not head:
        return b"", 0
    while not head.endswith(b"\r\n\r\n"):
        if len(head) > HEAD:
            raise ValueError(f"{path}: the head of a record is longer than {HEAD} bytes")
        head += _line(f, path)
    stated = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not stated:
        raise ValueError(f"{path}: a record states no length")
    return head, int(stated[0])


def read_files(spark: SparkSession, paths: list[str], size: int = CHUNK) -> DataFrame:
    """The chunk table of archives in files (.warc or .warc.gz) that all executors reach; each is streamed. A file that is cut short is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for path, first in zip(*(c.to_pylist() for c in b.columns)):
                    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
                        for record in count(first):
                            start, left = _record_head(f, path)
                            if not start:
                                break
                            http = b""
                            while left and not http.endswith(b"\r\n\r\n"):
                                got = _line(f, path, left)
                                http += got
                                left -= len(got)
                            digest, seen = hashlib.sha1(), 0
                            for k in count():
                                part = f.read(min(size, left))
                                if left and not part:
                                    raise EOFError(f"{path} ends within a record")
                                left -= len(part)
                                seen += len(part)
                                digest.update(part)
                                if not left and f.read(4) != b"\r\n\r\n":
                                    raise EOFError(f"{path}: no end mark after a record")
                                yield record, k, (start + http if not k else b"") + part + (b"" if left else b"\r\n\r\n"), seen, digest.hexdigest(), not left
                                if not left:
                                    break

        yield from _batches(each())

    named = spark.createDataFrame([(p, i << 40) for i, p in enumerate(paths)], "path string, first long")
    return named.repartition(max(1, len(paths))).mapInArrow(run, ARCHIVE)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = stored(to_archive(pages), "warc", compression="zstd")
    return read_archive(archive, pages.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")


ORACLE = """
WITH d AS (SELECT page_id, url, sha1(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT s AS fs, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY s HAVING count(*) > 1),
r AS (SELECT d.*, first, fs IS NOT NULL AND page_id IS DISTINCT FROM first AS again, substr(sha1(coalesce(CAST(page_id AS VARCHAR), 'None') || '/' || s), 1, 32) AS u FROM d LEFT JOIN f ON s = fs)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url,
  '<urn:uuid:' || substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(instr('0123456789abcdef', substr(u, 17, 1)) AS BIGINT), 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) || '>' AS record_id
FROM r"""
