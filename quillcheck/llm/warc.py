"""WARC archives, index first (operator 4).

Each page becomes a gzip member of its own in a WARC file under the shared folder. The index, a table, has for
every record its file, offset, length, URL and digest. Reading selects index rows, sorts them by file and
offset and joins neighbouring byte ranges into one read each. Of records with equal payloads that with
the smallest page_id is a response and the others are revisits of it.

A record's id is made of its file and offset, so repeated rows have records of their own.

Defined results: null html is an empty payload; a null url is empty, and control characters in one are
percent-encoded; rows with the smallest page_id of their payload are all responses, so a repeated row is written
each time; a null page_id comes last, and where a payload has no other, its rows are responses; an empty
table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stage, storage

FILE_BYTES, GAP, READ_BYTES = 64 << 20, 64 << 10, 8 << 20
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, page: int | None, url: str, payload: bytes, digest: str, refers_to: tuple[int, str] | None, date: str) -> bytes:
    """One record, compressed. ``name`` is unlike that of any other record; ``refers_to``: page and URL of the response it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [] if page is None else [f"X-Page-Id: {page}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Target-URI: {_safe(refers_to[1])}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to[0]}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's own header, its HTTP header and what follows that."""
    raw = gzip.decompress(data)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, body = block.split(b"\r\n\r\n", 1)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Write the archives; the index (columns: ``INDEX``) and the folder."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    fs, root = storage(folder)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    small = stage(rows.select("page_id", "url", "sha", F.length("payload").alias("n")), "payload-digests")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    shared = small.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("c"), first.alias("first"))
    shared = stage(shared.where("c > 1").select(F.col("sha").alias("of"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "shared-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    planned = rows.join(shared, rows["sha"] == shared["of"], "left").select("page_id", "url", "payload", refers.alias("refers_to"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, (fs, root) = TaskContext.get().partitionId(), storage(folder)
        out, name, at = None, "", 0
        found: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for page, url, raw, refers_to, first_url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if out is None:
                    # Every attempt of a task writes files of its own; the index names those of the one that counts.
                    name, at = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                body = raw.as_py()
                digest = base32_sha1(body)
                data = record(f"{name}:{at}", page, url, body, digest, None if refers_to is None else (refers_to, first_url), date)
                out.write(data)
                found.append((name, at, len(data), url, digest, page, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
                    yield batch_of()
                    found = []
        if out is not None:
            out.close()
            yield batch_of()

    return stage(planned.mapInArrow(run, INDEX), "warc-index"), folder


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) spans as reads: (offset, length, how many of the spans)."""
    out: list[list[int]] = []
    for at, n in spans:
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([at, n, 1])
    return [(a, b, c) for a, b, c in out]


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of the index's records.

    What comes back is read from the archives; a payload that doesn't fit its digest raises. A revisit's
    payload is null, its length and digest are those of the payload it stands for.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage(folder)
        name, f = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                file = rows[at]["file"]
                end = next((k for k in range(at, len(rows)) if rows[k]["file"] != file), len(rows))
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                for offset, size, count in ranges([(r["offset"], r["length"]) for r in rows[at:end]]):
                    data = f.read_at(size, offset)
                    out = [_row(data[r["offset"] - offset : r["offset"] - offset + r["length"]]) for r in rows[at : at + count]]
                    at += count
                    yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
        if f is not None:
            f.close()

    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / (16 << 20)).alias("part"))
    dealt = rows.repartition("file", "part").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _row(data: bytes) -> tuple:
    head, http, body = parse(data)
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    number = {k: int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    if head["WARC-Type"] == "revisit":
        return number["X-Page-Id"], head["WARC-Target-URI"], "revisit", number["X-Refers-To-Page-Id"], None, int(http["Content-Length"]), digest
    if base32_sha1(body) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
    return number["X-Page-Id"], head["WARC-Target-URI"], "response", None, body, len(body), digest


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, read from its archive."""
    index, folder = write(pages, **options)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
