"""Token ids as directly addressable codes, in files with random access to any id (operator 8).

An id is split into chunks of eight bits. Level 0 holds every id's lowest chunk, level k the next chunk of
those ids that need one. A bitmap per level says which chunks have a continuation, and a rank
directory counts the ones before each block of 512 bits: the place of an id's next chunk is the rank of
its bit, so any id is found without decoding the ids before it.

File: magic, number of levels, then per level the number of chunks, the chunks, the bitmap
and its directory. A table beside the files has, for every document, its file, its place there and its
place among the ids of all documents in ascending order of doc_id (null first, ties by the text's hash).
A reader takes byte ranges: neighbouring documents in one, and nothing of the documents between that aren't asked for.

Defined results: a null or empty text is the end id alone; an empty table gives no files and an
empty result; a document longer than a file's usual size ends its file; rows that repeat are documents of
their own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, shared_path, stage, storage
from .tokens import coder, default_path

MAGIC, BLOCK = b"QDAC1\0\0\0", 512
#: Ids to a file, about: what a task holds at a time.
FILE_IDS = 8_000_000
#: Ids between two documents that are read along, and ids that are read at once, about.
GAP_IDS, READ_IDS = 16_384, 1_000_000
_INDEX = "part int, file string, doc_id long, at long, n_tokens long, before long"


def encode(ids: np.ndarray) -> bytes:
    """The file of these ids (unsigned, below 2**32)."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint64)
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + (np.cumsum(ones) - ones).astype("<u8").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<Q", len(levels)) + b"".join(levels)


class Codes:
    """``codes[a:b]`` and ``codes[i]`` of a file, which is its bytes or a function that reads (how many, from where).

    Only the chunks, bits and directory entries that an answer needs are read.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.read = data if callable(data) else lambda n, at: data[at : at + n]
        head = self.read(16, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.levels, at = [], 16
        for _ in range(struct.unpack_from("<Q", head, 8)[0]):
            (n,) = struct.unpack("<Q", self.read(8, at))
            blocks = -(-n // BLOCK)
            self.levels.append((n, at + 8, at + 8 + n, at + 8 + n + blocks * BLOCK // 8))
            at += 8 + n + blocks * (BLOCK // 8 + 8)

    def __len__(self) -> int:
        return self.levels[0][0]

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place ``i``: the directory's entry, and the bits since."""
        n, _, bits, ranks = self.levels[level]
        if not n:
            return 0
        block = min(i, n - 1) // BLOCK
        (before,) = struct.unpack("<Q", self.read(8, ranks + 8 * block))
        since = np.frombuffer(self.read(-(-i // 8) - block * BLOCK // 8, bits + block * BLOCK // 8), np.uint8)
        return before + int(np.unpackbits(since, bitorder="little")[: i - block * BLOCK].sum())

    def __getitem__(self, key: int | slice) -> np.ndarray:
        a, b, _ = key.indices(len(self)) if isinstance(key, slice) else (key, key + 1, 1)
        if not isinstance(key, slice) and not 0 <= key < len(self):
            raise IndexError(key)
        out = np.zeros(max(0, b - a), np.uint32)
        where = np.arange(len(out))
        for k, (_, chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= np.frombuffer(self.read(b - a, chunks + a), np.uint8).astype(np.uint32) << (8 * k)
            own = np.frombuffer(self.read(-(-b // 8) - a // 8, bits + a // 8), np.uint8)
            where = where[np.unpackbits(own, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)]
            if not len(where):
                break
            a = self._rank(k, a)
            b = a + len(where)
        return out


def write(docs: DataFrame, end_id: int = 2, path: str | None = None, parts: int | None = None, folder: str | None = None, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Write the files; the table of documents (columns of ``_INDEX`` and ``start``), and the folder."""
    spark, path = docs.sparkSession, path or default_path()
    folder = folder or shared_path(spark, "dac")
    fs, root = storage(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), coder(path)
        fs, root = storage(folder)
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        docs_: list[tuple[int | None, int, int, int]] = []
        at = before = 0

        def out() -> pa.RecordBatch:
            # Every attempt of a task has file names of its own, and the table names those of the one that counts.
            name = f"part-{part:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(encode(np.frombuffer(b"".join(held), "<u4")))
            n = len(docs_)
            cols = [pa.array([part] * n, pa.int32()), pa.array([name] * n), *(pa.array([d[i] for d in docs_], pa.int64()) for i in range(4))]
            return pa.record_batch(cols, ["part", "file", "doc_id", "at", "n_tokens", "before"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(t.as_py() for t in batch.column(1)), strict=True):
                n = len(ids) // 4 + 1
                held += (ids, end)
                docs_.append((doc, at, n, before))
                at += n
                before += n
                if at >= file_ids:
                    yield out()
                    held, docs_, at = [], [], 0
        if docs_:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = F.col("doc_id").asc_nulls_first(), F.col("tie")
    dealt = rows.repartitionByRange(parts or partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    index = stage(dealt.mapInArrow(run, _INDEX), "dac-index")
    # One row for each partition says how many ids stand in the partitions before it.
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = stage(sums.select(F.col("part").alias("of"), first.alias("first")), "dac-parts")
    return index.join(firsts, index["part"] == firsts["of"]).withColumn("start", F.col("first") + F.col("before")).drop("of", "first"), folder


def runs(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """Sorted (place, length) spans as reads (first, end, how many of the spans): near ones together, up to about ``most``."""
    out: list[list[int]] = []
    for at, n in spans:
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n)
            out[-1][2] += 1
        else:
            out.append([at, at + n, 1])
    return [(a, b, c) for a, b, c in out]


def read(index: DataFrame, folder: str, crc_only: bool = False, gap: int = GAP_IDS, batch_ids: int = READ_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of the index's documents, from the files.

    With ``crc_only``, the ids' checksum (ids_crc32 long) stands for the ids.
    """
    last = "ids_crc32" if crc_only else "ids"
    kind = pa.int64() if crc_only else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage(folder)
        name, f, codes = None, None, None
        for batch in batches:
            files, ats, sizes = (batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))
            done = 0
            while done < len(files):
                end = next((k for k in range(done, len(files)) if files[k] != files[done]), len(files))
                if files[done] != name:
                    if f is not None:
                        f.close()
                    name, f = files[done], fs.open_input_file(f"{root}/{files[done]}")
                    codes = Codes(f.read_at)
                for a, b, count in runs(list(zip(ats[done:end], sizes[done:end], strict=True)), gap, batch_ids):
                    ids = codes[a:b].astype("<u4")
                    found = [ids[at - a : at - a + n].tobytes() for at, n in zip(ats[done : done + count], sizes[done : done + count], strict=True)]
                    own = batch.slice(done, count)
                    cols = [own.column(c) for c in ("doc_id", "start", "n_tokens")]
                    yield pa.record_batch([*cols, pa.array([zlib.crc32(x) for x in found] if crc_only else found, kind)], ["doc_id", "start", "n_tokens", last])
                    done += count
        if f is not None:
            f.close()

    rows = index.select("file", "at", "doc_id", "start", "n_tokens")
    dealt = rows.repartition("file").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if crc_only else 'binary'}")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    return read(*write(docs, **options), crc_only=True)
