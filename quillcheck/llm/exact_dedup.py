"""Exact dedup by a sharded cuckoo-filter index of live text digests (operator 5).

A text's digest is the SHA-256 of its UTF-8 bytes without ``[\\x20\\x09-\\x0D]``. Digests go to
shards by their first bytes. A shard keeps a cuckoo filter and, as the content that hits are
checked against, the digests themselves with their reference counts. Rows are counted per
digest inside each map task before they are shuffled, so a group of copies of any size sends
a shard one row per task at most.

A hit's content is its SHA-256 digest, which no two known texts share; the texts themselves are not stored again.

Defined results: a null text counts as empty, as does one of blanks alone; texts of any length are hashed whole; an empty table gives an empty result; of repeated
rows (same text and doc_id) exactly one can be kept; a null doc_id comes after all others
in ties; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage
from .cuckoo import CuckooFilter

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Digests to a shard, about.
SHARD_KEYS = 50_000
INDEX = "shard int, digest binary, refs long, filter binary"


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and length in code points of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [hashlib.sha256((t or b"").translate(None, SPACES)).digest() for t in texts]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "digest", "chars"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
    )
    return map_batches(rows, run, "doc_id long, digest binary, chars long")


def shard_count(n: int, shards: int = 16) -> int:
    """Shards for ``n`` keys, ``shards`` at least: as many as keep each at about ``SHARD_KEYS``, up to 2**30."""
    while shards * SHARD_KEYS < n and shards < 1 << 30:
        shards *= 2
    return shards


def _shard(shards: int):
    """A digest's shard, from its last four bytes; the filter reads its first ten."""
    return (F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long") % F.lit(shards)).cast("int")


def _apply(group: pd.DataFrame) -> pd.DataFrame:
    """One shard: its stored digests and filter, with the batch's insertions and deletions applied."""
    shard = int(group["shard"].iloc[0])
    stored: dict[bytes, int] = {}
    cuckoo = None
    changes = []
    for digest, refs, cells, new in zip(group["digest"], group["refs"], group["filter"], group["new"], strict=True):
        if digest is None:
            cuckoo = CuckooFilter(len(cells) // 8, cells)
        elif new:
            changes.append((digest, int(refs)))
        else:
            stored[digest] = int(refs)
    if cuckoo is None:
        cuckoo = CuckooFilter.of(stored)
    for digest, change in sorted(changes, key=lambda x: -x[1]):
        # A miss is a digest that is not live. A hit is checked against the stored digests.
        if digest in cuckoo and digest in stored:
            stored[digest] += change
            if stored[digest] <= 0:
                del stored[digest]
                cuckoo.delete(digest)
        elif change > 0:
            stored[digest] = change
            if not cuckoo.insert(digest):
                cuckoo = CuckooFilter.of(stored, cuckoo.buckets * 4)
    rows = [(shard, d, n, None) for d, n in stored.items()]
    return pd.DataFrame([*rows, (shard, None, len(stored), cuckoo.tobytes())], columns=["shard", "digest", "refs", "filter"])


class CuckooIndex:
    """Live digests with reference counts, as a DataFrame of shards (columns: ``INDEX``).

    A shard's rows are its digests and one row with a null digest that holds its filter.
    ``insert`` and ``delete`` return a new index and leave the old one as it was.
    """

    def __init__(self, rows: DataFrame | None, shards: int):
        self.rows, self.shards = rows, shards

    def insert(self, digests: DataFrame) -> CuckooIndex:
        """Add every row of ``digests`` (column ``digest``) to the live ones."""
        return self._changed(digests, 1)

    def delete(self, digests: DataFrame) -> CuckooIndex:
        """Take every row of ``digests`` out once; those that are not live are passed over."""
        return self._changed(digests, -1)

    def _changed(self, digests: DataFrame, sign: int) -> CuckooIndex:
        batch = counted(digests).select(
            _shard(self.shards).alias("shard"), "digest", (F.col("refs") * sign).alias("refs"), F.lit(None).cast("binary").alias("filter"), F.lit(True).alias("new")
        )
        rest = None
        if self.rows is not None:
            # Shards that the batch doesn't touch are passed on as they are, without a shuffle or a task of their own.
            batch = stage(batch, "index-changes")
            touched = stage(batch.select(F.col("shard").alias("touched")).distinct(), "touched-shards")
            there = self.rows["shard"] == touched["touched"]
            rest = self.rows.join(touched, there, "left_anti")
            batch = batch.unionByName(self.rows.join(touched, there, "left_semi").withColumn("new", F.lit(False)))
        rows = batch.groupBy("shard").applyInPandas(_apply, INDEX)
        return CuckooIndex(stage(rows if rest is None else rows.unionByName(rest), "cuckoo-index"), self.shards)

    def keys(self) -> DataFrame:
        return self.rows.where("digest is not null").select("digest", "refs")

    def filters(self) -> DataFrame:
        return self.rows.where("digest is null").select("shard", "filter", F.col("refs").alias("n"))


def counted(digests: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows per digest, summed inside a map task; a digest can come once for every ``most`` others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "refs"])

        for batch in batches:
            for d in batch.column(0).to_pylist():
                counts[d] = counts.get(d, 0) + 1
            if len(counts) > most:
                yield out()
                counts = {}
        if counts:
            yield out()

    return digests.select("digest").mapInArrow(run, "digest binary, refs long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest row in code points stays, then that with the smallest doc_id.
    """
    rows = stage(text_digests(docs), "digests")
    index = CuckooIndex(None, shard_count(rows.count())).insert(rows)
    # Groups of one need no election: only digests with more references look for their best row.
    many = stage(index.keys().where("refs > 1"), "copied")
    member = rows.join(many, "digest", "left").withColumn("n", F.coalesce("refs", F.lit(1)))
    member = stage(member.select("doc_id", "digest", "chars", "n"), "members")
    best = (
        member.where("n > 1")
        .groupBy("digest")
        .agg(F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"))).alias("best"))
    )
    best = stage(best.select(F.col("digest").alias("of"), (-F.col("best.c")).alias("best_chars"), F.col("best.d").alias("keep_id")), "best")
    # Equal rows (same digest, doc_id and length) become one with a count, so that one of them stays.
    same = member.where("n > 1").groupBy("digest", "doc_id", "chars", "n").agg(F.count(F.lit(1)).alias("times"))
    same = stage(same, "same")
    joined = same.join(best, F.col("digest") == F.col("of"))
    is_best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars"))
    copied = joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), is_best.alias("best"), "digest", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i"))
    copied = copied.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    single = member.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return single.unionByName(copied)
