"""Line dedup that can be undone: cuckoo filters over exact reference counts (operator 6).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; it is known by its
128-bit BLAKE2b hash. The reference-count table holds, for every key, in how many documents it
is. The filter of a shard holds the keys with ``min_docs`` or more. Adding documents can move keys into
a filter, removing documents can take keys out of it again; then their lines are kept again.

Lines are dropped by one way at every size. Each text sends the keys of its lines to their shards, where the
filter is asked first and its hits are checked against the shard's exact keys; what is hit goes back to its text by a
join. A shard that many lines go to is dealt to several tasks, each with the shard's filter and keys.

Defined results: a null or empty text is one empty line; an empty key is never dropped;
a document that loses all lines becomes an empty text; a repeated row is a document of its own; a text of any
length is split whole; there are no ties; an empty table gives an empty result; other columns are passed through, but for those with
the names of the three new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, unused
from .cuckoo import CuckooFilter
from .exact_dedup import shard_count

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Shards at least.
SHARDS = 64
#: Lines that go to one task of a shard, about.
TASK_LINES = 250_000
CELLS = "shard int, filter binary"


def _hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _hashes(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """Of each line, its key's hash, or None if the key is too short to be dropped."""
    keys = [x.strip(SPACES).lower() for x in (text or b"").split(b"\n")]
    if min_chars <= 1:
        return [_hash(k) if k else None for k in keys]
    return [_hash(k) if len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def line_counts(docs: DataFrame, min_chars: int = 1, most: int = 100_000) -> DataFrame:
    """key, n: documents with the key, summed inside each map task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                for key in set(_hashes(text.as_py(), min_chars)):
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
                if len(counts) > most:
                    yield out()
                    counts = {}
        if counts:
            yield out()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key binary, n long")


def _shard(shards: int):
    """A key's shard, from its last four bytes; the filter reads its first ten."""
    return (F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long") % F.lit(shards)).cast("int")


class LineIndex:
    """Reference counts (``refs``: key, refs) and the shards' filters (``cells``: shard, filter).

    Counts are summed and kept by Spark. A task that changes a filter gets that and the shard's keys with
    ``min_docs`` or more, now or before, from which a filter that overflows is built anew. Without ``shards`` their number
    is chosen by the first insertion, so that a shard has about ``SHARD_KEYS`` such keys at most.
    """

    def __init__(self, refs: DataFrame | None = None, cells: DataFrame | None = None, min_docs: int = 10, min_chars: int = 1, shards: int | None = None):
        self.refs, self.cells, self.min_docs, self.min_chars, self.shards = refs, cells, min_docs, min_chars, shards

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of ``docs`` counted in."""
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of ``docs``, which were inserted before, counted out."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        none = F.lit(0).cast("long")
        counts = line_counts(docs, self.min_chars).select("key", (F.col("n") * sign).alias("change"), none.alias("was"))
        if self.refs is not None:
            counts = counts.unionByName(self.refs.select("key", none.alias("change"), F.col("refs").alias("was")))
        sums = counts.groupBy("key").agg((F.sum("change") + F.sum("was")).alias("refs"), F.sum("was").alias("was"))
        sums = stage(sums.where("refs > 0 or was > 0"), "line-counts")
        least = self.min_docs
        known = sums.where((F.col("refs") >= least) | (F.col("was") >= least))
        shards = self.shards or shard_count(known.count(), SHARDS)
        rows = known.select(_shard(shards).alias("shard"), "key", (F.col("was") >= least).alias("was_in"), (F.col("refs") >= least).alias("is_in"), F.lit(None).cast("binary").alias("filter"))
        if self.cells is not None:
            rows = rows.unionByName(self.cells.select("shard", "filter"), allowMissingColumns=True)

        def apply(group: pd.DataFrame) -> pd.DataFrame:
            is_key = group["key"].notna()
            keys = group[is_key]
            was, now = keys["was_in"].astype(bool), keys["is_in"].astype(bool)
            cells = group.loc[~is_key, "filter"]
            cuckoo = CuckooFilter(len(cells.iloc[0]) // 8, cells.iloc[0]) if len(cells) else CuckooFilter.of(keys.loc[was, "key"])
            for key in keys.loc[was & ~now, "key"]:
                cuckoo.delete(key)
            if not all([cuckoo.insert(key) for key in sorted(keys.loc[now & ~was, "key"])]):
                cuckoo = CuckooFilter.of(keys.loc[now, "key"], cuckoo.buckets * 4)
            return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "filter": [cuckoo.tobytes()]})

        cells = stage(rows.groupBy("shard").applyInPandas(apply, CELLS), "line-filters")
        return LineIndex(sums.where("refs > 0").select("key", "refs"), cells, least, self.min_chars, shards)

    def dropped(self) -> DataFrame:
        return self.refs.where(F.col("refs") >= self.min_docs).select("key")


class _Probe:
    """A shard's filter and its exact keys, as they arrive; which keys are dropped."""

    def __init__(self, cells: bytes):
        self.filter, self.exact = CuckooFilter(len(cells) // 8, cells), set()

    def hits(self, keys: list[bytes]) -> list[int]:
        """Places of the keys that are dropped: the filter first, its hits against the exact keys."""
        words = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        maybe = self.filter.probe(words[:, :8].copy().view("<u8")[:, 0], words[:, 8:10].copy().view("<u2")[:, 0])
        return [i for i in np.flatnonzero(maybe).tolist() if keys[i] in self.exact]


#: What a task of a shard gets, in this order.
_FILTER, _KEY, _LINE = range(3)


def dropped_of(texts: DataFrame, index: LineIndex, task_lines: int = TASK_LINES) -> DataFrame:
    """of (a text's hash) and the keys among its lines that are dropped, for texts (column text, binary) that have some."""
    least, shards = index.min_chars, index.shards

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(of, k) for t in set(batch.column(0).to_pylist()) for of in [_hash(t or b"")] for k in set(_hashes(t, least)) if k is not None]
        return pa.record_batch([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["of", "key"])

    shard = _shard(shards).alias("shard")
    # As many tasks to a shard as its lines ask for; most shards have one, and only the others are listed.
    asked = index.refs.groupBy(shard).agg(F.sum("refs").alias("n")).where(F.col("n") > task_lines)
    full = stage(asked.select(F.col("shard").alias("full"), F.ceil(F.col("n") / task_lines).cast("int").alias("tasks")), "full-shards")
    tasks = F.coalesce("tasks", F.lit(1))
    none = F.lit(None).cast("binary")
    to_all = F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task")
    kept = index.cells.select("shard", F.lit(_FILTER).alias("kind"), F.col("filter").alias("key")).unionByName(index.dropped().select(shard, F.lit(_KEY).alias("kind"), "key"))
    kept = kept.join(full, kept["shard"] == full["full"], "left").select("shard", to_all, "kind", "key", none.alias("of"))
    asks = map_batches(texts, lines, "of binary, key binary").select(shard, F.lit(_LINE).alias("kind"), "key", "of")
    asks = asks.join(full, asks["shard"] == full["full"], "left").select("shard", F.pmod(F.xxhash64("of"), tasks).cast("int").alias("task"), "kind", "key", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, place = None, None
        for batch in batches:
            n = batch.num_rows
            shard, task, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                if a == b:
                    continue
                if (shard[a], task[a]) != place:
                    place, probe = (shard[a], task[a]), None
                keys = batch.column(3).slice(a, b - a).to_pylist()
                if kind[a] == _FILTER:
                    probe = _Probe(keys[0])
                elif kind[a] == _KEY and probe is not None:
                    probe.exact.update(keys)
                elif probe is not None and (at := probe.hits(keys)):
                    yield pa.record_batch([batch.column(4).slice(a, b - a).take(pa.array(at)), pa.array([keys[i] for i in at], pa.binary())], ["of", "key"])

    rows = kept.unionByName(asks).repartition("shard", "task").sortWithinPartitions("shard", "task", "kind")
    hits = rows.select("shard", "task", "kind", "key", "of").mapInArrow(run, "of binary, key binary")
    return hits.groupBy("of").agg(F.collect_set("key").alias("keys"))


def _kept(text: bytes | None, hashes: list[bytes | None], gone) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    stay = [x for x, h in zip(lines, hashes, strict=True) if h is None or h not in gone]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def drop_lines(docs: DataFrame, index: LineIndex, task_lines: int = TASK_LINES) -> DataFrame:
    """``docs`` with the new columns line_count, line_drops and kept_text (binary)."""
    least = index.min_chars
    base = docs.drop("line_count", "line_drops", "kept_text")
    n = len(base.columns)
    raw, own, of, gone = unused(base.columns, "raw", "own", "of", "gone")
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    hits = stage(dropped_of(texts, index, task_lines).select(F.col("of").alias(of), F.col("keys").alias(gone)), "line-hits")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(raw)
        found = pa.array([_hash(t or b"") for t in batch.column(at).to_pylist()], pa.binary())
        return pa.record_batch([*batch.columns[:at], found], [*batch.schema.names[:at], own])

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, g in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
            rows.append(_kept(t, _hashes(t, least), frozenset(g)) if g else ((t or b"").count(b"\n") + 1, 0, t or b""))
        new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        return pa.record_batch([*batch.columns[:n], *new], [*batch.schema.names[:n], "line_count", "line_drops", "kept_text"])

    rows = map_batches(base.withColumn(raw, F.col("text").cast("binary")), named, f"{fields}, `{own}` binary")
    met = rows.join(hits, rows[own] == hits[of], "left")
    met = met.select(*(rows[f"`{c}`"] for c in base.columns), rows["text"].cast("binary").alias(raw), hits[gone])
    return map_batches(met, apply, f"{fields}, line_count long, line_drops long, kept_text binary")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, task_lines: int = TASK_LINES) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or more; see ``drop_lines``."""
    return drop_lines(docs, LineIndex(min_docs=min_docs, min_chars=min_chars).insert(docs), task_lines)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    done = line_dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return done.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_drops").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))
