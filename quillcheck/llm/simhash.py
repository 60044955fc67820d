"""SimHash near-dedup with BK-trees (operator 9).

A fingerprint has a bit set where more than half of a text's shingle hashes have it set. Fingerprints link
when they differ in ``radius`` bits or fewer. Distinct fingerprints are dealt to shards by parts
of their bits, and each shard is a BK-tree: a child hangs from its parent by their integer
Hamming distance, and a search follows only edges within the radius of its own distance. With the bits in
m blocks, two fingerprints that link are equal in m - radius blocks at least; a shard is the fingerprints that are
equal in one such choice of blocks, so no link is lost. There are more blocks for more fingerprints, which keeps shards
small at any size. A tree goes to its probes by a shuffle and not by a broadcast, as trees grow with the
input. A shard sends the links of a spanning forest, one per fingerprint at most, never all pairs;
a very full shard is dealt to pairs of blocks of fingerprints, each a tree of its own.

The pipeline's stage takes such links as candidates only, and compares the shingle sets before a document goes.

Defined results: a null, empty or blank text has the fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle; a text of any length is read whole; repeated rows come back as often as they are (as near
copies one of them stays); of ties the smallest doc_id is first, null last; an empty table
gives an empty result; a component of null doc_ids only has a null component_id; other columns are ignored or, by ``near_dedup``, passed
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, unused
from .graph import components

_HASH = partial(xxhash.xxh64_intdigest, seed=42)
#: A shard with more fingerprints is dealt to pairs of blocks of about this many.
FULL = 2048
_STEP = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made from a hash (splitmix64); the 0th is the hash itself."""
    if not k:
        return h
    z = h + np.uint64(_STEP * k % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The hash of each run of ``shingle`` words, as often as it occurs."""
    w = (text or b"").lower().split()
    count = max(1, len(w) - shingle + 1) if w else 0
    return np.fromiter((_HASH(b" ".join(w[i : i + shingle])) for i in range(count)), np.uint64, count)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """``words`` times 64 bits, the most significant first."""
    count = len(hashes)
    if not count:
        return bytes(8 * words)
    sums = np.zeros(64 * words, np.int64)
    for at in range(0, count, 8192):
        part = hashes[at : at + 8192]
        wide = np.stack([_mixed(part, k) for k in range(words)], 1).astype(">u8") if words > 1 else part.astype(">u8")
        sums += np.unpackbits(wide.view(np.uint8)).reshape(len(part), -1).sum(0, dtype=np.int64)
    return np.packbits(sums * 2 > count).tobytes()


def simhash(text: bytes | None, shingle: int = 3, words: int = 1) -> bytes:
    """The fingerprint of a text."""
    return fingerprint(shingles(text, shingle), words)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (binary) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [simhash(t.as_py(), shingle) for t in batch.column(1)]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, fp binary")


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, x: int) -> list[int]:
        """Places of the values within the radius of ``x``, which then joins the tree."""
        values, edges, radius = self.values, self.edges, self.radius
        found: list[int] = []
        if values:
            todo = [0]
            while todo:
                at = todo.pop()
                d = (values[at] ^ x).bit_count()
                if d <= radius:
                    found.append(at)
                below = edges[at]
                if len(below) > 2 * radius + 1:
                    todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
                else:
                    todo += [c for k, c in below.items() if d - radius <= k <= d + radius]
            at = 0
            while True:
                d = (values[at] ^ x).bit_count()
                below = edges[at].get(d)
                if below is None:
                    edges[at][d] = len(values)
                    break
                at = below
        values.append(x)
        edges.append({})
        return found


def forest(fps: list[bytes], radius: int, size: int | None = None) -> list[tuple[bytes, bytes]]:
    """Links that join whatever is linked among these fingerprints, one less than each group has members.

    ``size``: how many of the first bytes count for the distance; None for all.
    """
    tree, root = BKTree(radius), list(range(len(fps)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, fp in enumerate(fps):
        for j in tree.add(int.from_bytes(fp[:size], "big")):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(fps[i], fps[top(i)]) for i in range(len(fps)) if root[i] != i]


def masked(mask: int) -> Column:
    """The bits of a fingerprint of 64 bits that a mask has, as a long."""
    word = lambda at: F.conv(F.hex(F.substring("fp", at, 4)), 16, 10).cast("long")
    return F.shiftleft(word(1).bitwiseAND(mask >> 32), 32).bitwiseOR(word(5).bitwiseAND(mask & 0xFFFFFFFF))


def links(fps: DataFrame, radius: int, parts: list[Column], full: int = FULL, *, size: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints that agree in one of ``parts``; ``size`` as in ``forest``."""
    values = F.array(*parts)
    rows = fps.select("fp", F.posexplode(values).alias("band", "value"))
    sizes = rows.groupBy("band", "value").count().where(F.col("count") > full)
    sizes = stage(sizes.select(F.col("band").alias("b"), F.col("value").alias("v"), F.ceil(F.col("count") / full).cast("int").alias("blocks")), "full-shards")
    if sizes.isEmpty():
        rows = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        rows = rows.join(sizes, (rows.band == sizes.b) & (rows.value == sizes.v), "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
        rows = rows.withColumn("own", own).select("fp", "band", "value", "own", other)
        rows = rows.select("fp", "band", "value", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            fp, band, value, pair = (batch.column(i).to_pylist() for i in range(4))
            for f, *k in zip(fp, band, value, pair, strict=True):
                if k == key:
                    held.append(f)
                    continue
                if len(held) > 1:
                    out += forest(held, radius, size)
                key, held = k, [f]
            if out:
                yield _links(out)
        if len(held) > 1 and (out := forest(held, radius, size)):
            yield _links(out)

    dealt = rows.repartition("band", "value", "pair").sortWithinPartitions("band", "value", "pair", "fp")
    return dealt.select("fp", "band", "value", "pair").mapInArrow(run, "a binary, b binary")


def _links(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["a", "b"])


def masks(radius: int, n: int, bits: int = 64, most: int = 64) -> list[int]:
    """Masks such that two fingerprints within the radius agree under one of them at least.

    The bits are cut into blocks; each mask is a choice of all blocks but as many as the radius. Of ``n`` even fingerprints
    about ``most`` or fewer agree under a mask, as far as three blocks more than the radius reach.
    """
    for count in range(radius + 1, radius + 4):
        cuts = [bits * i // count for i in range(count + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        chosen = [sum(c) for c in combinations(blocks, count - radius)]
        if n >> min(m.bit_count() for m in chosen) <= most:
            break
    return chosen


def least_of(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component_id (the smallest ``least`` that edges reach) of each row of ``fps`` (fp, least)."""
    if edges.isEmpty():
        return fps.select("fp", F.col("least").alias("component_id"))
    named = components(edges)
    tagged = fps.join(named, fps.fp == named.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    tagged = stage(tagged, "tagged")
    least = tagged.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "of")
    least = stage(least, "least")
    return stage(tagged.join(least, tagged.label == least.of).select("fp", "component_id"), "groups")


def near_groups(rows: DataFrame, radius: int) -> DataFrame:
    """fp, component_id of each distinct fingerprint of ``rows`` (doc_id, fp)."""
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    return least_of(fps, stage(links(fps.select("fp"), radius, [masked(m) for m in masks(radius, fps.count())]), "links"))


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id that links reach) of every row."""
    rows = stage(fingerprints(docs, shingle), "doc-fps")
    groups = near_groups(rows, radius).withColumnRenamed("fp", "of")
    return rows.join(groups, rows.fp == groups.of).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Near copies share this much of their five-word shingles, as common and all: a Jaccard similarity of 0.8 or more.
ALIKE = (4, 5)
#: Candidates: eight fingerprints side by side, in which texts at 0.8 differ in 78 of 512 bits with a deviation of 8 (very short
#: ones in up to 96), so that the radius holds them all but for one in 100,000 (of very short ones). They must share one of
#: BANDS keys, each of ROWS minima of the shingles' hashes; at 0.8 that fails with probability (1 - 0.8 ** 4) ** 24 = 0.000003.
WIDE = {"shingle": 5, "words": 8, "radius": 136}
BANDS, ROWS = 24, 4
#: A group of more candidates is dealt to pairs of blocks of about this many, as their texts are compared.
BLOCK = 256
_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 1) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """Of each band, a hash of the least hashes under ROWS orders; two sets share a key with probability Jaccard ** ROWS."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 8192):
        least = np.minimum(least, (hashes[at : at + 8192] * _FACTORS[:, None]).min(1))
    return np.array([_HASH(x.tobytes()) for x in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are near copies."""
    common, every = ALIKE
    if min(len(a), len(b)) * every < max(len(a), len(b)) * common:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same * every >= (len(both) - same) * common


def set_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, tie (a hash of the text), fp (wide fingerprint and the shingle set's digest) and band keys of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, keys = [], []
        for t in batch.column(2):
            # Each shingle once, as the sets have it; a shingle that repeats would outweigh the others.
            own = np.unique(shingles(t.as_py(), shingle))
            fps.append(fingerprint(own, words) + xxhash.xxh3_128_digest(own.tobytes()))
            keys.append(band_keys(own))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tie", "fp", "keys"])

    return map_batches(_tied(docs), run, "doc_id long, tie long, fp binary, keys array<long>")


def _tied(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))


def alike_links(texts: DataFrame, shingle: int, radius: int, size: int) -> DataFrame:
    """Links (a, b) that join what is linked within each group of ``texts`` (label, blocks, fp, text), by the sets themselves."""
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("own")
    rows = texts.select("label", "blocks", "fp", "text", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("label", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, root, held = None, BKTree(radius), [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for label, one, two, own, fp, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (label, one, two) != key:
                    key, tree, root, held = (label, one, two), BKTree(radius), [], []
                mine = np.unique(shingles(text, shingle))
                near = tree.add(int.from_bytes(fp[:size], "big"))
                root.append(len(held))
                held.append((fp, own, mine))
                for j in near:
                    # Two of one block are compared where that block is alone.
                    a, b = top(len(held) - 1), top(j)
                    if a != b and (one == two or held[j][1] != own) and alike(mine, held[j][2]):
                        root[max(a, b)] = min(a, b)
                        out.append((fp, held[j][0]))
            if out:
                yield _links(out)

    dealt = rows.repartition("label", "one", "two").sortWithinPartitions("label", "one", "two", "own", "fp")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_copies(docs: DataFrame, shingle: int, words: int, radius: int) -> DataFrame:
    """doc_id, tie and least (none, doc_id, tie: the first row that links of near copies reach, null doc_ids last) of every row."""
    rows = stage(set_prints(docs, shingle, words), "doc-prints")
    # Texts with the same shingles have the same fp, and one row stands for them.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    sets = stage(rows.groupBy("fp").agg(F.min(row).alias("least"), F.first("keys").alias("keys")), "sets")
    near = stage(links(sets.select("fp", "keys"), radius, [F.col("keys")[i] for i in range(BANDS)], size=8 * words), "near-links")
    groups = components(near)
    blocks = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).withColumnRenamed("label", "of")
    some = stage(groups.join(blocks, groups.label == blocks.of).select("node", "label", "blocks"), "candidates")
    some = some.join(sets, some.node == sets.fp).select("label", "blocks", "fp", F.col("least.doc_id").alias("id"), F.col("least.tie").alias("row_tie"))
    some, texts = stage(some, "candidate-rows"), _tied(docs)
    texts = texts.join(some, texts.doc_id.eqNullSafe(some.id) & (texts.tie == some.row_tie)).select("label", "blocks", "fp", "text").dropDuplicates(["fp"])
    edges = stage(alike_links(texts, shingle, radius, 8 * words), "links")
    named = least_of(sets.select("fp", "least"), edges).withColumnRenamed("fp", "of")
    return rows.join(named, rows.fp == named.of).select("doc_id", "tie", F.col("component_id").alias("least"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest doc_id (null last, ties by the text's hash).

    Rows are told apart by doc_id and text; of rows that have both in common and stay, one stays.
    """
    one, tie, mark = unused(docs.columns, "of_id", "of_tie", "tie")
    found = near_copies(docs, **(WIDE | options)).select(F.col("doc_id").alias(one), F.col("tie").alias(tie), F.col("least").alias("first"))
    found = stage(found, "near-groups")
    first = F.col(one).eqNullSafe(F.col("first.doc_id")) & (F.col(tie) == F.col("first.tie"))
    # Written out, so that Spark knows its size when it chooses between a broadcast and a shuffle of the texts.
    gone = stage(found.where(~first).select(one, tie).distinct(), "gone")
    rows = docs.withColumn(mark, F.xxhash64(docs["text"]))
    same = lambda other: rows["doc_id"].eqNullSafe(other[one]) & (rows[mark] == other[tie])
    stay = rows.join(gone, same(gone), "left_anti")
    twice = stage(found.where(first).groupBy(one, tie).count().where("count > 1").select(one, tie), "repeated")
    if twice.isEmpty():
        return stay.drop(mark)
    single = stay.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", mark])
    return stay.join(twice, same(twice), "left_anti").unionByName(single).drop(mark)
