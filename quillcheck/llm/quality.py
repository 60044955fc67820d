"""A quality classifier from pairwise preferences (operator 3).

Bradley-Terry: of two labelled documents, that with label 1 is preferred with probability
sigmoid(score difference); the score is linear in features of the whole text, learned by logistic loss on
pairs. The threshold is the quantile of the labelled scores at the share of label 0. The fit, its means and
the threshold use every labelled row and every pair of rows with different labels; all documents are
scored. Labels, lang, source and doc_id are no features.

Defined results: a null text counts as empty and is scored, as is one of any length, whole; a null label doesn't count, nor does
a doc_id with both labels; without both labels the score is the share of label 1, or 0.5 without labels; rows that repeat get equal scores,
and ties at the threshold are kept (a score of 0.5 is label 1); an empty table gives an empty result; other columns are passed through or
ignored, whatever their names, but for one with the name of the score, which is replaced.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stage, unused

_DENSE = 12


def features(text: bytes | None) -> np.ndarray:
    """Shares of bytes on a log scale, and measures of words, lines, case and repetition."""
    raw = text or b""
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32)
    n = max(1, len(raw))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()
    marks = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
    count = max(1, len(words))
    dense = [
        math.log1p(len(raw)),
        len(raw) / count if words else 0.0,
        math.log1p(max(map(len, words), default=0)),
        len(set(words)) / count,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(raw) / max(1, len(lines))),
        float(letters / n),
        float(marks / n),
        float(hist[65:91].sum() / max(1.0, letters)),
        float(hist[48:58].sum() / n),
        len(zlib.compress(raw, 1)) / n,
        1.0 if not words else 0.0,
    ]
    return np.concatenate([np.array(dense, np.float32), np.log1p(hist * np.float32(1000 / n))])


@dataclass(frozen=True)
class Ranker:
    """A linear score of standardised features, and the threshold that stands for 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = _standard(x, self.mean, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -50, 50)))


#: Learned rows to a block, and how many blocks are fitted on the driver; more are read where they are.
BLOCK = 256
LOCAL_BLOCKS = 32
#: Grid points to a unit of score, for the sums over pairs.
_GRID = 64
#: Sums are kept as whole multiples of 1 / _UNIT.
_UNIT = 1 << 60

#: A block as arrays: the labels, and a row of numbers for each.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _sums(rows: Iterable[tuple[bytes, bytes]], part: Part, kind: type) -> dict[int, int]:
    sums: dict[int, int] = {}
    for y, x in rows:
        label = np.frombuffer(y, np.uint8)
        for k, v in zip(*(a.tolist() for a in part(label, np.frombuffer(x, kind).reshape(len(label), -1)))):
            sums[k] = sums.get(k, 0) + int(v * _UNIT)
    return sums


def _total(blocks: DataFrame | list, part: Part, kind: type = np.float32) -> dict[int, float]:
    """What ``part`` gives for each block (keys, values) added up by key, in whole numbers: the same in whatever order blocks come."""
    if isinstance(blocks, list):
        found = [_sums(blocks, part, kind)]
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((y.as_py(), x.as_py()) for batch in batches for y, x in zip(batch.column(0), batch.column(1)))
            yield pa.record_batch([pa.array([json.dumps(_sums(rows, part, kind))])], ["sums"])

        found = [{int(k): v for k, v in json.loads(r.sums).items()} for r in blocks.select("y", "x").mapInArrow(run, "sums string").collect()]
    out: dict[int, int] = {}
    for sums in found:
        for k, v in sums.items():
            out[k] = out.get(k, 0) + v
    return {k: v / _UNIT for k, v in out.items()}


def _vector(blocks: DataFrame | list, width: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    at = np.arange(width)
    got = _total(blocks, lambda y, x: (at, of(y, x)))
    return np.array([got[k] for k in range(width)])


def _pair_tables(mass: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """From each label's share of rows at the grid's points (mass[label]): the mean loss over all pairs, and at each point the mean pull of label 0 on a
    row of label 1 there, and of label 1 on a row of label 0. Sums over pairs are convolutions."""
    n = mass.shape[1]
    gap = np.arange(-n + 1, n) / _GRID
    size = 1 << (3 * n).bit_length()

    def over(kernel: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(kernel, size) * np.fft.rfft(weights, size), size)[n - 1 : 2 * n - 1]

    # gap: by how much a point is above the other row's; label 1 below label 0 is what costs.
    loss = over(np.logaddexp(0, -gap), mass[0]) @ mass[1]
    return float(loss), over(1 / (1 + np.exp(np.clip(gap, -500, 500))), mass[0]), over(1 / (1 + np.exp(np.clip(-gap, -500, 500))), mass[1])


class _Pairs:
    """The logistic loss of every (label 1, label 0) pair of the learned rows, and its gradient, as a function of the weights.

    A row's score stands for its two neighbours on a grid, in proportion; that moves a pair's pull by 0.00001 at most.
    """

    def __init__(self, blocks: DataFrame | list, mean: np.ndarray, scale: np.ndarray, count: tuple[int, int], decay: float):
        self.blocks, self.mean, self.scale, self.count, self.decay = blocks, mean, scale, count, decay

    def loss(self, w: np.ndarray) -> tuple[float, tuple]:
        mean, scale = self.mean, self.scale

        def part(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = _standard(x, mean, scale) @ w * _GRID
            at = np.floor(s)
            key = at.astype(np.int64) * 2 + y
            keys, back = np.unique(np.concatenate([key, key + 2]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([1 - (s - at), s - at]))

        got = _total(self.blocks, part)
        keys = np.array(sorted(got))
        low = int(keys[0] >> 1)
        mass = np.zeros((2, int(keys[-1] >> 1) - low + 1))
        mass[keys & 1, (keys >> 1) - low] = [got[int(k)] for k in keys]
        loss, up, down = _pair_tables(mass / np.array(self.count)[:, None])
        return loss + self.decay / 2 * float(w @ w), (low, up, down)

    def gradient(self, w: np.ndarray, tables: tuple) -> np.ndarray:
        mean, scale, (low, up, down) = self.mean, self.scale, tables
        n, grid = sum(self.count), np.arange(low, low + len(up))
        bad, good = (n / c for c in self.count)

        def of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = _standard(x, mean, scale)
            s = z @ w * _GRID
            return np.where(y == 1, -good * np.interp(s, grid, up), bad * np.interp(s, grid, down)) @ z

        return _vector(self.blocks, len(w), of) / n + self.decay * w


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _descend(pairs: _Pairs, width: int, steps: int = 300, near: float = 1e-4, kept: int = 20) -> np.ndarray:
    """Weights of the least loss, by L-BFGS: until no part of the gradient is above ``near``."""
    w, past = np.zeros(width), []
    loss, tables = pairs.loss(w)
    g = pairs.gradient(w, tables)
    for _ in range(steps):
        if np.abs(g).max() <= near:
            break
        d, pulls = -g, []
        for s, y in reversed(past):
            pulls.append((s @ d) / (s @ y))
            d = d - pulls[-1] * y
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, y), pull in zip(past, reversed(pulls)):
            d = d + (pull - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            new, (lost, tables) = w + step * d, pairs.loss(w + step * d)
            if lost <= loss + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        if lost >= loss:
            break
        slope = pairs.gradient(new, tables)
        if (new - w) @ (slope - g) > 1e-12:
            past = [*past, (new - w, slope - g)][-kept:]
        w, loss, g = new, lost, slope
    return w


def _least(scores: DataFrame | list, enough: Callable[[int, int], bool]) -> tuple[float, int]:
    """The least score at which ``enough`` holds of the rows up to it (of label 0, of label 1), and how many rows are below it; exact."""
    prefix, below = 0, [0, 0]
    for shift in (48, 32, 16, 0):

        def part(y: np.ndarray, s: np.ndarray, shift=shift, prefix=prefix) -> tuple[np.ndarray, np.ndarray]:
            bits = s[:, 0].view(np.uint64)
            # Whole numbers in the order of the scores, sixteen bits at a time.
            key = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
            here = key >> np.uint64(shift)
            keys = (here.astype(np.int64) & 0xFFFF) * 2 + y
            return np.unique(keys[here >> np.uint64(16) == prefix] if shift < 48 else keys, return_counts=True)

        got = _total(scores, part, np.float64)
        for digit in sorted({k >> 1 for k in got}):
            more = [int(got.get(2 * digit + y, 0)) for y in (0, 1)]
            if enough(below[0] + more[0], below[1] + more[1]):
                break
            below = [below[0] + more[0], below[1] + more[1]]
        prefix = prefix << 16 | digit
    bits = prefix ^ (1 << 63) if prefix >> 63 else prefix ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0]), sum(below)


def _threshold(scores: DataFrame | list, count: tuple[int, int], labels: tuple[int, int]) -> float:
    """The middle between the two scores around the share of label 0, where each label's rows stand for its share of all labels."""
    (bad, good), (zeros, ones) = count, labels
    high, below = _least(scores, lambda b, g: ones * g * bad + zeros * b * good > zeros * bad * good)
    low = _least(scores, lambda b, g: b + g >= below)[0] if below else high
    return (low + high) / 2


def fit(blocks: DataFrame | list, labels: tuple[int, int], decay: float = 1e-3) -> Ranker:
    """Logistic loss on the score differences of all (label 1, label 0) pairs.

    ``blocks``: rows of a block's labels (y, bytes) and features (x, float32), as a list or a frame; ``labels``: how many labels are 0 and 1.
    """
    width = _DENSE + 256
    found = _total(blocks, lambda y, x: (np.arange(2), np.bincount(y, minlength=2).astype(float)))
    count = int(found.get(0, 0)), int(found.get(1, 0))
    if not all(count):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, labels[1] / sum(labels) if sum(labels) else 0.5)
    mean = _vector(blocks, width, lambda y, x: x.sum(0, dtype=np.float64)) / sum(count)
    scale = np.sqrt(_vector(blocks, width, lambda y, x: ((x - mean) ** 2).sum(0)) / sum(count))
    scale = np.where(scale < 1e-6, 1.0, scale)
    w = _descend(_Pairs(blocks, mean, scale, count, decay), width)

    def score(y: bytes, x: bytes) -> bytes:
        return (_standard(np.frombuffer(x, np.float32).reshape(len(y), -1), mean, scale) @ w + 0.0).tobytes()

    if isinstance(blocks, list):
        return Ranker(mean, scale, w, _threshold([(y, score(y, x)) for y, x in blocks], count, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [score(y.as_py(), x.as_py()) for y, x in zip(batch.column(0), batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["y", "x"])

    scores = stage(map_batches(blocks.select("y", "x"), run, "y binary, x binary"), "scores")
    return Ranker(mean, scale, w, _threshold(scores, count, labels))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features' bytes, of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "x"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, x binary")


def learn(docs: DataFrame, labels: DataFrame, local_blocks: int = LOCAL_BLOCKS) -> Ranker:
    """Fit on all labelled rows of ``labels`` (doc_id, quality); up to ``local_blocks`` blocks of them on the driver."""
    return learn_measured(measured(docs), labels, local_blocks)


def learn_measured(rows: DataFrame, labels: DataFrame, local_blocks: int = LOCAL_BLOCKS) -> Ranker:
    """``learn`` from the rows of ``measured``, which are far smaller than texts, so that they and not the texts are dealt out to meet their labels."""
    clean = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("of"))
    clean = stage(clean.agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("z")).where("y = z").select("of", "y"), "labels")
    counts = {int(r.y): r["count"] for r in clean.groupBy("y").count().collect()}
    number = max(1, -(-sum(counts.values()) // BLOCK))
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y, x = (table.column(c).to_pylist() for c in ("y", "x"))
        return pa.table({"block": table.column("block")[:1], "y": pa.array([bytes(y)]), "x": pa.array([b"".join(x)])})

    # Repeated rows of a doc_id count once.
    got = rows.join(clean, F.col("doc_id") == F.col("of")).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = got.withColumn("block", F.expr(f"pmod(xxhash64(doc_id), {number})"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), number // 256)
    blocks = got.repartition(tasks, "block").groupBy("block").applyInArrow(pack, "block long, y binary, x binary")
    blocks = stage(blocks, "learned")
    return fit([(bytes(r.y), bytes(r.x)) for r in blocks.collect()] if number <= local_blocks else blocks, (counts.get(0, 0), counts.get(1, 0)))


def held_out(doc_id) -> F.col:
    """True for ids whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, ranker: Ranker, name: str = "quality_score") -> DataFrame:
    """``docs`` with the new column ``name``, which replaces one of that name."""
    base = docs.drop(name)
    (raw,) = unused(base.columns, "raw")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t.as_py()) for t in batch.columns[-1]]) if batch.num_rows else np.zeros((0, _DENSE + 256))
        return pa.record_batch([*batch.columns[:-1], pa.array(ranker.scores(x), pa.float64())], [*batch.schema.names[:-1], name])

    return map_batches(base.withColumn(raw, docs["text"].cast("binary")), run, f"{fields}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, name: str = "quality_score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1), learned from the labels that may be learned."""
    may = ~held_out(F.col("doc_id"))
    return scored(docs, learn(docs.where(may), labels.where(may)), name)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; each text is measured once."""
    rows, may = stage(measured(docs), "features"), ~held_out(F.col("doc_id"))
    ranker = learn_measured(rows.where(may), labels.where(may))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
        return pa.record_batch([batch.column(0), pa.array(ranker.scores(x), pa.float64())], ["doc_id", "score"])

    score = F.col("score")
    return map_batches(rows, run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (score >= 0.5).cast("int").alias("predicted"))
