"""Packing into sequences by a configuration linear program (operator 7).

Every document becomes its token ids and an end id; only those longer than a sequence are cut. The driver
sees the histogram of piece lengths alone, which has as many bins as a sequence has places. Long pieces
fall into classes by length. The linear program (fewest sequences over all configurations that fill one) is
solved by multiplicative weights: a class whose coverage lags weighs more, and a knapsack over the weights prices
the next configuration. Its amounts are rounded, and best fit, length by length, places what is left into the
sequences begun and new ones. As the program knows classes and not lengths, its sequences are a little too loose; so in some plans each
configuration's smallest piece is left to best fit, which finds one that fills the place that is really free. Several shares of
the program's solution are tried, with and without that, and none; the plan with the fewest sequences is taken. A piece finds its place by its rank among the pieces of its length. A length that many pieces have
(that of a whole sequence, for one) is dealt to as many buckets as it needs, so no task gets more than about ``BUCKET`` pieces.

Defined results: a null or empty text is the end id alone; a text of any length is cut whole into pieces; repeated rows are documents of
their own; pieces of equal length are in order of doc_id, piece and checksum within their bucket; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .tokens import coder, default_path

#: A sequence's filling: (length, how often) pairs.
Filling = tuple[tuple[int, int], ...]
#: The same by classes of lengths: (class, how often) pairs.
Configuration = tuple[tuple[int, int], ...]
ROUNDS = 1000
#: Classes of the program, and the share of a sequence up to which a piece has none.
GROUPS, SMALLEST = 96, 16
#: Shares of the program's solution that are tried; best fit places the rest.
SHARES = (1.0, 0.9, 0.7, 0.5, 0.35, 0.2, 0.1)
#: Pieces of one length to a bucket, about, and buckets that a length can have.
BUCKET, MOST_BUCKETS = 4_000_000, 1 << 20


def pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a turn whose remainders spread equal lengths evenly."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, turn = coder(path), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            cols: list[list[int | None]] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(t.as_py() for t in batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    turn += 1
                    for col, x in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), turn % MOST_BUCKETS), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, turn int")


def classes(counts: np.ndarray, size: int, groups: int = GROUPS) -> list[tuple[int, int]]:
    """First and last length of each class: long pieces by length, in runs of about equally many pieces.

    Pieces of a ``SMALLEST``-th of a sequence or less have no class; they fill what the program leaves free.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > size // SMALLEST]
    if not len(lengths):
        return []
    have = counts[lengths]
    part = (np.cumsum(have) - have) * groups // have.sum()
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    return [(int(lengths[a]), int(lengths[b - 1])) for a, b in zip(cuts, cuts[1:], strict=False)]


def price(sizes: np.ndarray, worth: np.ndarray, room: int) -> dict[int, int]:
    """The configuration (class: how often) of most worth that fits: an unbounded knapsack over the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ordered, worths = sizes[order], worth[order]
    fits = np.searchsorted(ordered, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            got = best[c - ordered[:n]] + worths[:n]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], last[c] = got[k], k
    out: dict[int, int] = defaultdict(int)
    c = room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[int(order[last[c]])] += 1
            c -= int(ordered[last[c]])
    return out


def program(sizes: np.ndarray, wanted: np.ndarray, room: int, rounds: int = ROUNDS) -> dict[Configuration, float]:
    """Configurations and amounts that nearly cover ``wanted`` pieces of each class with the fewest sequences.

    Multiplicative weights: the amounts sum to the program's lower bound, in equal steps. A class whose coverage lags
    behind the steps done weighs exponentially more, and each step goes to the configuration of most worth.
    """
    total = max(float((sizes * wanted).sum()) / room, float(wanted[2 * sizes > room].sum()))
    rate, seen = 40 * np.log(len(sizes) + 1), np.zeros(len(sizes))
    amounts: dict[Configuration, float] = defaultdict(float)
    for t in range(rounds):
        worth = np.exp(-rate * np.clip(seen - t / rounds, -0.5, 0.5)) / wanted
        chosen = price(sizes, worth, room)
        amounts[tuple(sorted(chosen.items()))] += total / rounds
        for k, n in chosen.items():
            seen[k] += n * total / rounds / wanted[k]
    return amounts


def rounded(amounts: dict[Configuration, float], share: float, wanted: np.ndarray) -> list[tuple[Configuration, int]]:
    """A share of the amounts in whole sequences that the pieces fill, the largest amounts first.

    Amounts are rounded down; then those with the largest remainders get one more, until the share is used up.
    """
    have, times = wanted.astype(np.int64), dict.fromkeys(amounts, 0)

    def take(configuration: Configuration, n: int) -> int:
        n = min([n, *(int(have[k]) // often for k, often in configuration)]) if configuration else 0
        for k, often in configuration:
            have[k] -= n * often
        times[configuration] += n
        return n

    order = sorted(amounts, key=lambda c: (-amounts[c], c))
    left = round(share * sum(amounts.values()))
    for configuration in order:
        left -= take(configuration, int(amounts[configuration] * share))
    for configuration in sorted(order, key=lambda c: int(amounts[c] * share) - amounts[c] * share):
        if left <= 0:
            break
        left -= take(configuration, 1)
    return [(c, times[c]) for c in order if times[c]]


def without_smallest(configuration: Configuration, sizes: np.ndarray) -> Configuration:
    """A configuration of two pieces or more without its smallest one."""
    if sum(often for _, often in configuration) < 2:
        return configuration
    least = min((k for k, _ in configuration), key=lambda k: (sizes[k], k))
    return tuple((k, often - (k == least)) for k, often in configuration if often > (k == least))


def filled(plan: list[tuple[Configuration, int]], kinds: list[tuple[int, int]], left: np.ndarray) -> dict[Filling, int]:
    """The configurations with actual lengths, the longest of each class first, taken out of ``left``."""
    queues = [[[x, int(left[x])] for x in range(a, b + 1) if left[x]] for a, b in kinds]
    out: dict[Filling, int] = defaultdict(int)
    for configuration, n in plan:
        slots = []
        for k in (k for k, times in configuration for _ in range(times)):
            need, runs = n, []
            while need:
                head = queues[k][-1]
                m = min(need, head[1])
                runs.append([head[0], m])
                left[head[0]] -= m
                head[1] -= m
                need -= m
                if not head[1]:
                    queues[k].pop()
            slots.append(runs)
        while n:
            m = min(s[0][1] for s in slots)
            own: Filling = ()
            for s in slots:
                own = _with(own, s[0][0], 1)
                s[0][1] -= m
                if not s[0][1]:
                    s.pop(0)
            out[own] += m
            n -= m
    return out


def best_fit(counts: np.ndarray, size: int, begun: dict[Filling, int] | None = None) -> dict[Filling, int]:
    """Best fit decreasing, all pieces of a length at once, into ``begun`` sequences and new ones, which are kept by free places."""
    free: dict[int, dict[Filling, int]] = defaultdict(dict)
    free_of = np.zeros(size + 1, np.int64)

    def put(room: int, filling: Filling, n: int) -> None:
        free[room][filling] = free[room].get(filling, 0) + n
        free_of[room] += n

    for filling, n in (begun or {}).items():
        put(size - sum(a * b for a, b in filling), filling, n)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            rooms = np.flatnonzero(free_of[length:])
            room = int(rooms[0]) + length if len(rooms) else size
            each = room // length
            if len(rooms):
                filling, n = free[room].popitem()
                free_of[room] -= n
            else:
                filling, n = (), -(-left // each)
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                put(room - each * length, _with(filling, length, each), full)
            if rest:
                put(room - rest * length, _with(filling, length, rest), 1)
            if n - full - bool(rest) and filling:
                put(room, filling, n - full - bool(rest))
            left -= full * each + rest
    out: dict[Filling, int] = defaultdict(int)
    for group in free.values():
        for filling, n in group.items():
            out[filling] += n
    return out


def _with(filling: Filling, length: int, times: int) -> Filling:
    own = dict(filling)
    own[length] = own.get(length, 0) + times
    return tuple(sorted(own.items(), reverse=True))


def solve(counts: np.ndarray, size: int = 2048, rounds: int = ROUNDS) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences have each; every piece of ``counts`` is placed exactly once.

    Of the plans that take different shares of the program's solution, that with the fewest sequences is kept, and of
    equals that with the largest share.
    """
    counts = counts.astype(np.int64)
    plans = []
    if kinds := classes(counts, size):
        unit = max(1, size // 256)
        sizes = np.array([-(-last // unit) for _, last in kinds])
        wanted = np.array([counts[a : b + 1].sum() for a, b in kinds], float)
        # A last length that isn't a multiple of the unit may be rounded to more than a sequence.
        amounts = program(np.minimum(sizes, size // unit), wanted, size // unit, rounds)
        for share in SHARES:
            whole = rounded(amounts, share, wanted)
            for plan in (whole, [(without_smallest(c, sizes), n) for c, n in whole]):
                left = counts.copy()
                begun = filled(plan, kinds, left)
                plans.append(best_fit(left, size, begun))
    plans.append(best_fit(counts, size))
    return sorted(min(plans, key=lambda p: sum(p.values())).items(), reverse=True)


class Places:
    """For each length, where the piece of a given rank goes."""

    def __init__(self, plan: list[tuple[Filling, int]]):
        slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        first = 0
        for filling, n in plan:
            at = 0
            for length, times in filling:
                slots[length].append((times * n, times, first, at))
                at += length * times
            first += n
        self.of = {}
        for length, rows in slots.items():
            a = np.array(rows, np.int64)
            self.of[length] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2], a[:, 3])

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ids and offsets."""
        base, times, first, at = self.of[length]
        k = np.searchsorted(base, ranks, "right") - 1
        i = ranks - base[k]
        return first[k] + i // times[k], at[k] + i % times[k] * length


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = stage(pieces(docs, size, end_id, path), "pieces")
    # As many counts come to the driver as there are lengths, then one for each bucket of ``bucket`` pieces.
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().toPandas().itertuples(index=False):
        counts[int(r[0])] = int(r[1])
    many = {int(n): min(MOST_BUCKETS, -(-int(counts[n]) // bucket)) for n in np.flatnonzero(counts > bucket)}
    own = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("length").cast("int")], F.lit(1)) if many else F.lit(1)
    rows = rows.withColumn("bucket", F.col("turn") % own).drop("turn")
    before: dict[tuple[int, int], int] = {}
    if many:
        sizes = sorted((int(r.length), int(r.bucket), int(r["count"])) for r in rows.where(F.col("length").isin(*many)).groupBy("length", "bucket").count().collect())
        runs = np.cumsum([n for _, _, n in sizes]) - [n for _, _, n in sizes]
        first: dict[int, int] = {}
        for (length, k, _), at in zip(sizes, runs.tolist(), strict=True):
            before[length, k] = at - first.setdefault(length, at)
    held = spark.sparkContext.broadcast((before, Places(solve(counts, size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, places = held.value
        group, seen = None, 0
        for batch in batches:
            length, own = batch.column("length").to_numpy(), batch.column("bucket").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(length) != 0) | (np.diff(own) != 0)) + 1).tolist(), len(length)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (key := (int(length[a]), int(own[a]))) != group:
                    group, seen = key, 0
                ranks = before.get(key, 0) + seen + np.arange(b - a)
                seq[a:b], off[a:b] = places.find(key[0], ranks)
                seen += b - a
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    dealt = rows.repartition("length", "bucket").sortWithinPartitions("length", "bucket", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
