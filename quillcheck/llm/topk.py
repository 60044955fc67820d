"""Exact top-k inner-product search by ball trees (operator 1).

Vectors are cut into shards as they are read, each with a ball tree. No vector in a node scores a
query more than (query . centre + |query| * radius). A block of queries searches a tree by branch and bound: of the nodes
still open, the one with the highest bound for any query is next, for the queries whose bound there is not below their k-th
best score so far; its children's bounds are worked out for those alone. A query starts with the k best of its own shard.

Groups of shards are searched in waves that double. Before a wave, each block is held against the roots of the wave's shards, and
only the queries that could still gain go to a group, with their k-th scores; after it, what was found is merged into the block.
So a k-th score is shared by all shards of a group and, from wave to wave, by all groups. A task holds one group's trees and one block.

Defined results: scores are integers and exact at any size (beyond a long they are shown as its nearest
value); ties go to smaller ids; vectors of another length are no candidates; a null vector or id, or one with a
null or non-finite component, takes no part; of rows that repeat, each is a query of its own and a candidate of all others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS, LEAF_ROWS, GROUP_SHARDS = 8192, 256, 8
#: Groups of the first wave, and what the roots of a wave's shards may weigh, as they are broadcast.
FIRST_WAVE, ROOT_BYTES = 16, 32 << 20
_LONG = 2**63 - 1


class BallTree:
    """Nodes with centres and radii; a leaf's rows stand together."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        points = rows.astype(float)
        self.most = max((abs(int(x)) for x in rows.ravel()), default=0) if rows.dtype == object else int(np.abs(rows).max(initial=0))
        centres: list[np.ndarray] = []
        radii: list[float] = []
        #: Of each node, its two children, or none.
        self.below: list[tuple[int, int] | None] = []
        leaves: dict[int, np.ndarray] = {}

        def node(at: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            own = points[at]
            centre = own.mean(0)
            away = ((own - centre) ** 2).sum(1)
            centres.append(centre)
            radii.append(math.sqrt(float(away.max())) if len(at) else 0.0)
            self.below.append(None)
            return len(radii) - 1, at, away

        todo = [node(np.arange(len(ids)))]
        while todo:
            n, at, away = todo.pop()
            if len(at) <= leaf_rows or not away.max() > 0:
                leaves[n] = at
                continue
            own = points[at]
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            order = np.argsort(own @ (other - far), kind="stable")
            half = len(at) // 2
            pair = node(at[order[:half]]), node(at[order[half:]])
            self.below[n] = (pair[0][0], pair[1][0])
            todo += pair
        order = np.concatenate(list(leaves.values()))
        ends = np.cumsum([len(x) for x in leaves.values()])
        self.span = {n: (int(b) - len(x), int(b)) for (n, x), b in zip(leaves.items(), ends, strict=True)}
        self.ids, self.rows = ids[order], rows[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, nodes: list[int], queries: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each query and node, a score that nothing in the node exceeds."""
        return upper(queries, sizes, self.centres[nodes], self.radii[nodes])


def upper(queries: np.ndarray, sizes: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """query . centre + |query| * radius, and a little for what floating point loses."""
    found = queries @ centres.T
    return found + sizes[:, None] * radii * (1 + 1e-9) + np.abs(found) * 1e-9 + 1


class Best:
    """The k best (score, id) of each query of a block, and the score below which a candidate is of no use."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.most = max((abs(int(x)) for x in queries.ravel()), default=0)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.points = queries.astype(float)
        self.sizes = np.sqrt((self.points * self.points).sum(1))

    def some(self, at: np.ndarray) -> Best:
        """The queries at some places, with their floors and nothing found."""
        return Best(self.ids[at], self.queries[at], self.k, self.floor[at])

    def search(self, tree: BallTree, own: np.ndarray | None = None) -> int:
        """Take what the tree has that is good enough; ``own``: the queries' places among the tree's rows. Returns the rows scored."""
        if not len(self.ids) or not len(tree.ids) or tree.rows.shape[1] != self.queries.shape[1]:
            return 0
        exact = tree.most * self.most * max(1, self.queries.shape[1]) < 2**53
        rows, queries = (x.astype(float if exact else object) for x in (tree.rows, self.queries))
        at, scored = np.arange(len(self.ids)), 0
        bound = tree.bounds([0], self.points, self.sizes)[:, 0]
        heap = [(-float(bound.max()), 0, at, bound)]
        while heap:
            _, n, at, bound = heappop(heap)
            use = bound >= self.floor[at]
            at, bound = at[use], bound[use]
            if not len(at):
                continue
            if (pair := tree.below[n]) is None:
                a, b = tree.span[n]
                scores = rows[a:b] @ queries[at].T
                scored += len(at) * (b - a)
                for j, i in enumerate(at.tolist()):
                    self._take(i, scores[:, j], tree.ids[a:b], None if own is None else int(own[i]) - a)
                continue
            both = np.minimum(tree.bounds(list(pair), self.points[at], self.sizes[at]), bound[:, None])
            for child, b in zip(pair, both.T, strict=True):
                use = b >= self.floor[at]
                if use.any():
                    heappush(heap, (-float(b[use].max()), child, at[use], b[use]))
        return scored

    def _take(self, i: int, scores: np.ndarray, ids: np.ndarray, own: int | None) -> None:
        use = np.asarray(scores >= self.floor[i], bool)
        if own is not None and 0 <= own < len(use):
            use[own] = False
        at = np.flatnonzero(use)
        if len(at):
            self.merge(i, [(int(s), v) for s, v in zip(scores[at].tolist(), ids[at].tolist(), strict=True)])

    def merge(self, i: int, new: list[tuple[int, int]]) -> None:
        self.found[i] = sorted(self.found[i] + new, key=lambda x: (-x[0], x[1]))[: self.k]
        if len(self.found[i]) == self.k:
            # Rounded down, as a floor must not lie above the score it stands for.
            least = self.found[i][-1][0]
            self.floor[i] = max(self.floor[i], float(least) if abs(least) < 2**53 else np.nextafter(float(least), -np.inf))


def scaled(vector: list[float | None] | None, scale: int) -> list[int] | None:
    """floor(scale * x) of each component, or None if a component is null or not finite."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(y) if math.isfinite(y := scale * x) else scale * int(x) for x in vector]


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    big = any(abs(x) >= 2**31 for v in vectors for x in v)
    return np.array(vectors, object if big else np.int64).reshape(len(vectors), -1)


def _fast(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows that take part and their scaled components, when all lists have one length and no nulls."""
    if not len(column) or column.null_count or column.values.null_count:
        return None
    sizes = np.diff(column.offsets.to_numpy())
    if sizes.min() != sizes.max() or not sizes[0]:
        return None
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    good = np.isfinite(x).all(1)
    if np.abs(x[good]).max(initial=0) * scale >= 2**31:
        return None
    return np.flatnonzero(good), np.floor(x[good] * scale).astype(np.int64)


def trees(vectors: DataFrame, scale: int = 1024, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, tree (pickled) and the root's width, centre and radius of every ``shard_rows`` vectors of one length in an input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = defaultdict(list)
        count: dict[int, int] = defaultdict(int)
        number = TaskContext.get().partitionId() << 32

        def out(width: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids = np.concatenate([x for x, _ in held[width]])
            rows = np.concatenate([x for _, x in held[width]])
            for at in range(0, len(ids), shard_rows):
                tree = BallTree(ids[at : at + shard_rows], rows[at : at + shard_rows])
                cols = [pa.array([number], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary()), pa.array([tree.centres[0].astype("<f8").tobytes()], pa.binary()), pa.array([tree.radii[0]], pa.float64())]
                yield pa.record_batch(cols, ["shard", "tree", "centre", "radius"])
                number += 1
            held[width], count[width] = [], 0

        for batch in batches:
            ids = batch.column(0).to_numpy()
            if (fast := _fast(batch.column(1), scale)) is not None:
                by = {fast[1].shape[1]: (ids[fast[0]], fast[1])}
            else:
                rows = [(i, s) for i, v in zip(ids.tolist(), batch.column(1).to_pylist(), strict=True) if (s := scaled(v, scale)) is not None]
                by = {w: (np.array([i for i, s in rows if len(s) == w], np.int64), _matrix([s for _, s in rows if len(s) == w])) for w in {len(s) for _, s in rows}}
            for width, (own, matrix) in by.items():
                held[width].append((own, matrix))
                count[width] += len(own)
                if count[width] >= shard_rows:
                    yield from out(width)
        for width in list(held):
            if count[width]:
                yield from out(width)

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "shard long, tree binary, centre binary, radius double")


def _rows(column: pa.Array) -> Iterator:
    return (pickle.loads(x.as_py()) for x in column)


def _binary(kind: str, of: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(of, pa.int64()), pa.array(data, pa.binary())], [kind, "data"])


def _home(every: int, k: int):
    """A shard's queries as a block, with their best in the shard; a query's own row is none of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, tree in zip(batch.column(0).to_pylist(), _rows(batch.column(1)), strict=True):
                at = np.flatnonzero(tree.ids % every == 0)
                if len(at):
                    best = Best(tree.ids[at], tree.rows[at], k)
                    best.search(tree, at)
                    yield _binary("block", [shard], [pickle.dumps(best)])

    return run


def useful(best: Best, home: int, shards: np.ndarray, centres: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Of each shard where a query could still gain, those queries' places; ``centres``: by width, places in ``shards``, centres and radii."""
    width = best.queries.shape[1]
    if width not in centres:
        return {}
    at, points, radii = centres[width]
    gains = upper(best.points, best.sizes, points, radii) >= best.floor[:, None]
    return {int(shards[at[j]]): np.flatnonzero(gains[:, j]) for j in np.flatnonzero(gains.any(0)).tolist() if shards[at[j]] != home}


def _send(held):
    """A block's queries to every group with a shard where they could gain, and to which of its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, groups, centres = held.value
        group_of = dict(zip(shards.tolist(), groups.tolist(), strict=True))
        for batch in batches:
            for home, best in zip(batch.column(0).to_pylist(), _rows(batch.column(1)), strict=True):
                by: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
                for shard, at in useful(best, home, shards, centres).items():
                    by[group_of[shard]][shard] = at
                for group, wanted in by.items():
                    at = np.unique(np.concatenate(list(wanted.values())))
                    data = pickle.dumps((home, at, best.some(at), sorted(wanted)))
                    yield pa.record_batch([pa.array([group], pa.int64()), pa.array([True]), pa.array([home], pa.int64()), pa.array([data], pa.binary())], ["group", "is_block", "shard", "data"])

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's trees come first, then the blocks sent to it."""
    group, held = None, {}
    for batch in batches:
        for of, is_block, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _rows(batch.column(3)), strict=True):
            if of != group:
                group, held = of, {}
            if not is_block:
                held[shard] = data
                continue
            home, at, best, wanted = data
            for other in wanted:
                best.search(held[other])
            if any(best.found):
                yield _binary("block", [home], [pickle.dumps((at, best.found))])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block comes first, then what was found for it."""
    own, best = None, None
    for batch in batches:
        for block, is_found, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _rows(batch.column(2)), strict=True):
            if not is_found:
                if best is not None:
                    yield _binary("block", [own], [pickle.dumps(best)])
                own, best = block, data
                continue
            for i, new in zip(data[0].tolist(), data[1], strict=True):
                best.merge(i, new)
    if best is not None:
        yield _binary("block", [own], [pickle.dumps(best)])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for best in _rows(batch.column(1)):
            rows = [(int(i), n, v, max(-_LONG, min(_LONG, s))) for i, found in zip(best.ids, best.found, strict=True) for n, (s, v) in enumerate(found, 1)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["query_id", "rank", "vec_id", "score"])


def waves(groups: int, most: int, first: int = FIRST_WAVE) -> list[tuple[int, int]]:
    """Runs of groups, from and to: each as long as all before it, ``most`` at most."""
    out, at = [], 0
    while at < groups:
        n = max(1, min(max(first, at), most, groups - at))
        out.append((at, at + n))
        at += n
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = SHARD_ROWS, group_shards: int | None = None, first_wave: int = FIRST_WAVE) -> DataFrame:
    """The ``k`` best of all other rows for each row whose id ``every`` divides: query_id, rank (from 1), vec_id, score.

    ``group_shards`` shards make a group; of few shards, each is a group.
    """
    spark = vectors.sparkSession
    shards = stage(trees(vectors, scale, shard_rows), "ball-trees")
    totals = shards.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("centre")).alias("width")).first()
    n = totals.n
    groups = max(1, -(-n // (group_shards or (1 if n <= 64 else GROUP_SHARDS))))
    group = F.pmod(F.xxhash64("shard"), F.lit(groups))
    blocks = stage(shards.select("shard", "tree").mapInArrow(_home(every, k), "block long, data binary"), "query-blocks")
    per_group = (-(-n // groups)) * ((totals.width or 0) + 32)
    for a, b in waves(groups, max(1, ROOT_BYTES // max(1, per_group)), first_wave) if n > 1 else []:
        here = shards.where(group.between(a, b - 1))
        # The roots of one wave, whose number is chosen so that they weigh about ROOT_BYTES at most.
        roots = here.select("shard", group.alias("group"), "centre", "radius").collect()
        held = spark.sparkContext.broadcast(_roots(roots))
        sent = blocks.mapInArrow(_send(held), "group long, is_block boolean, shard long, data binary")
        work = here.select(group.alias("group"), F.lit(False).alias("is_block"), "shard", F.col("tree").alias("data"))
        dealt = work.unionByName(sent).repartition(b - a, "group").sortWithinPartitions("group", "is_block", "shard")
        found = dealt.mapInArrow(_search, "block long, data binary").select("block", F.lit(True).alias("is_found"), "data")
        both = blocks.select("block", F.lit(False).alias("is_found"), "data").unionByName(found)
        blocks = stage(both.repartition("block").sortWithinPartitions("block", "is_found").mapInArrow(_merge, "block long, data binary"), "query-blocks")
    return blocks.mapInArrow(_results, "query_id long, rank int, vec_id long, score long")


def _roots(rows: list) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Shards, their groups, and by width: places, centres and radii."""
    points = [np.frombuffer(r.centre, "<f8") for r in rows]
    by: dict[int, list[int]] = defaultdict(list)
    for i, p in enumerate(points):
        by[len(p)].append(i)
    centres = {w: (np.array(at), np.array([points[i] for i in at]).reshape(len(at), w), np.array([rows[i].radius for i in at])) for w, at in by.items()}
    return np.array([r.shard for r in rows], np.int64), np.array([r.group for r in rows], np.int64), centres
