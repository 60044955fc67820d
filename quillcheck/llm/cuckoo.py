"""A cuckoo filter: approximate membership with deletion, four 16-bit marks to a bucket.

Keys are byte strings that are already uniform hashes (digests); the filter reads its
bucket and its mark from their first ten bytes. A filter never forgets a key that was
inserted and not deleted. It can claim a key that was never inserted, so every hit must
be checked against the stored keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np

SLOTS = 4
KICKS = 400
_MIX = 0x5BD1E995


class CuckooFilter:
    """Insert, delete and probe; ``insert`` is False when full, then ``resized`` is due."""

    def __init__(self, buckets: int = 16, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = array("H", bytes(2 * SLOTS * buckets) if cells is None else cells)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """An empty filter with room for ``n`` keys at a load of 0.8 or less."""
        buckets = 16
        while buckets * SLOTS * 0.8 < n:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def of(cls, keys: Iterable[bytes], room: int = 0) -> CuckooFilter:
        """A filter of ``keys``, doubled as often as they overflow it."""
        keys = list(keys)
        new = cls.sized(max(len(keys), room))
        while not all(map(new.insert, keys)):
            new = cls(new.buckets * 2)
        return new

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        i = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return (i ^ (mark * _MIX)) & (self.buckets - 1)

    def __contains__(self, key: bytes) -> bool:
        mark, i, j = self._places(key)
        c = self.cells
        return mark in c[i * SLOTS : i * SLOTS + SLOTS] or mark in c[j * SLOTS : j * SLOTS + SLOTS]

    def _put(self, i: int, mark: int) -> bool:
        for k in range(i * SLOTS, i * SLOTS + SLOTS):
            if not self.cells[k]:
                self.cells[k] = mark
                return True
        return False

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the filter then lost a mark and must be rebuilt."""
        mark, i, j = self._places(key)
        if self._put(i, mark) or self._put(j, mark):
            return True
        at = j
        for kick in range(KICKS):
            k = at * SLOTS + kick % SLOTS
            self.cells[k], mark = mark, self.cells[k]
            at = self._other(at, mark)
            if self._put(at, mark):
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Take one mark of ``key`` out; only keys that are in the filter may be deleted."""
        mark, i, j = self._places(key)
        for at in (i, j):
            for k in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.cells[k] == mark:
                    self.cells[k] = 0
                    return True
        return False

    def probe(self, heads: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Which of many keys may be in the filter.

        ``heads``: the first eight bytes as unsigned 64-bit integers; ``marks``: the two after them.
        """
        cells = np.frombuffer(self.cells, np.uint16).reshape(-1, SLOTS)
        marks = np.where(marks == 0, 1, marks).astype(np.uint64)
        low = np.uint64(self.buckets - 1)
        i = heads & low
        j = (i ^ (marks * np.uint64(_MIX))) & low
        want = marks.astype(np.uint16)[:, None]
        return (cells[i.astype(np.int64)] == want).any(1) | (cells[j.astype(np.int64)] == want).any(1)

    def tobytes(self) -> bytes:
        return self.cells.tobytes()
