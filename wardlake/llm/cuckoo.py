"""Cuckoo filter in numpy: 16-bit marks, four to a bucket, two candidate buckets per key; keys can be removed."""

from __future__ import annotations

import numpy as np

from wardlake.llm.words import mix

SLOTS = 4
MAX_KICKS = 500
# Share of slots filled before a filter is built anew at twice the size.
MAX_LOAD = 0.8


class Full(Exception):
    """No free slot was found; the owner builds a larger filter from its exact keys."""


class CuckooFilter:
    """``table`` has one row of marks per bucket; 0 is a free slot.

    Keys are 64-bit hashes. The owner inserts a key once and removes only keys it inserted, which its exact table
    guarantees.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * MAX_LOAD < n_keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            made = cls.sized(size)
            try:
                made.insert(keys)
                return made
            except Full:
                size = max(64, 2 * size)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype="<u2").astype(np.uint16).reshape(-1, SLOTS))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def load(self) -> float:
        return float(np.count_nonzero(self.table)) / self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        mark, a, b = self._places(keys)
        left = self._fill(a, mark, np.arange(len(keys)))
        left = self._fill(b, mark, left)
        for i in left:
            self._kick(int(a[i]), int(mark[i]))

    def _fill(self, bucket: np.ndarray, mark: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Put rows into free slots of their buckets all at once; returns the rows that found none."""
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        at = bucket[rows]
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = at[1:] != at[:-1]
        begin = np.flatnonzero(opens)
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        free = self.table[at] == 0
        fits = rank < free.sum(1)
        # the slot that is the (rank + 1)-th free one
        slot = (np.cumsum(free, axis=1) == (rank + 1)[:, None]).argmax(1)
        self.table[at[fits], slot[fits]] = mark[rows[fits]]
        return rows[~fits]

    def _kick(self, bucket: int, mark: int) -> None:
        for step in range(MAX_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
            slot = (mark + step) % SLOTS
            mark, row[slot] = int(row[slot]), mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], dtype=np.uint16))[0])
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        marks, first, second = self._places(keys)
        for mark, *buckets in zip(marks, first, second):
            for bucket in buckets:
                slots = np.flatnonzero(self.table[bucket] == mark)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
            else:
                raise KeyError("removed a key that was never inserted")
