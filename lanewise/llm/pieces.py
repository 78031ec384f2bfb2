"""A memory from pieces of text to token ids in flat arrays, looked up for a whole batch at once.

A piece is known by 96 bits: two polynomial hashes of its bytes. Keys lie in one open-addressing table, ids one after the other in one
array, so a piece takes about 30 bytes where a dictionary of Python objects takes 200, and a batch is found in a few array passes.
Two generations bound it: when the young table is full it becomes the old one, and what is found there moves back.
"""

import numpy as np

from .words import U, mix
from .workers import remembered

_P = 0x9E3779B97F4A7C15
_EMPTY = np.int32(-1)


def _constants(salt: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + U(salt)) * U(_P)) | U(1)


_A, _B = _constants(1), _constants(1000)
_powers: list[np.ndarray] = []
remembered("piece powers", _powers.clear)


class Hashes:
    """64-bit and 32-bit hashes of byte ranges of one buffer, from prefix sums."""

    def __init__(self, b: np.ndarray):
        if not _powers or len(_powers[0]) < len(b) + 1:
            size = max(len(b) + 1, 1 << 20)
            _powers[:] = [np.concatenate([[U(1)], np.cumprod(np.full(size, k, np.uint64))]) for k in (U(_P), U(pow(_P, -1, 1 << 64)))]
        self.inverse = _powers[1]
        self.upto = [np.concatenate([[U(0)], np.cumsum(t[b] * _powers[0][:len(b)], dtype=np.uint64)]) for t in (_A, _B)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, back = (ends - starts).astype(np.uint64), self.inverse[starts]
        key, check = (mix((u[ends] - u[starts]) * back + size) for u in self.upto)
        return key, (check >> U(32)).astype(np.uint32)


class Table:
    """Open addressing with linear probing over a fixed number of slots."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        slots = 1 << (2 * most - 1).bit_length()
        self.mask = slots - 1
        self.row = np.full(slots, _EMPTY, np.int32)
        self.key, self.check = np.empty(most, U), np.empty(most, np.uint32)
        self.start = np.zeros(most + 1, np.int64)
        self.ids = np.empty(4 * most, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = (key & U(self.mask)).astype(np.int64)
        out = self.row[slot]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[(self.key[out[open_]] != key[open_]) | (self.check[out[open_]] != check[open_])]
        while len(open_):                                          # those whose slot holds another key go on
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.row[slot[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[(self.key[out[open_]] != key[open_]) | (self.check[out[open_]] != check[open_])]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that are not there yet, with the ids of each."""
        rows = np.arange(self.n, self.n + len(key), dtype=np.int32)
        self.key[rows], self.check[rows] = key, check
        at = int(self.start[self.n])
        self.start[self.n + 1:self.n + len(key) + 1] = at + np.cumsum(sizes)
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.empty(max(len(ids), len(self.ids) // 2), np.uint32)])
        self.ids[at:at + len(ids)] = ids
        self.n += len(key)
        slot, left = (key & U(self.mask)).astype(np.int64), np.arange(len(key))
        while len(left):
            free = left[self.row[slot[left]] < 0]
            self.row[slot[free]] = rows[free]                      # of several for one slot the last one stays
            left = left[self.row[slot[left]] != rows[left]]
            slot[left] = (slot[left] + 1) & self.mask


def taken(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    total = int(sizes.sum())
    return source[np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


class Memory:
    """Two tables of at most `most` pieces each."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, Table(most), None

    def make_room(self, n: int) -> None:
        if self.young.n + n > self.most:
            self.old, self.young = self.young, Table(self.most)

    def known(self, key: np.ndarray, check: np.ndarray) -> list[np.ndarray | None]:
        """Ids of each key, or None."""
        out = [None] * len(key)
        for table in (self.young, self.old):
            if table is not None:
                for i, r in enumerate(table.find(key, check).tolist()):
                    if r >= 0 and out[i] is None:
                        out[i] = table.ids[table.start[r]:table.start[r + 1]]
        return out
