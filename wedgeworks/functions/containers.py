"""Many sets of small numbers, each part in the form that fits it, and how many numbers pairs of sets share.

Numbers fall into ranges, the first of 512 and each later one as wide as all before it. A set's part in a range is a container: a
bitmap if dense there, else a sorted array. If numbers are given in order of how often they occur, dense parts meet in the first
ranges, and a set that is dense there and sparse beyond is held and intersected as both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Width of the first range.
FIRST = 512
#: A part is dense, and held as a bitmap, from one number a word of 64 on average: its bitmap takes no more memory than its array.
DENSE = 64
#: Numbers or words handled at once.
CHUNK = 1 << 20


class Lists:
    """For each key below ``keys`` the set of its values, which lie below ``width``: a bitmap if dense, else a sorted array."""

    def __init__(self, key: np.ndarray, value: np.ndarray, keys: int, width: int, dense: float = DENSE) -> None:
        self.width = max(1, width)
        packed = np.sort(key.astype(np.int64) * self.width + value)
        key, self.value = packed // self.width, packed % self.width
        self.start = np.searchsorted(key, np.arange(keys + 1))
        self.size = np.diff(self.start)
        fits = (self.size * dense >= self.width) & (self.size > 0)
        self.row = np.where(fits, np.cumsum(fits) - 1, -1)
        inside = fits[key]
        self.packed = packed[~inside]  # what the arrays hold
        words = -(-self.width // 64)
        self.bits = np.zeros((int(fits.sum()), words), np.uint64)
        rows, values = self.row[key[inside]], self.value[inside]
        step = max(1, 64 * CHUNK // (64 * words))
        for first in range(0, len(self.bits), step):
            own = slice(*np.searchsorted(rows, (first, first + step)))
            flags = np.zeros((min(step, len(self.bits) - first), 64 * words), bool)
            flags[rows[own] - first, values[own]] = True
            self.bits[first : first + step] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)

    def holds(self, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Whether each key's set holds each value."""
        row, out = self.row[key], np.zeros(len(key), bool)
        d = np.flatnonzero(row >= 0)
        out[d] = (self.bits[row[d], value[d] >> 6] >> (value[d] & 63).astype(np.uint64)) & np.uint64(1) > 0
        if len(self.packed):
            s = np.flatnonzero(row < 0)
            wanted = key[s] * np.int64(self.width) + value[s]
            at = np.minimum(np.searchsorted(self.packed, wanted), len(self.packed) - 1)
            out[s] = self.packed[at] == wanted
        return out


class Containers:
    """For each key below ``keys`` the set of its values, which lie below ``width``, by ranges."""

    def __init__(self, key: np.ndarray, value: np.ndarray, keys: int, width: int, dense: float = DENSE) -> None:
        low, high, self.ranges = 0, min(FIRST, width), []
        while low < width:
            own = (value >= low) & (value < high)
            self.ranges.append(Lists(key[own], value[own] - low, keys, high - low, dense))
            low, high = high, min(2 * high, width)


def common(a: Containers, i: np.ndarray, b: Containers, j: np.ndarray) -> np.ndarray:
    """For each pair of keys how many values a's set of the one and b's set of the other share; a and b are of one width.

    Two bitmaps are combined word by word; otherwise the shorter array is walked and looked up in the other set, bit by bit in a bitmap.
    """
    n = np.zeros(len(i), np.int64)
    for x, y in zip(a.ranges, b.ranges, strict=True):
        both = np.flatnonzero((x.size[i] > 0) & (y.size[j] > 0))
        n[both] += _shared(x, i[both], y, j[both])
    return n


def _shared(a: Lists, i: np.ndarray, b: Lists, j: np.ndarray) -> np.ndarray:
    n = np.zeros(len(i), np.int64)
    row, other = a.row[i], b.row[j]
    dense = np.flatnonzero((row >= 0) & (other >= 0))
    step = max(1, CHUNK // max(1, a.bits.shape[1]))
    for first in range(0, len(dense), step):
        at = dense[first : first + step]
        n[at] = np.bitwise_count(a.bits[row[at]] & b.bits[other[at]]).sum(axis=1, dtype=np.int64)
    some = (row < 0) | (other < 0)
    second = (other < 0) & ((row >= 0) | (b.size[j] < a.size[i]))
    for x, p, y, q, pairs in ((a, i, b, j, some & ~second), (b, j, a, i, some & second)):
        for at, which, place in _walked(x, p, np.flatnonzero(pairs)):
            n[at] = np.bincount(which[y.holds(q[at][which], x.value[place])], minlength=len(at))
    return n


def _walked(x: Lists, p: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some of the pairs at a time: which they are, and, for each value of x's sets ``p`` of them, its pair among these and its place in x."""
    upto = np.cumsum(x.size[p[pairs]])
    first = 0
    while first < len(pairs):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CHUNK, "right")))
        at = pairs[first:end]
        size = x.size[p[at]]
        which = np.repeat(np.arange(len(at)), size)
        yield at, which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(x.start[p[at]], size)
        first = end


def shared(a: Lists, i: np.ndarray, b: Lists, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(pair, in_a, in_b)``, some at a time: each value that a's set of the one key of a pair and b's set of the other share, by its places.
    Both hold arrays alone and are of one width; of each pair the shorter is walked."""
    second = b.size[j] < a.size[i]
    some = (a.size[i] > 0) & (b.size[j] > 0)
    for x, p, y, q, pairs, turned in ((a, i, b, j, some & ~second, False), (b, j, a, i, some & second, True)):
        for at, which, place in _walked(x, p, np.flatnonzero(pairs)):
            wanted = q[at][which] * np.int64(y.width) + x.value[place]
            found = np.minimum(np.searchsorted(y.packed, wanted), len(y.packed) - 1)
            hit = np.flatnonzero(y.packed[found] == wanted)
            places = place[hit], found[hit]
            yield at[which[hit]], *(places[::-1] if turned else places)
