"""Vectorised words and shingles of Arrow text columns, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.int64).view(_U) * _U(2) + _U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 3
_MULTIPLIERS = _RNG.integers(0, 2**63, 64, dtype=np.int64).view(_U) | _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + CHUNK // 4)
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [np.concatenate(([_U(1)], np.multiply.accumulate(np.full(n - 1, b, _U)))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about CHUNK bytes; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        end = min(end, n)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes, and for each row the index of its first word (one more at the end)."""
    solid = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = ~solid[:-1]
    before[at[:-1][at[:-1] < len(data)]] = True  # a row's start separates words
    starts = np.flatnonzero(solid & before)
    after = np.empty(len(data), bool)
    after[:-1] = before[1:] | ~solid[1:]
    if len(data):
        after[-1] = True
    ends = np.flatnonzero(solid & after) + 1
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashed = (total[ends] - total[starts]) * inverse[starts]
    return starts, ends, mix(hashed + (ends - starts).astype(_U)), np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word shingles.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    _, _, hashed, first = words(data, at)
    n = max(0, len(hashed) - size + 1)
    every = np.zeros(n, _U)
    for i in range(size):
        every += hashed[i : i + n] * _MULTIPLIERS[i]
    every = mix(every)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(hashed[a:b] * _MULTIPLIERS[: b - a]).sum() + _U(b - a)], _U))
        else:
            yield every[:0]
