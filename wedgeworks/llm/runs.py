"""Periodic runs of words: stretches that repeat with a period, found as words are appended.

Squares are caught online. When a block of 2**k words is complete, a *catcher* watches for the block to come back at
a distance between 2**k and 2**(k+1), so that every new window of 2**k words meets one catcher a level: the block that
ends where the window's own block begins. A catch compares suffixes: backwards from both occurrences
once, and forwards as words are appended, for as long as words equal those one period before. A stretch of two periods is a square,
and all squares of one period that overlap are one stretch, the run, which is reported when a word breaks it or the
text ends. A stretch of three periods holds a whole block that comes back within it, so no run of exponent three or more is missed; for
smaller exponents two catchers a level watch at twice to four times the block's length, and catch every square.

Words may be appended one by one or in pieces; either finds the same. Windows are compared by rolling hashes of
exact word numbers, a whole piece at once, and a hash match counts only after the words themselves have been compared. A
multiple of a period is no period of its own: catches inside a run of a shorter period are skipped. Time is
n log n in a text's n words; a document is one row, and rows are spread as they lie.

Defined results: null or empty text has no words and no runs; a null doc_id leaves the words as they are (see
``reworded``); repeated rows get a result each; of equal exponents the run of the smaller start, then period, is
the greatest; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8
from .words import mix, powers

LEAST, EXPONENT = 6, 4  #: words and periods that a run has at least
PIECE = 1 << 16  #: words appended at once
_U = np.uint64


@lru_cache(1 << 16)
def primes(n: int) -> tuple[int, ...]:
    """The distinct prime divisors of n."""
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return (*found, n) if n > 1 else tuple(found)


class SquareCatcher:
    """Runs of at least ``exponent`` (2 or more) periods in a growing sequence of word numbers."""

    def __init__(self, exponent: int = EXPONENT) -> None:
        self.turns = (1,) if exponent >= 3 else (2, 3)
        self.exponent, self.n, self.settled = exponent, 0, 0  # settled: stretches closed before the last words
        self.words = np.zeros(1024, np.int64)
        self.sums = np.zeros(1025, _U)  # rolling hash: sums[j] - sums[i] is that of words i to j, times a power
        self.open: dict[int, int] = {}  #: period to start of the stretch that reaches the end
        self.closed: list[tuple[int, int, int]] = []  #: (start, end, period) of squares and more that a word has ended

    def append(self, words: np.ndarray) -> None:
        """More words; afterwards every square that ends with one of them belongs to a stretch in open or closed."""
        before, n, self.settled = self.n, self.n + len(words), len(self.closed)
        if n > len(self.words):
            self.words = np.concatenate((self.words[:before], np.zeros(max(n, 2 * before) - before, np.int64)))
            self.sums = np.concatenate((self.sums[: before + 1], np.zeros(len(self.words) - before, _U)))
        self.words[before:n] = words
        power = powers(n + 1)[0]
        with np.errstate(over="ignore"):
            self.sums[before + 1 : n + 1] = self.sums[before] + np.cumsum(mix(self.words[before:n].astype(_U) + _U(1)) * power[before:n])
        self.n = n
        for period, start in list(self.open.items()):  # suffix comparisons go on where they stood
            del self.open[period]
            self._settle(start, self._forward(before, period), period)
        if 1 not in self.turns:
            self._catch(1, 1, before)
        size = 1
        while (self.turns[0] + 1) * size <= n:
            for turn in self.turns:
                self._catch(size, turn, before)
            size *= 2

    def _catch(self, size: int, turn: int, before: int) -> None:
        """Windows of ``size`` words that end after ``before``, each against the block ``turn`` blocks before its own."""
        s = np.arange(max(before - size + 1, turn * size), self.n - size + 1)
        if not len(s):
            return
        b = (s & -size) - turn * size
        sums, power = self.sums, powers(self.n + 1)[0]
        hit = (sums[s + size] - sums[s]) == (sums[b + size] - sums[b]) * power[s - b]
        if not hit.any():
            return
        s, b = s[hit], b[hit]
        outside = ~self._covered(b, s + size, size)
        s, b = s[outside], b[outside]
        period = s - b
        for p in np.unique(period).tolist():
            starts, at = s[period == p], 0
            while at < len(starts):
                k = int(starts[at])
                first = self.open.get(p)
                if first is not None and k - p >= first:
                    break  # the rest lies in the stretch that is open
                end = self._forward(k, p)
                if end >= k + size:
                    self._settle(self._backward(k - p, p), end, p)
                at = int(np.searchsorted(starts, max(k + 1, end - size + 1)))

    def _covered(self, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """Whether a stretch of a period of ``size`` words or fewer holds all from start to end, which lies in the last words appended."""
        held = [(a, e) for a, e, p in self.closed[self.settled :] if p <= size and e - a >= 2 * size]
        held += [(a, self.n) for p, a in self.open.items() if p <= size and self.n - a >= 2 * size]
        if not held:
            return np.zeros(len(start), bool)
        a, e = np.array(sorted(held)).T
        k = np.searchsorted(a, start, "right")
        return (k > 0) & (np.maximum.accumulate(e)[np.maximum(k - 1, 0)] >= end)

    def _forward(self, at: int, period: int) -> int:
        """The first position from ``at`` whose word is not the one a period before, or the end."""
        w, step = self.words, 16
        while at < self.n:
            end = min(self.n, at + step)
            differ = w[at:end] != w[at - period : end - period]
            if differ.any():
                return at + int(differ.argmax())
            at, step = end, 2 * step
        return self.n

    def _backward(self, at: int, period: int) -> int:
        """The first position up to ``at`` from which on words equal those a period later."""
        w, step = self.words, 16
        while at > 0:
            begin = max(0, at - step)
            differ = w[begin:at] != w[begin + period : at + period]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = begin, 2 * step
        return 0

    def _settle(self, start: int, end: int, period: int) -> None:
        """Keep a stretch: open if it reaches the end, closed if it is a square of no shorter period."""
        if end == self.n:
            self.open[period] = start
        elif end - start >= 2 * period and not self._shorter(start, end, period):
            self.closed.append((start, end, period))

    def _shorter(self, start: int, end: int, period: int) -> bool:
        """Whether a stretch of two periods or more has a shorter one, which then divides it."""
        return any(self._forward(start + period // d, period // d) >= end for d in primes(period))

    def runs(self, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start and period."""
        still = [(a, self.n, p) for p, a in self.open.items() if self.n - a >= 2 * p and not self._shorter(a, self.n, p)]
        return sorted({(a, e - a, p) for a, e, p in self.closed + still if e - a >= max(least, self.exponent * p)})


def find_runs(words: list[bytes], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == len(ids):
        return []
    catcher = SquareCatcher(exponent)
    for at in range(0, len(ids), PIECE):
        catcher.append(ids[at : at + PIECE])
    return catcher.runs(least)


def reworded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by their ids' crc32, repeat a stretch of their own words from some word on."""
    if doc_id is None or not words:
        return words
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("best", pa.int32()), ("collapsed", pa.binary())]


def _rows(reword: bool, exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().split()  # bytes split at \x20 and \x09-\x0D
                if reword:
                    words = reworded(words, doc_id)
                runs = find_runs(words, exponent, least)
                best = max(range(len(runs)), key=lambda i: (_exact(runs[i]), -i)) if runs else None
                row = doc_id, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], best, b" ".join(collapsed(words, runs))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return run


class _exact:  # noqa: N801
    """Order of runs by length over period, without rounding."""

    def __init__(self, run: tuple[int, int, int]) -> None:
        self.length, self.period = run[1:]

    def __lt__(self, other: _exact) -> bool:
        return self.length * other.period < other.length * self.period

    def __eq__(self, other: object) -> bool:
        return self.length * other.period == other.length * self.period


def periodic_runs(docs: DataFrame, reword: bool = False, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, the runs by start and period, the place of the greatest among them (null without runs), and
    the text with every run collapsed to its first period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(_rows(reword, exponent, least), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best int, collapsed binary")


def op12_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them reworded."""
    best = F.col("runs")[F.col("best")]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs(table(spark, sf_dir, "documents"), reword=True)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * runs[best].length div runs[best].period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
