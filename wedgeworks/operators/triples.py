"""Counting by triples of vertex colours: edges are dealt out, triangles are never rows.

Vertices get one of p colours by a hash. A triangle's colours are a triple, so it lies whole among the edges dealt to
that triple; an edge is needed by the p triples that hold its own two colours and any third. So m edges are sent p times,
however uneven the graph, as lists of gaps of two or three bytes an edge, and a task holds about 6 m / p**2 edges, a hub's among them
spread over all triples of its colour. A task counts inside its edges, for each edge, what two neighbour sets share among the vertices of the third
colour; sets are bitmaps where dense and arrays where sparse (see ``containers``), so dense and sparse parts of one graph, and of one set, each go
the short way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.containers import DENSE, Containers, Lists, common, shared
from ..functions.tiles import WIDTH, tile_of
from ..sources.packed import packed_lists, unpacked
from ..sources.shared import stored

#: Edges that a triple's task holds on average, which sets the number of colours.
EDGES = 1 << 22
#: Edges a triple below which more tasks do not pay.
FEW = 1 << 14
#: Edges packed at once.
PACK = 1 << 20


def colours(m: int, parallelism: int) -> int:
    """Colours for m edges: few enough edges a task, and tasks for every core while edges last."""
    by_size = lambda most: math.ceil(math.sqrt(6 * m / most))
    return max(1, by_size(EDGES), min(math.ceil((12 * parallelism) ** (1 / 3)), by_size(FEW)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held: list) -> pa.RecordBatch:
        c, r, x, y = (np.concatenate(column) for column in zip(*held, strict=True))
        order = np.lexsort((r, c, y, x))
        c, r, x, y = c[order], r[order], x[order], y[order]
        begin = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        blocks = [packed_lists(c[a:b], r[a:b]) for a, b in zip(begin, [*begin[1:], len(c)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x[begin]), pa.array(y[begin]), pa.array([b[0] for b in blocks]), pa.array([b[-1] for b in blocks], pa.binary())], ["x", "y", "first", "lists"])

    held, n = [], 0
    for batch in batches:
        held.append([column.to_numpy() for column in batch.columns])
        n += batch.num_rows
        if n >= PACK:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def dealt_lists(edges: DataFrame, p: int, of: Callable[[str], Column] = F.col, joined: bool = False) -> DataFrame:
    """``(t, x, y, first, lists)``: the edges between two colours, as lists of gaps, once for each of the p triples ``t`` that can need
    them. A vertex's colour is that of ``of``. Copies are made by explode or, ``joined``, by a join with the p colours."""
    colour = lambda v: F.pmod(F.xxhash64(of(v)), F.lit(p)).cast("int")
    lists = edges.select("c", "r", colour("c").alias("x"), colour("r").alias("y")).mapInArrow(_packed, "x int, y int, first long, lists binary")
    if joined:
        each = lists.join(F.broadcast(edges.sparkSession.range(p).select(F.col("id").cast("int").alias("z"))))
    else:
        each = lists.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    low, high = F.least("x", "y", "z"), F.greatest("x", "y", "z")
    t = low.cast("long") * (p * p) + (F.col("x") + F.col("y") + F.col("z") - low - high) * p + high
    return each.select(t.alias("t"), "x", "y", "first", "lists")


def dealt(edges: DataFrame, p: int) -> DataFrame:
    """``(t, c, r, x, y)``: every edge, with the colours of its ends, once for each of the p triples ``t`` that can need it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, r = unpacked(row["first"], row["lists"])
                same = (np.full(len(c), row[name], kind) for name, kind in (("t", np.int64), ("x", np.int32), ("y", np.int32)))
                t, x, y = map(pa.array, same)
                yield pa.RecordBatch.from_arrays([t, pa.array(c), pa.array(r), x, y], ["t", "c", "r", "x", "y"])

    return dealt_lists(edges, p).mapInArrow(rows, "t long, c long, r long, x int, y int")


class Dealt:
    """A triple's edges: vertices by number in order of id, edges ``u`` to ``v`` with the colours ``x`` and ``y`` of their ends."""

    def __init__(self, triple: tuple[int, int, int], ids: np.ndarray, u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        self.ids, self.u, self.v = ids, u, v
        self.colours = sorted(set(triple))
        self.colour = np.empty(len(ids), np.int32)
        self.colour[u], self.colour[v] = x, y
        self.third = sum(triple) - x - y

    @classmethod
    def read(cls, triple: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Dealt:
        """Out of rows of ``dealt_lists``; lists are opened one by one, and numbers take half the room of ids."""
        blocks, ends = [], []
        for batch in batches:
            for x, y, first, lists in zip(*(batch.column(n) for n in ("x", "y", "first", "lists")), strict=True):
                c, r = unpacked(first.as_py(), lists.as_py())
                blocks.append((c, r, x.as_py(), y.as_py()))
                ends += [c[np.concatenate(([True], c[1:] != c[:-1]))], np.unique(r)]
        ids = np.unique(np.concatenate(ends))
        m = sum(len(b[0]) for b in blocks)
        u, v, x, y = (np.empty(m, np.int32) for _ in range(4))
        at = 0
        while blocks:
            c, r, *own = blocks.pop()
            to = slice(at, at := at + len(c))
            u[to], v[to], (x[to], y[to]) = np.searchsorted(ids, c), np.searchsorted(ids, r), own
        return cls(triple, ids, u, v, x, y)

    def counted(self, between: bool, dense: float = DENSE) -> Iterator[tuple]:
        """See ``counted``, with vertices by number."""
        often = np.argsort(-(np.bincount(self.u, minlength=len(self.ids)) + np.bincount(self.v, minlength=len(self.ids))), kind="stable")  # vertices of many edges come first, so that dense parts meet
        u, v, n = self.u, self.v, len(self.ids)
        for z in self.colours:
            own = np.flatnonzero(self.third == z)
            if not len(own):
                continue
            inside = self.colour == z
            width = int(inside.sum())
            place = np.zeros(n, np.int64)
            place[often[inside[often]]] = np.arange(width)
            low, high = inside[u], inside[v]
            below = Containers(v[low], place[u[low]], n, width, dense)
            other = Containers(u[high], place[v[high]], n, width, dense) if between else below
            yield u[own], v[own], common(other, u[own], below, v[own]), z

    def listed(self) -> Iterator[tuple]:
        """``(i, j, k)``, some at a time: the wedges of two edges to the triple's vertices that an edge closes."""
        u, v, n = self.u, self.v, len(self.ids)
        for z in self.colours:
            own, low = np.flatnonzero(self.third == z), self.colour[u] == z
            if len(own) and low.any():
                below = Lists(v[low], u[low], n, n, 0)
                for pair, at, _ in shared(below, u[own], below, v[own]):
                    yield self.ids[below.value[at]], self.ids[u[own][pair]], self.ids[v[own][pair]]

    def tiled(self) -> Iterator[tuple]:
        """``(c, r, tile, common)``, some at a time: what ``tile_join`` tells of the tiles of one colour, colours being those of tiles."""
        u, v, n = self.u, self.v, len(self.ids)
        place = np.fmod(self.ids, WIDTH)
        tile, number = np.unique((self.ids - place) // WIDTH, return_inverse=True)
        bit = np.int64(1) << (WIDTH - 1 - place)

        def masks(key: np.ndarray, value: np.ndarray) -> tuple[Lists, np.ndarray]:
            packed = key * np.int64(len(tile)) + number[value]
            order = np.argsort(packed, kind="stable")
            packed, bits = packed[order], bit[value[order]]
            begin = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
            return Lists(packed[begin] // len(tile), packed[begin] % len(tile), n, len(tile), 0), np.bitwise_or.reduceat(bits, begin)

        for z in self.colours:
            own, low, high = np.flatnonzero(self.third == z), self.colour[u] == z, self.colour[v] == z
            if len(own) and low.any() and high.any():
                upper, lower = masks(u[high], v[high]), masks(v[low], u[low])
                for pair, a, b in shared(upper[0], u[own], lower[0], v[own]):
                    yield self.ids[u[own][pair]], self.ids[v[own][pair]], tile[upper[0].value[a]], np.bitwise_count(upper[1][a] & lower[1][b]).astype(np.int64)


def counted(triple: tuple[int, int, int], c: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, between: bool, dense: float = DENSE) -> Iterator[tuple]:
    """Pieces ``(c, r, n, third)`` of a triple's edges: for each edge how many triangles it closes with a vertex of colour
    ``third``. With ``between`` an edge leads from a triangle's lowest to its highest vertex, otherwise from the middle to the highest."""
    ids, number = np.unique(np.concatenate((c, r)), return_inverse=True)
    for u, v, n, z in Dealt(triple, ids, number[: len(c)], number[len(c) :], x, y).counted(between, dense):
        yield ids[u], ids[v], n, z


def _by_triples(edges: DataFrame, m: int, result: Callable[[Dealt], Iterator[tuple]], schema: str, of: Callable[[str], Column] = F.col, joined: bool = False) -> DataFrame:
    """What ``result`` tells of every triple's edges, in columns in the order of ``schema``, some rows at a time."""
    p = colours(m, edges.sparkSession.sparkContext.defaultParallelism)
    names = [f.split()[0] for f in schema.split(", ")]

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = key[0].as_py()
        for columns in result(Dealt.read((t // (p * p), t // p % p, t % p), batches)):
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names)

    return dealt_lists(edges, p, of, joined).groupBy("t").applyInArrow(task, schema)


def total(edges: DataFrame, m: int) -> DataFrame:
    """``t``: a row for each triple with its triangles."""

    def result(own: Dealt) -> Iterator[tuple]:
        yield (np.array([sum(int(n.sum()) for _, _, n, _ in own.counted(False))]),)

    return _by_triples(edges, m, result, "t long")


def block_counts(edges: DataFrame, m: int, block: int, joined: bool = False) -> DataFrame:
    """``(mid_block, high_block, triangles)`` for the blocks of ``block`` ids that the middle and highest vertices lie in."""

    def result(own: Dealt) -> Iterator[tuple]:
        for u, v, n, _ in own.counted(False):
            some = n > 0
            pairs, at = np.unique(np.stack((own.ids[u[some]] // block, own.ids[v[some]] // block)), axis=1, return_inverse=True)
            sums = np.zeros(pairs.shape[1], np.int64)
            np.add.at(sums, at.ravel(), n[some])
            yield *pairs, sums

    found = _by_triples(edges, m, result, "mid_block long, high_block long, triangles long", joined=joined)
    return found.groupBy("mid_block", "high_block").agg(F.sum("triangles").alias("triangles"))


def between(edges: DataFrame, m: int) -> DataFrame:
    """``(c, r, n)`` for every edge: triangles whose lowest and highest vertices it joins."""

    def result(own: Dealt) -> Iterator[tuple]:
        for u, v, n, z in own.counted(True):
            told = (n > 0) | (z == 0)  # one of an edge's triples tells of it in any case
            yield own.ids[u[told]], own.ids[v[told]], n[told]

    found = stored(_by_triples(edges, m, result, "c long, r long, n long"), "between")
    return found.groupBy("c", "r").agg(F.sum("n").alias("n"))


def triangles(edges: DataFrame, m: int) -> DataFrame:
    """``(i, j, k)``, ``i < j < k``: every triangle once."""
    return _by_triples(edges, m, Dealt.listed, "i long, j long, k long")


def tile_counts(edges: DataFrame, m: int) -> DataFrame:
    """``(c, r, tile, common)`` as ``tile_join`` has them; the vertices of a tile are of one colour."""
    return _by_triples(edges, m, Dealt.tiled, "c long, r long, tile long, common long", tile_of)
