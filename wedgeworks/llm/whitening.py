"""Whitening of embeddings: projections on the principal components, each scaled to unit variance.

Entries become integers ``x = floor(64 * c) + 1000000`` and every distinct integer vector counts once (the *fit
list*), so a vector that fills a third of the table weighs no more than any other. Spark adds up, in exact integers,
first the columns and then the products of entries shifted by the rounded mean: tasks multiply whole batches
with float64 matrix products that stay below 2**53, the sums are decimals. What reaches the driver has as many
numbers as the covariance, whatever the number of rows.

The eigenvectors come from mixed precision. A float32 decomposition starts; Ogita-Aishima steps, which are matrix
products only, then double the correct digits each time, in float64 and at last in extended precision. Where
eigenvalues lie so close that a step cannot tell them apart, the cluster's own small problem, shifted by
its mean so that the digits left tell its members apart, is solved and turns its vectors.

Defined results: rows with a null vector, or with a null, NaN or infinite entry, are dropped, as are entries of
2**56 or more in size (their x exceeds a long) and vectors of another length than most have (of two equally frequent
ones, the longer counts); a zero vector is a vector like others; rows with a null or repeated vec_id each get their
result; components without variance (less than 2**-50 of the first) are left out, so one distinct vector, or none, gives no
rows; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MOST = 2.0**56
FLAT = 2.0**-50  #: share of the first eigenvalue up to which a component has no variance
LARGE = 1 << 20  #: shifted entries from which rows are multiplied as Python integers
STEPS = 12  #: at most, in one precision; digits double, so three or four do
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    rows = vectors.where(F.col(column).isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    usual = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("x") == usual["length"]) if usual else rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _integers(values: np.ndarray | list) -> pa.Array:
    return pa.array([int(v) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x) to (at, total): the column sums of a task, and at -1 its rows."""
    n, total = 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n += len(x)
            total = total + x.sum(axis=0, dtype=np.int64 if np.abs(x).max() < 2**40 else object).astype(object)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), _integers([n, *total])], ["at", "total"])


def products(y: np.ndarray) -> np.ndarray:
    """The exact sum of ``row row'`` over the rows of an integer matrix, as Python integers."""
    large = np.abs(y).max(axis=1, initial=0) >= LARGE
    out = np.zeros((y.shape[1],) * 2, object)
    if large.any():
        rows = y[large].astype(object)
        out = out + rows.T @ rows
    rows = y[~large].astype(np.float64)
    step = int(2**53 // max(1, np.abs(rows).max(initial=0) ** 2))  # what a float64 sum of products holds exactly
    for at in range(0, len(rows), step):
        out = out + (rows[at : at + step].T @ rows[at : at + step]).astype(np.int64).astype(object)
    return out


def _products(middle: np.ndarray) -> Callable:
    """(x) to (at, total): a task's sums of products of shifted entries, pair i <= j at i * dimensions + j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, d = None, len(middle)
        for batch in batches:
            if batch.num_rows:
                own = products(_matrix(batch.column(0)) - middle)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array((i * d + j).astype(np.int32)), _integers(total[i, j])], ["at", "total"])

    return run


def _added(fit: DataFrame, task: Callable) -> dict[int, int]:
    """The tasks' sums, added up by Spark: as many rows as there are sums."""
    rows = fit.mapInArrow(task, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    return {r["at"]: int(r["total"]) for r in rows.collect()}


def _extended(values: np.ndarray) -> np.ndarray:
    """Python integers as extended-precision numbers."""
    high = values.astype(np.float64)
    low = values - np.array([int(h) for h in high.ravel()], object).reshape(values.shape)
    return high.astype(np.longdouble) + low.astype(np.float64)


def _size(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(np.float64), 2))


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
    """One Ogita-Aishima step on approximate eigenvectors ``x`` of symmetric ``a``, in the precision of both: better
    vectors, eigenvalues, the largest correction, and the clusters of columns whose eigenvalues it cannot tell apart."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    e = np.diag(s) / (1 - np.diag(r))
    blur = 2 * (_size(s - np.diag(e)) + _size(a) * _size(r))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > blur
    fix = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(e)
    breaks = np.flatnonzero(np.diff(e[order]) > blur) + 1
    clusters = [c for c in np.split(order, breaks) if len(c) > 1]
    return x + x @ fix, e, float(np.abs(fix).max()), clusters


def turned(a: np.ndarray, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """``x`` with the columns of a cluster turned to the eigenvectors of their own problem, shifted by its mean."""
    own = x[:, cluster]
    mean = np.trace(own.T @ (a @ own)) / len(cluster)
    small = own.T @ (a @ own - mean * own)
    small = (small + small.T) / 2
    most = np.abs(small).max()
    if most:
        x = x.copy()
        x[:, cluster] = own @ np.linalg.eigh((small / most).astype(np.float64))[1].astype(x.dtype)
    return x


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix in extended precision, both to double precision.

    float32 starts, float64 and extended precision refine; a sub-solve for each cluster follows a step that met one.
    """
    scale = np.abs(covariance).max(initial=0)
    if not scale:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = covariance / scale
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        b, x, before = a.astype(kind), x.astype(kind), np.inf
        for _ in range(STEPS):
            x, e, change, clusters = refined(b, x)
            for cluster in clusters:
                x = turned(b, x, cluster)
            if change <= 4 * np.finfo(kind).eps or (change > before / 2 and not clusters):
                break
            before = change
    e = refined(b, x)[1]
    order = np.argsort(-e)
    x = x[:, order].astype(np.float64)
    x *= np.where(x[np.abs(x).argmax(axis=0), range(len(x))] < 0, -1, 1)
    return (e[order] * scale).astype(np.float64), x


class Whitener:
    """The fit: ``n`` distinct vectors, their column sums, eigenvalues, explained shares and scaled components."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS) -> None:
        """``fit(x)`` is read three times; ``identity_error`` is measured over all of it."""
        sums = _added(fit, _sums)
        self.n, d = sums.pop(-1, 0), len(sums)
        self.sums = [sums[i] for i in range(d)]
        self.middle = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        self.rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)]
        self.offset = np.array([float(Fraction(s, self.n)) for s in self.rest])
        found, total = _added(fit, _products(self.middle)), np.zeros((d, d), object)
        for at, value in found.items():
            i, j = divmod(at, d)
            total[i, j] = total[j, i] = self.n * value - self.rest[i] * self.rest[j]
        covariance = _extended(total) / np.longdouble(max(1, self.n)) / np.longdouble(max(1, self.n))
        e, vectors = eigenvectors(covariance)
        k = int(np.sum(e[:components] > FLAT * e[0])) if d else 0
        self.values, self.explained = e[:k], [float(v) for v in e[:k] / float(np.trace(covariance) or 1)]
        self.vectors = vectors[:, :k]
        self.turn = self.vectors / np.sqrt(self.values)
        self.identity_error = self._identity_error(fit) if k else None

    def _identity_error(self, fit: DataFrame) -> float:
        middle, offset, turn = self.middle, self.offset, self.turn

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = turn.shape[1]
            total = np.zeros((k + 1, k))
            for batch in batches:
                if batch.num_rows:
                    z = (_matrix(batch.column(0)) - middle - offset) @ turn
                    total += np.vstack((z.T @ z, z.sum(axis=0)))
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "total"])

        k = turn.shape[1]
        rows = fit.mapInArrow(task, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
        total = np.zeros((k + 1) * k)
        for r in rows:
            total[r["at"]] = r["total"] / self.n
        second, mean = total[:-k].reshape(k, k), total[-k:]
        return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        """The columns of SCHEMA for ``rows(vec_id, x)``, a row for each component."""
        n, middle, rest, offset, turn = self.n, self.middle, self.rest, self.offset, self.turn
        k = turn.shape[1]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = _matrix(batch.column(1)) - middle
                most = n * int(np.abs(y).max()) + max(map(abs, rest))
                kind = np.int64 if most * most * len(middle) < 2**63 else object
                off = ((n * y.astype(kind) - np.array(rest, kind)) ** 2).sum(axis=1)
                off = np.repeat(off, k).tolist()
                z = ((y - offset) @ turn).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(len(y)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                        pa.array(off if kind is np.int64 else [v if v < 2**63 else None for v in off], pa.int64()),
                        pa.array(z),
                    ],
                    ["vec_id", "component", "deviation", "whitened"],
                )

        out = rows.mapInArrow(task, "vec_id long, component int, deviation long, whitened double")
        share = F.element_at(F.array(*map(F.lit, self.explained)), F.col("component")).alias("explained")
        return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share, F.lit(self.identity_error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every remaining row's whitened components (columns of SCHEMA)."""
    rows = scaled(vectors)
    fit = stored(rows.select("x").distinct(), "fit")
    model = None if fit.where(F.size("x") > 0).isEmpty() else Whitener(fit, components)
    forget(fit)
    return model.apply(rows) if model and model.explained else rows.sparkSession.createDataFrame([], SCHEMA)


def op11_ogita_aishima_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every row of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
