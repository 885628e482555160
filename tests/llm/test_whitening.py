"""Whitening against plain integer arithmetic and a known spectrum."""

import random

import numpy as np
import pytest

from wedgeworks.llm import whitening


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, component string, n int").repartition(3)


def plain(rows):
    """vec_id to deviation and whitened values up to sign, for rows that remain, by integers and one float64 eigh."""
    x = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    off = n * fit - s
    e, vectors = np.linalg.eigh((off.T @ off).astype(float) / float(n) ** 3)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(16, int((e > 1e-12 * e[0]).sum()))
    own = {i: n * np.array(v, object) - s for i, v in x}
    return n, e, k, {i: (int((o**2).sum()), (o / n).astype(float) @ vectors[:, :k] / np.sqrt(e[:k])) for i, o in own.items()}


@pytest.mark.parametrize(("dimensions", "kind"), [(24, "float"), (5, "double")])
def test_whiten(spark, dimensions, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, dimensions)) * np.linspace(1, 3, dimensions) + 40
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector many times
    rows += [(2000, [0.0] * dimensions), (2001, [3e7] + [1.0] * (dimensions - 1)), (2002, rows[8][1])]
    nan, inf = float("nan"), float("inf")
    bad = [(3000, None), (3001, [None] + [0.0] * (dimensions - 1)), (3002, [nan] * dimensions), (3003, [-inf] * dimensions), (3004, [1.0]), (3005, []), (3006, [1e30] * dimensions)]
    n, e, k, want = plain(rows)
    got = whitening.whiten(frame(spark, rows + bad, kind)).collect()
    assert len(got) == k * len(rows) and {r["component"] for r in got} == set(range(1, k + 1))
    assert all(r["n"] == n and r["deviation"] == (want[r["vec_id"]][0] if want[r["vec_id"]][0] < 2**63 else None) for r in got)
    assert all(abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 for r in got)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    z = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for c in range(1, k + 1):
        one = np.array([z[i, c] for i, _ in rows])
        two = np.array([want[i][1][c - 1] for i, _ in rows])
        assert min(np.abs(one - two).max(), np.abs(one + two).max()) < 1e-6


def test_repeated_and_null_ids_and_few_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 5.0]), (None, [1.0, 2.0]), (4, [0.0, 1.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 and sum(r["vec_id"] is None for r in got) == 2 and got[0]["n"] == 3
    got = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(4)])).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 4  # the others have no variance
    for few in ([(1, [1.0, 2.0])] * 3, [(1, None)], [(1, [])], []):
        assert whitening.whiten(frame(spark, few)).count() == 0
    assert whitening.whiten(frame(spark, few)).columns == [f.split()[0] for f in whitening.SCHEMA.split(", ")]


def test_clustered_eigenvalues():
    """Eigenvalues 1e-9 apart, and equal ones, between others."""
    rng = np.random.default_rng(4)
    e = np.array([9, 5 + 2e-9, 5 + 1e-9, 5, 3, 2, 2, 1, 1e-3, 0])
    q = np.linalg.qr(rng.standard_normal((10, 10)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(10) - 0.5 * q.T @ q)  # orthogonal to extended precision
    a = (q * e) @ q.T
    values, x = whitening.eigenvectors((a + a.T) / 2)
    assert np.abs(values - e).max() < 1e-14
    assert np.abs(x.T @ x - np.eye(10)).max() < 1e-15
    near = np.abs(np.sum(x * q.astype(float), axis=0))
    assert np.all(np.delete(near, [5, 6]) > 1 - 1e-14)
    assert np.abs(np.abs(x[:, 1:4].T @ q[:, 1:4].astype(float)) - np.eye(3)).max() < 1e-8
    lost = np.linalg.eigh(a.astype(float))[1][:, ::-1]
    assert np.abs(np.abs(lost[:, 1:4].T @ q[:, 1:4].astype(float)) - np.eye(3)).max() > 1e-8  # float64 alone does not tell them apart
    assert np.abs(q[:, 5:7].astype(float) @ (q[:, 5:7].astype(float).T @ x[:, 5:7]) - x[:, 5:7]).max() < 1e-14


def test_products_are_exact():
    rng = random.Random(5)
    y = np.array([[rng.randrange(-300, 300) for _ in range(6)] for _ in range(50)] + [[rng.randrange(-(2**40), 2**40) for _ in range(6)] for _ in range(3)])
    assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()
