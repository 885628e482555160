"""Triangle counts against known answers, brute force and each other."""

import itertools
import random

import pytest

from wedgeworks.functions import edges as ed
from wedgeworks.operators import count as co
from wedgeworks.operators import scan as sc

METHODS = [("adjacency", "id"), ("tile", "id"), ("wedge", "id"), ("auto", None), ("adjacency", "degree"), ("triples", "id")]


def complete(n):
    return list(itertools.combinations(range(n), 2))


def cycle(n):
    return [(i, (i + 1) % n) for i in range(n)]


PETERSEN = [*cycle(5), *[(i, i + 5) for i in range(5)], *[(5 + i, 5 + (i + 2) % 5) for i in range(5)]]
KNOWN = {
    "none": ([], 0),
    "edge": ([(0, 1)], 0),
    "loop": ([(3, 3)], 0),
    "path": ([(0, 1), (1, 2), (2, 3)], 0),
    "k3": (complete(3), 1),
    "k4": (complete(4), 4),
    "k33": (complete(33), 5456),
    "k65": (complete(65), 43680),
    "cycle": (cycle(7), 0),
    "star": ([(0, i) for i in range(1, 40)], 0),
    "bipartite": ([(a, 40 + b) for a in range(5) for b in range(6)], 0),
    "petersen": (PETERSEN, 0),
    "wheel": ([*cycle(9), *[(9, i) for i in range(9)]], 9),
    "two_k4": ([*complete(4), (2, 4), (3, 4), (2, 5), (3, 5), (4, 5)], 8),
}


def graph(spark, pairs):
    return ed.simple_graph(spark.createDataFrame(pairs, "src long, dst long"))


@pytest.mark.parametrize("name", KNOWN)
def test_known(spark, name):
    pairs, want = KNOWN[name]
    doubled = [*pairs, *[(b, a) for a, b in pairs], *[(a, a) for a, _ in pairs]]
    method, orient = METHODS[len(name) % len(METHODS)]
    assert co.count_triangles(graph(spark, pairs)).first()[0] == want
    assert co.count_triangles(graph(spark, doubled), method, orient).first()[0] == want


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(20, 70)
    pairs = [p for p in complete(n) if rng.random() < 0.2]
    links = {frozenset(p) for p in pairs}
    want = [t for t in itertools.combinations(range(n), 3) if all(frozenset(p) in links for p in itertools.combinations(t, 2))]
    label = rng.sample(range(10 * n), n)
    moved = graph(spark, [(label[a], label[b]) for a, b in pairs]).cache()
    for method, orient in METHODS:
        assert co.count_triangles(moved, method, orient).first()[0] == len(want), (method, orient)
    plain = graph(spark, pairs).cache()
    assert sorted(map(tuple, co.triangles(plain).collect())) == want
    for block in (32, 64, 96):
        assert sum(r["triangles"] for r in co.partial_triangles(plain, block).collect()) == len(want)


def test_hubs_in_parts(spark, monkeypatch):
    """A star joined to cliques, with arrays of three neighbours."""
    monkeypatch.setattr(co, "PART", 3)
    pairs = [(0, i) for i in range(1, 60)] + [(a + 10 * k, b + 10 * k) for k in range(1, 6) for a, b in complete(9)]
    want = 5 * 84 + sum(1 for k in range(1, 6) for a, b in complete(9) if a + 10 * k < 60 and b + 10 * k < 60)
    for method, orient in METHODS:
        assert co.count_triangles(graph(spark, pairs), method, orient).first()[0] == want, (method, orient)
    assert sum(r["n"] for r in co.common_neighbours(graph(spark, pairs)).collect()) == want


def test_far_ids(spark):
    """A cycle of six over ids far apart has no triangle."""
    far = [0, 1 + 2**41, 2, 2**41, 1, 2 + 2**41]
    assert co.count_triangles(graph(spark, list(zip(far, far[1:] + far[:1], strict=True))), "adjacency", "degree").first()[0] == 0


@pytest.mark.parametrize(("method", "orient"), [("nonsense", None), ("tile", "degree"), ("adjacency", "size")])
def test_unknown_methods(spark, method, orient):
    with pytest.raises(ValueError):
        co.count_triangles(graph(spark, [(0, 1)]), method, orient)


@pytest.mark.parametrize("seed", range(2))
def test_scans_of_sparse_keys(spark, seed):
    """Prefix sums, places and pointer checks over keys spread over 2**60."""
    rng = random.Random(seed)
    rows = [(k, rng.randrange(100)) for k in rng.sample(range(2**60), 3000)]
    df = spark.createDataFrame(rows, "key long, start long").repartition(5)
    total, want, falls = 0, [], []
    for i, (k, v) in enumerate(sorted(rows)):
        want.append((k, v, total))
        total += v
        if i and v < want[i - 1][1]:
            falls.append((k, v))
    assert sorted(map(tuple, sc.prefix_sum(df, "key", "start").collect())) == want
    assert sorted((r["pos"], r["key"]) for r in sc.positions_of(df, ["key"]).collect()) == [(i, k) for i, (k, *_) in enumerate(want)]
    assert sorted(map(tuple, sc.monotone_check(df).collect())) == falls


def test_null_ends_go(spark):
    raw = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "src long, dst long")
    assert [tuple(r) for r in ed.simple_graph(raw).collect()] == [(1, 2)]
