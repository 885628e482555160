"""How work is split: triples, containers, keyed merges, merge lookups, saved graphs."""

import itertools
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wedgeworks import catalog
from wedgeworks.functions.containers import Containers, common
from wedgeworks.functions.edges import simple_graph
from wedgeworks.operators import count as co
from wedgeworks.operators import reduce as rd
from wedgeworks.operators import scan as sc
from wedgeworks.operators import triples as tr
from wedgeworks.sources import graph as gr


def graph(spark, pairs):
    return simple_graph(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def clique_with_tail(rng, size, tail):
    clique = rng.sample(range(10 * tail), size)
    return {tuple(sorted(p)) for p in itertools.combinations(clique, 2)} | {tuple(sorted(rng.sample(range(10 * tail), 2))) for _ in range(tail)}


def slow_triangles(pairs):
    above = defaultdict(set)
    for a, b in pairs:
        above[a].add(b)
    return [(a, b, c) for a, b in pairs for c in above[a] & above[b]]


# ---- triples and containers


@pytest.mark.parametrize("dense", [0, 4, 64, 1e9])
def test_containers(dense):
    rng = np.random.default_rng(1)
    keys, width = 40, 1700
    sets = [set(rng.choice(width, rng.integers(0, 600 if k % 5 == 0 else 9), replace=False).tolist()) for k in range(keys)]
    flat = [(k, v) for k, s in enumerate(sets) for v in s]
    rng.shuffle(flat)
    key, value = np.array(flat).T
    a = Containers(key, value, keys, width, dense)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(keys), np.arange(keys)))
    assert common(a, i, a, j).tolist() == [len(sets[p] & sets[q]) for p, q in zip(i, j, strict=True)]
    nothing = Containers(np.zeros(0, int), np.zeros(0, int), keys, width, dense)
    assert not common(a, i, nothing, j).any() and not common(nothing, i, a, j).any()


def test_work_in_small_pieces(monkeypatch):
    monkeypatch.setattr("wedgeworks.functions.containers.CHUNK", 50)
    test_containers(8)


@pytest.mark.parametrize("p", [1, 2, 5])
def test_triples(spark, monkeypatch, p):
    monkeypatch.setattr(tr, "colours", lambda m, parallelism: p)
    pairs = clique_with_tail(random.Random(p), 25, 300) | {(0, k) for k in range(1, 120)} | {(k, k + 1) for k in range(1, 119)}
    edges = graph(spark, pairs).cache()
    want = slow_triangles(pairs)
    assert tr.total(edges, 1).agg({"t": "sum"}).first()[0] == len(want)
    blocks, ends = defaultdict(int), {e: 0 for e in pairs}
    for a, b, c in want:
        blocks[b // 64, c // 64] += 1
        ends[a, c] += 1
    assert {(r[0], r[1]): r[2] for r in co.partial_triangles(edges, 64).collect()} == blocks
    assert {(r[0], r[1]): r[2] for r in co.common_neighbours(edges).collect()} == ends
    # Every edge is dealt to p triples, and to no task more of them than its colours ask for.
    rows = tr.dealt(edges, p).collect()
    assert len(rows) == len(pairs) * p and len({(r["t"], r["c"], r["r"]) for r in rows}) == len(rows)
    for method in ("triples", "auto"):
        assert co.count_triangles(edges, method).first()[0] == len(want)


def test_no_row_for_a_triangle(spark):
    """In the plan, nothing lies between what is dealt and what the tasks have summed up."""
    edges = graph(spark, [(a, b) for a, b in itertools.combinations(range(60), 2)])
    steps = re.findall(r"[+:\- ]*(\w+)", plan(co.partial_triangles(edges, 16)))
    assert "Join" not in " ".join(steps) and steps.count("Generate") == 1 and "FlatMapGroupsInArrow" in plan(co.partial_triangles(edges, 16))


def test_a_hub_is_spread():
    """Of a star's edges, no triple holds more than 3 in p of them."""
    p, m = 12, 24_000
    rng = np.random.default_rng(3)
    hub, y = 5, rng.integers(0, p, m)
    held = defaultdict(int)
    for colour in y.tolist():
        for z in range(p):
            held[tuple(sorted((hub, colour, z)))] += 1
    assert max(held.values()) < 3 * m / p


def test_mixed_beats_pure():
    """A clique and a sparse tail in one triple: bitmaps for the one and arrays for the other, against either alone."""
    pairs = np.array(sorted(clique_with_tail(random.Random(4), 700, 150_000)))
    c, r = pairs.T
    x = np.zeros(len(c), np.int64)

    def run(dense):
        began = time.process_time()
        found = sum(int(n.sum()) for _, _, n, _ in tr.counted((0, 0, 0), c, r, x, x, True, dense))
        return found, time.process_time() - began

    clique = 700 * 699 * 698 // 6
    mixed, arrays = (min(run(d) for _ in range(2)) for d in (64, 0))
    assert mixed[0] == arrays[0] >= clique and mixed[1] < arrays[1] / 3
    # All lists as bitmaps of 280,000 bits would take 6 GB; a tenth of the tail shows the time.
    pairs = np.array(sorted(clique_with_tail(random.Random(4), 100, 8_000)))
    c, r = pairs.T
    x = np.zeros(len(c), np.int64)
    mixed, bitmaps = (min(run(d) for _ in range(2)) for d in (64, 1e9))
    assert mixed[0] == bitmaps[0] and mixed[1] < bitmaps[1]


# ---- reductions with the caller's operation


def _matrices(a, b):
    """Products of 2 x 2 matrices of the form [[a, b], [b, a]], which commute, modulo a prime."""
    (p, q), (r, s) = ([z.field(i).to_numpy() for i in (0, 1)] for z in (a, b))
    return pa.StructArray.from_arrays([pa.array((p * r + q * s) % 9973), pa.array((p * s + q * r) % 9973)], ["a", "b"])


@pytest.mark.parametrize(("held", "fan"), [(1 << 17, 64), (50, 2)])
def test_merge_by_key(spark, held, fan):
    rng = random.Random(6)
    keys = [("hot", 1.0)] * 700 + [(rng.choice("abcdefgh"), float(rng.randrange(8))) for _ in range(600)] + [(None, 2.0), (None, 2.0), ("n", float("nan")), ("n", float("nan")), ("z", 0.0), ("z", -0.0), ("e", None), ("e", None)]
    rows = [(*k, (rng.randrange(1, 9973), rng.randrange(9973)), 1) for k in keys] + [("only", 3.0, None, 1), ("hot", 1.0, None, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, f double, x struct<a:long,b:long>, n int").repartition(9)
    want = {}
    for k, f, x, _ in rows:
        at = k, str(f + 0.0 if f else f and f or (0.0 if f == 0 else f))
        if x and want.get(at):
            (p, q), (r, s) = want[at], x
            x = (p * r + q * s) % 9973, (p * s + q * r) % 9973
        want[at] = x or want.get(at)
    got = rd.merge_by_key(df, ["k", "f"], "x", _matrices, held, fan).collect()
    assert len(got) == len(want) and {(r["k"], str(r["f"])): r["x"] and tuple(r["x"]) for r in got} == want
    assert sc.reduce_by_key(df.limit(0), ["k", "f"], "x", _matrices).count() == 0


def test_lists_merge(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(40), [rng.randrange(1000)]) for _ in range(3000)]
    want = defaultdict(list)
    for k, v in rows:
        want[k] += v
    got = sc.reduce_by_key(spark.createDataFrame(rows, "k long, x array<long>").repartition(6), ["k"], "x", catalog._largest).collect()
    assert {r["k"]: r["x"] for r in got} == {k: sorted(v, reverse=True)[:3] for k, v in want.items()}


def test_what_is_shuffled_of_a_hot_key(spark):
    """Half of all rows are of one key; a task passes on one row of it."""
    df = spark.range(20_000, numPartitions=8).selectExpr("if(id % 2 = 0, 0, id) AS k", "id AS x")
    add = lambda a, b: pa.array(a.to_numpy() + b.to_numpy())
    parts = df.mapInArrow(rd._in_task(["k"], "x", add), "k long, x long")
    assert parts.where("k = 0").count() == 8
    assert {r["k"]: r["x"] for r in sc.reduce_by_key(df, ["k"], "x", add).collect()}[0] == sum(range(0, 20_000, 2))


def test_values_that_are_never_null(spark):
    df = spark.range(3000, numPartitions=2).selectExpr("id % 7 AS k", "struct(id + 1 AS a, id AS b) AS x")
    assert not df.schema["x"].nullable
    got = {r["k"]: tuple(r["x"]) for r in rd.merge_by_key(df, ["k"], "x", _matrices, 100).collect()}
    p, q = 1, 0
    for i in range(3, 3000, 7):
        p, q = (p * (i + 1) + q * i) % 9973, (p * i + q * (i + 1)) % 9973
    assert len(got) == 7 and got[3] == (p, q)


def test_unknown_reduction(spark):
    with pytest.raises(ValueError, match="no such reduction"):
        sc.reduce_by_key(spark.range(3), ["id"], "id", "median")


# ---- lookups and sums in order


def test_one_long_segment(spark):
    segments = spark.createDataFrame([(7, 0, 10**9), (8, 10**9, 10**9), (9, 10**9, 10**9 + 5), (10, 10**9 + 7, 10**9 + 8)], "key long, start long, stop long")
    rng = random.Random(8)
    at = [rng.randrange(10**9) for _ in range(1000)] + [5] * 700 + [-1, 10**9, 10**9 + 4, 10**9 + 5, 10**9 + 6, 10**9 + 7, 10**9 + 8, None]
    key = lambda p: 7 if 0 <= p < 10**9 else 9 if 10**9 <= p < 10**9 + 5 else 10 if p == 10**9 + 7 else None
    got = sc.segment_lookup(spark.createDataFrame([(p,) for p in at], "pos long").repartition(4), segments).collect()
    assert sorted(map(tuple, got)) == sorted((p, key(p)) for p in at if p is not None and key(p))
    assert sc.segment_lookup(spark.createDataFrame([(1,)], "pos long"), segments.limit(0)).count() == 0
    assert sc.segment_lookup(spark.createDataFrame([], "pos long"), segments).count() == 0


def test_many_segments(spark):
    rng = random.Random(9)
    cuts = sorted(rng.sample(range(100_000), 400))
    segments = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if k % 3]
    at = [rng.randrange(100_000) for _ in range(2000)]
    want = sorted((p, k) for p in at for k, a, b in segments if a <= p < b)
    got = sc.segment_lookup(spark.createDataFrame([(p,) for p in at], "pos long").repartition(5), spark.createDataFrame(segments, "key long, start long, stop long"))
    assert sorted(map(tuple, got.collect())) == want


def test_prefix_sums_of_other_types(spark):
    df = spark.createDataFrame([(3, 1.5), (1, 0.25), (2, None), (4, 2.0)], "k long, v double").repartition(3)
    for kind, want in (("inclusive", [0.25, 0.25, 1.75, 3.75]), ("exclusive", [0, 0.25, 0.25, 1.75])):
        assert [r["prefix"] for r in sorted(sc.prefix_sum(df, "k", "v", kind).collect())] == want
        got = sc.prefix_sum(df.selectExpr("k", "cast(v AS decimal(9,2)) AS v"), "k", "v", kind)
        assert [float(r["prefix"]) for r in sorted(got.collect())] == want


# ---- saved graphs


def test_saved_graph(spark):
    pairs = clique_with_tail(random.Random(10), 20, 400)
    gr.save_graph(graph(spark, pairs), "saved_test", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = gr.saved_edges(spark, "saved_test")
        assert {tuple(r) for r in edges.collect()} == pairs
        joined = co.wedges(edges)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert "Exchange" not in plan(sc.histogram(edges, "c")) and "Exchange" not in plan(co.neighbours(edges.withColumnRenamed("r", "rank").selectExpr("c", "rank AS r", "rank")))
        listed = edges.join(gr.saved_neighbours(spark, "saved_test"), "c")
        assert "Exchange" not in plan(listed)
        counted = co.count_saved(spark, "saved_test")
        below = plan(counted).split("SortMergeJoin", 1)[1]
        assert below.count("Exchange hashpartitioning") == 1  # of what is sent; what receives lies where it is
        assert counted.first()[0] == len(slow_triangles(pairs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        gr.drop_graph(spark, "saved_test")
    assert not spark.catalog.tableExists("saved_test") and not spark.catalog.tableExists("saved_test_near")


# ---- block pairs


def test_block_pairs_resume(spark, tmp_path, monkeypatch):
    pairs = clique_with_tail(random.Random(11), 18, 300)
    edges, path, block = graph(spark, pairs).cache(), str(tmp_path / "pairs"), 600
    want = defaultdict(int)
    for _, b, c in slow_triangles(pairs):
        want[b // block, c // block] += 1
    every = [(a, b) for a in range(5) for b in range(5) if a <= b]
    table = lambda rows: spark.createDataFrame(rows, "mid_block long, high_block long")
    first = co.block_pair_join(edges, block, table(every[:6]), path)
    assert {(r[0], r[1]): r[2] for r in first.collect()} == {p: want[p] for p in every[:6]}
    # A pair that is there is not counted again: a false count shows that it was left alone.
    spark.createDataFrame([(12345, *every[2])], "triangles long, mid_block long, high_block long").write.partitionBy("mid_block", "high_block").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    got = {(r[0], r[1]): r[2] for r in co.block_pair_join(edges, block, table([*every, *every]), path).collect()}
    assert got == {p: 12345 if p == every[2] else want[p] for p in every}
    monkeypatch.setattr(co, "stored", lambda df, name: df)
    writes = []
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda self, path: writes.append(plan(self._df)))
    co.block_pair_join(edges.unpersist(), block, table([(7, 8)]), path)
    assert writes[0].count("Generate") == 0 and "Union" not in writes[0]  # one join, not a join for each block
