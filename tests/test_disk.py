"""What queries write for shuffles, in bytes, on 60,000 lines."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from wedgeworks import catalog
from wedgeworks.functions import edges as ed
from wedgeworks.functions import tiles as ti
from wedgeworks.operators import count as co
from wedgeworks.operators import triples as tr
from wedgeworks.sources import graph as gr

SF = "/root/testdata/sf0.01"
MOST = {
    "count_triangles_tile": 3_500_000,
    "tile_join": 3_500_000,
    "block_pair_join": 1_700_000,
    "count_triangles": 3_500_000,
    "common_neighbours": 4_500_000,
    "count_triangles_dense": 1_300_000,
    "count_triangles_triples": 3_500_000,
    "count_triangles_wedge": 1_700_000,
    "partial_triangles": 3_500_000,
    "run_summary": 3_500_000,
    "task_triangles": 3_500_000,
    "triangles": 1_700_000,
    "count_triangles_saved": 4_000_000,
    "count_triangles_by_degree": 3_500_000,
}


def shuffled(spark):
    """Bytes that the session has written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", MOST)
def test_shuffle(spark, name):
    before = shuffled(spark)
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < MOST[name]


@pytest.mark.parametrize("orient", ["id", "degree"])
def test_portions(spark, monkeypatch, orient):
    """Pivots in portions, hubs among them, give the same count; each portion leaves a number behind."""
    pairs = [(0, i) for i in range(1, 60)] + [(a + 10 * k, b + 10 * k) for k in range(1, 6) for a, b in itertools.combinations(range(9), 2)]
    edges = ed.simple_graph(spark.createDataFrame(pairs, "src long, dst long")).cache()
    want = co.count_triangles(edges).first()[0]
    names, write = [], co.stored
    for part in (3, 1024):
        monkeypatch.setattr(co, "PART", part)
        monkeypatch.setattr(co, "SENT", 1)
        monkeypatch.setattr(co, "PORTION", 1)
        monkeypatch.setattr(co, "stored", lambda df, name: names.append(name) or write(df, name))
        assert co.count_triangles(edges, "adjacency", orient).first()[0] == want
        assert names.count("portion") > 2
        names.clear()


def test_saved_in_portions(spark, monkeypatch):
    monkeypatch.setattr(co, "SENT", 0)
    monkeypatch.setattr(co, "PORTION", 2_000)
    gr.save_graph(ed.simple_graph(spark.createDataFrame(list(itertools.combinations(range(30), 2)), "src long, dst long")), "portions_test", 2)
    try:
        assert co.count_saved(spark, "portions_test").first()[0] == 30 * 29 * 28 // 6
    finally:
        gr.drop_graph(spark, "portions_test")


def test_tiles_and_lists_over_colours(spark, monkeypatch):
    """Tiles met in tasks equal tiles joined as rows, and triangles come once, with 1 and with 4 colours."""
    pairs = list(itertools.combinations(range(20, 75), 2)) + [(i, 7 * i + 100) for i in range(90)]
    edges = ed.simple_graph(spark.createDataFrame(pairs, "src long, dst long")).cache()
    upper, lower = ti.upper_tiles(edges), ti.lower_tiles(edges).withColumnRenamed("mask", "low")
    want = edges.join(upper, "c").where(ti.tile_of("r") >= F.col("tile")).join(lower, ["tile", "r"])
    want = sorted(map(tuple, want.selectExpr("c", "r", "tile", "cast(bit_count(mask & low) AS long)").collect()))
    for p in (1, 4):
        monkeypatch.setattr(tr, "colours", lambda m, parallelism, p=p: p)
        assert sorted(map(tuple, co.tile_join(edges).collect())) == want
        found = list(map(tuple, co.triangles(edges).collect()))
        assert len(found) == len(set(found)) and set(found) >= set(itertools.combinations(range(20, 75), 3))
        assert len(found) == co.count_triangles(edges, "adjacency").first()[0]
