"""Approximate nearest neighbours over a graph built by NN-descent.

Equal vectors become one node. Random hyperplanes deal the nodes into leaves, a few times over, and the
nearest of a leaf start the graph. Then, in rounds of joins, every node gathers its neighbours and those
it is a neighbour of, with their vectors, and introduces them to each other where one of the two is new;
each keeps its ``DEGREE`` nearest. Rounds end when few edges are new. A query, being a row of the table, enters
the graph at its own node and searches greedily: in each round, what is not expanded yet among its best ``BEAM``
is expanded, all queries at once, and its neighbours are measured; a query ends when its best are all expanded.
A node has at most ``DEGREE`` neighbours and the ``BACK`` nearest of those that it is a neighbour of, so a query
measures a number of vectors that the table's size hardly changes. Graph, search and result all use the original
vectors, with distances in double precision, and a hyperplane lies at the median of a sample, so neither long
vectors nor a far origin blur the graph.

Every list gathered in a task is bounded by the degree or the leaf size. The result is approximate; its
recall against brute force, and the vectors measured, are in the README and the tests.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, as
queries or candidates, as do rows with a null vec_id and vectors of another length than most have (of two equally
frequent lengths, the longer counts); equal vectors tie by vec_id; a repeated id is one candidate, with the least
of its vectors in order of components; with ten others or fewer, all are returned as far as the graph reaches them, which
it does when they fit in a leaf; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, join_keyed, stored, table

DEGREE = 56
REVERSE = 56  #: nearest of those that have a node as neighbour
TREES, LEAF, LEAF_MOST = 4, 64, 160
ROUNDS = 8
OFFER = 10  #: candidates that one introduction offers a node
BACK = 48  #: nearest of those that have a node as neighbour, in the search
BEAM, SEARCH_ROUNDS = 48, 12
FEW_NEW = 0.02  #: share of new edges below which the graph is done
SAMPLE = 4096  #: vectors that place the hyperplanes
QUERY_EVERY = 100
TOP = 10


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(fine & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("x"))
    usual = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("x") == usual["length"]) if usual else rows


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _planes(dimensions: int, bits: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((dimensions, TREES * bits))


def _leaves(middle: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            side = (x.astype(np.float64) @ _planes(x.shape[1], bits) > middle).reshape(-1, TREES, bits)
            codes = (side * (1 << np.arange(bits))).sum(axis=2) * TREES + np.arange(TREES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))], ["node", "x", "leaves"])

    return run


def _distances(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = (x * x).sum(axis=1)
    out = size[:, None] + size[None, :] - 2 * x @ x.T
    np.fill_diagonal(out, np.inf)
    return out


def _offers(members: np.ndarray, distance: np.ndarray, most: int) -> pa.RecordBatch | None:
    """For each member its nearest finite others, at most ``most``."""
    if len(members) < 2:
        return None
    most = min(most, len(members) - 1)
    near = np.argpartition(distance, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(distance, near, 1)
    at, k = np.nonzero(np.isfinite(value))
    return pa.RecordBatch.from_arrays([pa.array(members[at]), pa.array(members[near[at, k]]), pa.array(value[at, k])], ["v", "u", "d"])


def _merged(batches: list[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    full = [b for b in batches if b is not None and b.num_rows]
    if full:
        yield from pa.Table.from_batches(full).combine_chunks().to_batches()


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A leaf's members to each one's nearest there."""
    for batch in batches:
        out = []
        for row in batch.column(0):
            x = _matrix(row.values.field("x"), np.float32)
            out.append(_offers(row.values.field("node").to_numpy(), _distances(x), DEGREE // 2))
        yield from _merged(out)


def _introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's neighbours to those of them that are nearer to each other than what they have."""
    for batch in batches:
        out = []
        for row in batch.column(0):
            at = row.values
            node, new, worst = (at.field(k).to_numpy(zero_copy_only=False) for k in ("u", "new", "worst"))
            distance = _distances(_matrix(at.field("x"), np.float32))
            distance[~(new[:, None] | new[None, :]) | (distance >= worst[:, None])] = np.inf
            out.append(_offers(node, distance, OFFER))
        yield from _merged(out)


def kept(edges: DataFrame) -> DataFrame:
    """The DEGREE nearest (v, u, d, new) of every node, known edges being no longer new."""
    rank = W.partitionBy("v").orderBy("d", "u")
    one = edges.repartition("v").groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return one.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= DEGREE)


def reverse(graph: DataFrame, most: int) -> DataFrame:
    """(v, u, new): for every node v the nearest, at most ``most``, of those that have it as neighbour."""
    rank = F.row_number().over(W.partitionBy("v").orderBy("d", "u"))
    return graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "d", "new").withColumn("rank", rank).where(F.col("rank") <= most).select("v", "u", "new")


def graph_of(nodes: DataFrame) -> DataFrame:
    """(v, u, d, new, rank): the neighbour graph of ``nodes(node, x, leaves)``."""
    spread = nodes.select("node", "x", F.explode("leaves").alias("leaf"))
    sizes = spread.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_MOST).alias("parts"))
    dealt = spread.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("node", "leaf"), F.col("parts")))
    leaves = dealt.groupBy("leaf", "part").agg(F.collect_list(F.struct("node", "x")).alias("members")).select("members")
    graph = stored(kept(leaves.mapInArrow(_start, "v long, u long, d double").withColumn("new", F.lit(True))), "graph")
    for _ in range(ROUNDS):
        around = graph.select("v", "u", "new").union(reverse(graph, REVERSE)).groupBy("v", "u").agg(F.max("new").alias("new"))
        worst = graph.groupBy("v").agg(F.when(F.count("*") == DEGREE, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        about = nodes.select("node", "x").join(worst, nodes["node"] == worst["v"], "left").select(F.col("node").alias("u"), "x", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        met = around.join(about, "u").groupBy("v").agg(F.collect_list(F.struct("u", "new", "worst", "x")).alias("members")).where(F.exists("members", lambda m: m["new"])).select("members")
        offered = met.mapInArrow(_introduced, "v long, u long, d double").withColumn("new", F.lit(True))
        after = stored(kept(graph.select("v", "u", "d", F.lit(False).alias("new")).union(offered)), "graph")
        forget(graph)
        graph = after
        edges, fresh = graph.agg(F.count("*"), F.count_if("new")).first()
        if fresh <= FEW_NEW * edges:
            break
    return graph


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, node, x, y) to (q, node, d), Euclidean in double precision."""
    for batch in batches:
        d = np.zeros(0)
        if batch.num_rows:
            d = np.sqrt(((_matrix(batch.column(2), np.float32).astype(np.float64) - _matrix(batch.column(3), np.float32)) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["q", "node", "d"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, node, d, done): what a greedy search from each query node ``q`` has measured, itself included."""
    both = stored(graph.select("v", "u").union(reverse(graph, BACK).select("v", "u")).distinct(), "adjacency")
    asked = stored(queries.join(nodes.select(F.col("node").alias("q"), F.col("x").alias("y")), "q"), "asked")
    seen = stored(asked.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("done")), "searched")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "node"))
    for _ in range(SEARCH_ROUNDS):
        best = stored(seen.withColumn("rank", rank).where(F.col("rank") <= BEAM).where("not done").select("q", "node"), "best")
        if best.isEmpty():
            break
        none = F.lit(None).cast("double").alias("d")
        reached = best.join(both, best["node"] == both["v"]).select("q", F.col("u").alias("node"), none, F.lit(False).alias("done"))
        expanded = best.select("q", "node", none, F.lit(True).alias("done"))
        merged = stored(seen.union(expanded).union(reached).groupBy("q", "node").agg(F.min("d").alias("d"), F.max("done").alias("done")), "merged")
        fresh = merged.where("d is null").select("q", "node").join(nodes.select("node", "x"), "node").join(asked, "q").select("q", "node", "x", "y")
        measured = fresh.mapInArrow(_measured, "q long, node long, d double").withColumn("done", F.lit(False))
        after = stored(merged.where("d is not null").union(measured), "searched")
        forget(seen, best, merged)
        seen = after
    return seen


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score and measured: the ``top`` nearest found of each query, and how many other
    vectors its search has measured."""
    rows = usable(vectors).groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = stored(rows.select("vec_id", "x", *(F.xxhash64(F.lit(k), "x").alias(f"x{k}") for k in (0, 1))), "vectors")  # a vector is known by 128 bits
    distinct = stored(rows.groupBy("x0", "x1").agg(F.min(F.struct("vec_id", "x")).alias("m"), F.count("*").alias("n")).select("x0", "x1", F.col("m.vec_id").alias("node"), "m.x", "n"), "distinct")
    bits = max(1, math.ceil(math.log2(max(2, distinct.count() / LEAF))))
    some = np.array([r["x"] for r in distinct.orderBy("x0", "node").limit(SAMPLE).select("x").collect()])
    middle = np.median(some @ _planes(some.shape[1], bits), axis=0) if len(some) else np.zeros(0)
    nodes = stored(distinct.select("node", "x").mapInArrow(_leaves(middle, bits), "node long, x binary, leaves array<long>"), "nodes")
    graph = graph_of(nodes)
    of = stored(join_keyed(rows.select("vec_id", "x0", "x1"), distinct.select("x0", "x1", "node", "n"), ["x0", "x1"], "n").select("vec_id", "node"), "of")
    asked = stored(of.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "queries")
    seen = search(nodes, graph, asked.select("q").distinct())
    near = seen.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("d", "node"))).where(F.col("k") <= top + 1).select("q", "node", "d")
    # Copies of a node: more than `top` of the smallest ids are never needed.
    copies = of.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("k") <= top + 1).select("node", "vec_id")
    spread = near.join(copies, "node").select("q", "vec_id", "d")
    counted = seen.groupBy("q").agg((F.count("*") - 1).alias("measured"))
    ranked = asked.join(spread, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= top)
    return ranked.join(counted, "q").select("query_id", "rank", "vec_id", F.col("d").alias("score"), "measured")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
