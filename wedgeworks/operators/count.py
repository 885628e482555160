"""Triangles of a simple graph ``edges(c, r)``, ``c < r``, distinct."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edges import by_degree
from ..sources.graph import saved_neighbours
from ..sources.shared import discard, exists, stored
from . import triples as tr

#: Colours up to which ``auto`` deals edges to triples, each edge to as many as there are colours.
MOST_COLOURS = 32
#: Neighbours in an array; what a vertex has more of goes into further arrays, which tasks share.
PART = 1024
#: Neighbours that a portion of the pivots sends: so many for an edge, and ``PORTION`` in all at least.
SENT, PORTION = 4, 50_000_000
METHODS, ORIENTS = ("auto", "adjacency", "tile", "wedge", "triples"), ("id", "degree")


def wedges(edges: DataFrame) -> DataFrame:
    """``(i, j, k)``: pairs ``j < k`` of larger neighbours of a pivot i."""
    one, two = edges.select(F.col("c").alias("i"), F.col("r").alias("j")), edges.select(F.col("c").alias("i"), F.col("r").alias("k"))
    return one.join(two, "i").where("j < k")


def _kept(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges stored in order of (c, r) within their partitions, and how many they are."""
    edges = stored(edges.select("c", "r").sortWithinPartitions("c", "r"), "edges")
    return edges, edges.count()


def triangles(edges: DataFrame) -> DataFrame:
    """``(i, j, k)``, ``i < j < k``: every triangle once. Wedges are closed in the tasks that edges are dealt to and never are rows."""
    return tr.triangles(*_kept(edges))


def tile_join(edges: DataFrame) -> DataFrame:
    """``(c, r, tile, common)``: for a pivot's tile t and each larger neighbour k with ``k div 32 >= t``, how many larger
    neighbours of the pivot in t are smaller neighbours of k; a row where both have any in t. Tiles meet in the tasks
    that edges are dealt to."""
    return tr.tile_counts(*_kept(edges))


def neighbours(directed: DataFrame) -> DataFrame:
    """``(c, near)``: the vertices that c leads to, in order of rank, of ``directed(c, r, rank)``."""
    return directed.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"]).alias("near"))


def closed(near: DataFrame, pivots: Column | None = None) -> DataFrame:
    """``(i, j, ks)`` of the stored lists of ``neighbours`` in an acyclic graph: for an edge from i
    to j, the vertices that both lead to and that come after j. Every triangle is met once; ``pivots`` picks those by their ``c = i``.

    A vertex sends to each of its neighbours only those beyond. Neighbours of a hub lie in parts, and pairs of parts
    are dealt to tasks before they are opened, so that no task opens a hub alone. Where lists lie in buckets by c, and
    none is a hub's, they receive without an exchange.
    """
    n = F.size("near")
    beyond = F.expr("slice(near, at + 2, size(near))").alias("beyond")
    own = near if pivots is None else near.where(pivots)
    sent = own.where((n > 1) & (n <= PART)).select("c", "near", F.posexplode("near").alias("at", "r")).where(F.col("at") < n - 1).select("c", "r", beyond)
    hubs, received = near.where(n > PART), near.select(F.col("c").alias("r"), F.col("near").alias("part"))
    if not hubs.isEmpty():
        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / PART).cast("int") - 1), lambda k: F.slice("near", k * PART + 1, F.lit(PART)))
        later = F.expr("slice(parts, a + 1, size(parts))")
        pairs = own.where(n > PART).select("c", parts.alias("parts")).select("c", "parts", F.posexplode("parts").alias("a", "one")).select("c", "a", "one", F.posexplode(later).alias("b", "near")).repartition("c", "a", "b")
        inside = pairs.where("b = 0").select("c", "near", F.posexplode("near").alias("at", "r")).select("c", "r", beyond)
        sent = sent.union(inside).union(pairs.where("b > 0").select("c", F.explode("one").alias("r"), F.col("near").alias("beyond")))
        received = near.where(n <= PART).select(F.col("c").alias("r"), F.col("near").alias("part")).union(hubs.select(F.col("c").alias("r"), F.explode(parts).alias("part")))
    return sent.join(received, "r").select(F.col("c").alias("i"), F.col("r").alias("j"), F.array_intersect("beyond", "part").alias("ks"))


def closings(near: DataFrame) -> DataFrame:
    """One row ``t``, null for none: how many triangles ``closed`` meets. Pivots are taken in portions, each of which sends up to
    ``SENT`` neighbours for an edge and leaves a number behind and no shuffle files, so that disk goes with the edges and not with the wedges."""
    n = F.size("near").cast("long")
    m, sent = near.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.expr("size(near) * (size(near) - 1L) div 2")), F.lit(0))).first()
    portions = math.ceil(sent / max(PORTION, SENT * m))
    count = lambda pivots: closed(near, pivots).agg(F.sum(F.size("ks")).alias("t"))
    if portions < 2:
        return count(None)
    share = F.pmod(F.xxhash64("c", F.lit("portion")), F.lit(portions))
    return reduce(DataFrame.union, [stored(count(share == k), "portion") for k in range(portions)]).agg(F.sum("t").alias("t"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """``(c, r, n)`` for every edge: vertices between, neighbours of c above and of r below."""
    edges, m = _kept(edges)
    found = tr.between(edges, m)  # stored before it is summed up by edge
    discard(edges)
    return found


def count_saved(spark: SparkSession, name: str) -> DataFrame:
    """One row ``triangles`` of a graph saved by ``save_graph``, off its neighbour lists: one exchange, of what is sent."""
    return closings(saved_neighbours(spark, name)).select(F.coalesce("t", F.lit(0)).cast("long").alias("triangles"))


def count_triangles(edges: DataFrame, method: str = "auto", orient: str | None = None) -> DataFrame:
    """One row ``triangles``. ``method``: adjacency, tile, wedge, triples (edges dealt to triples of colours), or auto
    (stored edges; triples up to some 700 million of them, beyond that adjacency);
    ``orient``, for adjacency: degree (the default, which bounds a hub's larger neighbours), or id. The total
    depends on neither."""
    if method not in METHODS or orient not in (None, *ORIENTS):
        raise ValueError(f"no such way to count: {method}, {orient}; there are {METHODS}, {ORIENTS}")
    if orient == "degree" and method in ("tile", "wedge", "triples"):
        raise ValueError(f"{method} goes by id")
    if method in ("auto", "triples"):
        edges, m = _kept(edges)
        if method == "auto":
            few = tr.colours(m, edges.sparkSession.sparkContext.defaultParallelism) <= MOST_COLOURS
            method = "adjacency" if orient == "degree" or not few else "triples"
    if method == "tile":
        found = tile_join(edges).agg(F.sum("common").alias("t"))
    elif method == "triples":
        found = tr.total(edges, m).agg(F.sum("t").alias("t"))
    elif method == "wedge":
        found = triangles(edges).agg(F.count("*").alias("t"))
    else:
        if orient == "id":
            near = stored(neighbours(edges.withColumn("rank", F.col("r"))), "neighbours")
        else:
            directed = by_degree(stored(edges.select("c", "r"), "edges"))
            near = stored(neighbours(directed), "neighbours")
            discard(directed)
        found = closings(near)
    return found.select(F.coalesce("t", F.lit(0)).cast("long").alias("triangles"))


def partial_triangles(edges: DataFrame, block: int) -> DataFrame:
    """``(mid_block, high_block, triangles)`` by the blocks of the middle and the highest vertex, ``block`` vertices each."""
    return tr.block_counts(*_kept(edges), block)


def block_pair_join(edges: DataFrame, block: int, pairs: DataFrame, path: str) -> DataFrame:
    """``(mid_block, high_block, triangles)`` of the tasks ``pairs(mid_block, high_block)``: middle vertex in the one block, highest in
    the other, ``block`` vertices each.

    Edges whose larger end lies in a block of the tasks are dealt to triples, and the tasks are one join with the counts. Counts go into a table at ``path``, a partition for each pair, and pairs
    that it holds already are left out: work that stopped is resumed by the same call, and portions of the pairs may run one by one.
    """
    spark, keys = edges.sparkSession, ["mid_block", "high_block"]
    schema = "triangles long, mid_block long, high_block long"
    held = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    todo = stored(pairs.select(*keys).distinct().join(held.select(*keys), keys, "left_anti"), "todo")  # a row a pair of blocks
    if not todo.isEmpty():
        mids, highs = (F.broadcast(todo.select(F.col(k).alias("block"), F.lit(True).alias(k)).distinct()) for k in keys)  # a row a block
        asked = edges.select("c", "r", F.expr(f"r div {block}").alias("block")).join(mids, "block", "left").join(highs, "block", "left").where("mid_block or high_block")
        edges = stored(asked.select("c", "r"), "edges")
        found = tr.block_counts(edges, edges.count(), block, joined=True)
        told = todo.join(found, keys, "left").select(F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"), *keys)
        told.repartition(*keys).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        held = spark.read.schema(schema).parquet(path)
    return held.join(pairs.select(*keys).distinct(), keys, "left_semi").select(*keys, "triangles")
