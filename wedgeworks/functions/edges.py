"""Edge tables: raw pairs to a simple graph with every edge once, from the smaller to the larger id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import discard, stored


def canonical_edges(raw: DataFrame) -> DataFrame:
    """Undirected edges ``(c, r)`` with ``c < r`` of raw ``(src, dst)``; loops and pairs with a null go."""
    return raw.where("src <> dst").select(F.least("src", "dst").cast("long").alias("c"), F.greatest("src", "dst").cast("long").alias("r"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once. One exchange on ``c``, which later steps by ``c`` share."""
    return edges.repartition("c").dropDuplicates(["c", "r"])


def simple_graph(raw: DataFrame) -> DataFrame:
    """Raw pairs to distinct canonical edges."""
    return distinct_edges(canonical_edges(raw))


def pack_edges(edges: DataFrame) -> DataFrame:
    """Add ``key = c << 32 | r``; ids below 2**31 for c and 2**32 for r keep it positive and reversible."""
    return edges.withColumn("key", F.shiftleft(F.col("c"), 32).bitwiseOR(F.col("r")))


def unpack_edges(keys: DataFrame) -> DataFrame:
    """``(c, r)`` of packed keys."""
    return keys.select(F.shiftrightunsigned("key", 32).alias("c"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("r"))


def pad_vertices(n: Column, width: int = 32) -> Column:
    """A vertex count rounded up to a multiple of the tile width."""
    return (F.floor((n + (width - 1)) / width) * width).cast("long")


def vertex_count(edges: DataFrame) -> DataFrame:
    """``n``, one more than the largest id; 0 without edges."""
    return edges.agg(F.coalesce(F.max("r") + 1, F.lit(0)).alias("n"))


def flagged_select(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag is true."""
    return df.where(flag)


def drop_single_pivots(edges: DataFrame) -> DataFrame:
    """Edges of pivots with two larger neighbours at least; others close no triangle."""
    return edges.withColumn("k", F.count("*").over(W.partitionBy("c"))).where("k >= 2").drop("k")


def union_blocks(*blocks: DataFrame) -> DataFrame:
    """Distinct edges of several edge tables."""
    out = blocks[0]
    for other in blocks[1:]:
        out = out.unionByName(other)
    return distinct_edges(out)


def sort_edges(edges: DataFrame) -> DataFrame:
    """Edges in order of (c, r)."""
    return edges.orderBy("c", "r")


def by_degree(edges: DataFrame) -> DataFrame:
    """``(c, r, rank)``: edges directed from the end of lower (degree, id) to the other, ``rank`` being the other's
    degree. This bounds larger neighbours by the root of twice the edges. ``edges`` is read twice; each join is stored,
    and what it read is deleted if it was stored for this, so that one shuffle at a time is on disk."""
    degrees = stored(edges.select(F.explode(F.array("c", "r")).alias("v")).groupBy("v").agg(F.count("*").alias("d")), "degrees")
    half = stored(edges.join(degrees.withColumnsRenamed({"v": "c", "d": "dc"}), "c"), "half")
    discard(edges)
    up = (F.col("dc") < F.col("dr")) | ((F.col("dc") == F.col("dr")) & (F.col("c") < F.col("r")))
    both = half.join(degrees.withColumnsRenamed({"v": "r", "d": "dr"}), "r")
    directed = stored(both.select(F.when(up, F.col("c")).otherwise(F.col("r")).alias("c"), F.when(up, F.col("r")).otherwise(F.col("c")).alias("r"), F.greatest("dc", "dr").alias("rank")), "directed")
    discard(half)
    discard(degrees)
    return directed
