"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_keyed, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): smallest neighbour and number of links of every node."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    linked = join_keyed(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    out = stored(linked.distinct(), "large")
    forget(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    to_least = join_keyed(down, least, ["u"], "n").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stored(to_least.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    forget(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``, root being the component's smallest node.

    Nulls and self-links are dropped; no edges give no rows. Minima are aggregated before they are shuffled and
    joined back on the node; a hub whose links are too many for a task has its minimum broadcast.
    """
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "stars")
    was = None
    while (state := _state(now)) != was:
        was = state
        large = large_star(now)
        after = small_star(large)
        forget(now, large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
