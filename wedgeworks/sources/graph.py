"""Graphs saved once, laid out for the joins that count on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edges import by_degree
from .shared import delete, discard, new_path, stored, swept

#: Rows of a bucket, which one task reads.
BUCKET = 4_000_000


def _save(df: DataFrame, name: str, buckets: int, order: list[str]) -> None:
    """One file a bucket: rows are brought together by the hash that the buckets go by."""
    path = new_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.repartition(buckets, "c").write.bucketBy(buckets, "c").sortBy(*order).option("path", path).saveAsTable(name)


def save_graph(edges: DataFrame, name: str, buckets: int | None = None) -> None:
    """Save ``edges(c, r)`` as table ``name``, in buckets by c and sorted by (c, r), and as table ``name_near`` each vertex's
    neighbours in order of degree (see ``neighbours``), in the same buckets.

    Whatever groups or joins by c afterwards, on either table or both, needs no exchange. ``buckets`` defaults to one for
    every ``BUCKET`` edges, but for as many as there are cores at least.
    """
    from ..operators.count import neighbours

    spark = edges.sparkSession
    edges = stored(edges.select("c", "r"), "edges")
    if buckets is None:
        buckets = max(math.ceil(edges.count() / BUCKET), spark.sparkContext.defaultParallelism)
    _save(edges, name, buckets, ["c", "r"])
    discard(edges)
    directed = by_degree(spark.table(name))
    _save(neighbours(directed), f"{name}_near", buckets, ["c"])
    discard(directed)


def saved_edges(spark: SparkSession, name: str) -> DataFrame:
    """The edges of a saved graph."""
    return spark.table(name)


def saved_neighbours(spark: SparkSession, name: str) -> DataFrame:
    """``(c, near)`` of a saved graph."""
    return spark.table(f"{name}_near")


def drop_graph(spark: SparkSession, name: str) -> None:
    """Drop a saved graph with its files."""
    for table in (name, f"{name}_near"):
        place = spark.sql(f"DESCRIBE FORMATTED {table}").where(F.col("col_name") == "Location").first()["data_type"]
        spark.sql(f"DROP TABLE {table}")
        delete(spark, place)
