"""Graphs and result tables that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def together(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Raw edges between values of ``column`` that share an order: loops, duplicates, both directions."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", column)
    return lines.select("l_orderkey", F.col(column).alias("src")).join(lines.select("l_orderkey", F.col(column).alias("dst")), "l_orderkey").select("src", "dst")


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought together."""
    return together(spark, sf_dir, "l_partkey")


def cosupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one order: a dense graph."""
    return together(spark, sf_dir, "l_suppkey")


def lineseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's part and the next line's of the order."""
    lines = table(spark, sf_dir, "lineitem")
    after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return lines.select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null")


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers: bipartite."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"))


def results_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on several devices, made of events."""
    axis = F.array(*(F.lit(a).cast("long") for a in (1, 2, 3, 4, 8, 12, 16, 20, 24, 28, 32)))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("graph"), F.element_at(axis, (F.col("user_id") % 11 + 1).cast("int")).alias("gpus"), F.col("value").alias("counting_time"), F.col("event_id").alias("seq"))


def results_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single runs, made of orders."""
    return table(spark, sf_dir, "orders").select(
        F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("graph"), F.col("o_custkey").alias("nnz"), (F.col("o_totalprice") / 7).alias("preprocessing_time"), F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice") / 3).alias("kernel_time"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 1024).alias("max_memory_consumption"), F.col("o_orderkey").alias("seq")
    )
