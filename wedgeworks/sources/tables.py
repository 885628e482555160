"""Adjacency tables, property files, run reports, side tables and result tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists, publish

# Labels of the run reports, with the column and type of each.
SINGLE_REPORT = {
    "n_blocks": ("Blocks of threads", "bigint"),
    "preprocessing_time": (r"Preprocessing \(ms\)", "double"),
    "kernel_time": (r"Kernel \(ms\)", "double"),
    "triangles": ("Triangles", "bigint"),
}
MULTI_REPORT = {
    "graph": ("Graph", "string"),
    "nodes": (r"Nodes \(declared\)", "bigint"),
    "arcs": (r"Arcs \(declared\)", "bigint"),
    "graph_memory_gib": (r"Graph memory \(GiB\)", "double"),
    "load_time": (r"Load time \(s\)", "double"),
    "partition": ("Partition", "bigint"),
    "tasks_processed": ("Tasks processed", "bigint"),
    "triangles": ("Triangles", "bigint"),
    "counting_time": (r"Counting time \(s\)", "double"),
    "gpus": ("GPUs", "bigint"),
    "triangles_per_sec": ("Triangles/sec", "double"),
}
RESULTS = {
    "single": "exe string, graph string, nrows bigint, ncols bigint, nnz bigint, n_blocks bigint, preprocessing_time double, kernel_time double, triangles bigint, max_memory_consumption bigint",
    "multi": "graph string, nodes bigint, arcs bigint, graph_memory_gib double, load_time double, partition bigint, tasks_processed bigint, triangles bigint, counting_time double, gpus bigint, triangles_per_sec double",
}


def read_adjacency(adjacency: DataFrame) -> DataFrame:
    """Raw edges of ``(src, successors)``."""
    return adjacency.select("src", F.explode("successors").alias("dst"))


def adjacency_nodes(adjacency: DataFrame) -> DataFrame:
    """``nodes``: rows of an adjacency table."""
    return adjacency.agg(F.count("*").alias("nodes"))


def read_properties(lines: DataFrame) -> DataFrame:
    """``(graph, key, value)`` of ``(graph, pos, line)``: split at the first ``=`` and trimmed; lines
    without one are skipped, and the last of a repeated key holds."""
    parts = F.split("line", "=", 2)
    pairs = lines.where(F.instr("line", "=") > 0).select("graph", "pos", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
    return pairs.groupBy("graph", "key").agg(F.max_by("value", "pos").alias("value"))


def graph_size(properties: DataFrame) -> DataFrame:
    """``(graph, nodes, arcs, graph_memory_gib)``; what is missing or no number is 0, an arc 8 bytes."""

    def of(key: str):
        return F.coalesce(F.max(F.when(F.col("key") == key, F.expr("try_cast(value as bigint)"))), F.lit(0))

    return properties.groupBy("graph").agg(of("nodes").alias("nodes"), of("arcs").alias("arcs")).withColumn("graph_memory_gib", F.col("arcs") * 8 / F.lit(2.0**30))


def _parsed(runs: DataFrame, report: dict[str, tuple[str, str]]) -> DataFrame:
    number = {"bigint": r"(-?\d+)", "double": r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", "string": r"(\S+)"}
    return runs.select("run_id", *(F.nullif(F.regexp_extract("text", rf"(?m)^{label}\s*:\s*{number[kind]}", 1), F.lit("")).try_cast(kind).alias(k) for k, (label, kind) in report.items()))


def _split(runs: DataFrame, report: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    parsed = _parsed(runs, report)
    missing = sum((F.col(k).isNull().cast("int") for k in report), F.lit(0))
    return parsed.where(missing == 0), parsed.where(missing > 0).select("run_id")


def parse_single_log(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields of ``(run_id, text)`` reports of single runs, and the runs that lack one."""
    return _split(runs, SINGLE_REPORT)


def parse_multi_log(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for reports of runs on several devices."""
    return _split(runs, MULTI_REPORT)


def append_results(df: DataFrame, path: str, kind: str, batch: str | None = None) -> bool:
    """Append rows to a result table (CSV with a header), all or none of them; columns must match.

    Rows are written aside, and one rename of a small file publishes them: until then no reader sees any, and what a failed run
    has left is never read. A ``batch`` that is published already is not added again, so a run may be repeated. Returns
    whether rows were added.
    """
    want = T.StructType.fromDDL(RESULTS[kind])
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"columns differ from the {kind} results: {df.schema.simpleString()}")
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    batch = batch or attempt
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"no name for a batch: {batch}")
    published = f"{path}/published/{batch}"
    if exists(spark, published):
        return False
    df.write.option("header", True).csv(f"{path}/rows/{attempt}")
    return publish(spark, published, attempt)


def read_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A result table with its types: the rows of all published batches."""
    folders = [f"{path}/rows/{r[0]}" for r in spark.read.text(f"{path}/published").collect()] if exists(spark, f"{path}/published") else []
    return spark.read.schema(RESULTS[kind]).csv(folders, header=True) if folders else spark.createDataFrame([], RESULTS[kind])


def results_report(df: DataFrame, path: str, order: list[str]) -> None:
    """Write all rows, ordered, as one plain text table; results are small by nature."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns))
    body = df.select(F.lit(1).alias("part"), *(F.col(c).alias(f"by_{k}") for k, c in enumerate(order)), line.alias("value"))
    title = df.sparkSession.range(1).select(F.lit(0).alias("part"), *(F.lit(None).cast(df.schema[c].dataType).alias(f"by_{k}") for k, c in enumerate(order)), F.lit("\t".join(df.columns)).alias("value"))
    title.union(body).repartition(1).sortWithinPartitions("part", *(f"by_{k}" for k in range(len(order)))).select("value").write.mode("overwrite").text(path)


def read_partitions(text: DataFrame) -> DataFrame:
    """``(graph, n)`` of JSON objects in ``value``."""
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("graph", "n")).withColumn("n", F.col("n").cast("long"))


def read_denylist(text: DataFrame) -> DataFrame:
    """``pattern``: the lines that are not blank."""
    return text.select(F.trim("value").alias("pattern")).where("pattern <> ''")


def read_names(text: DataFrame) -> DataFrame:
    """``(group, name)`` of graph names, one a line: blanks dropped, ``.mtx`` removed, the last two parts
    of a path kept; ``group`` is null without one."""
    plain = text.select(F.regexp_replace(F.trim("value"), r"\.mtx$", "").alias("v")).where("v <> ''").select(F.split("v", "/").alias("p"))
    return plain.select(F.when(F.size("p") > 1, F.element_at("p", -2)).alias("group"), F.element_at("p", -1).alias("name"))
