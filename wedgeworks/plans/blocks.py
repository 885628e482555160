"""Vertex blocks: which block pair an edge lies in, how much each holds, and tasks over the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tiles import WIDTH, upper_tiles

THRESHOLD = 10**9


def block_size(n: int, parts: int) -> int:
    """Vertices a block: a share of ``n`` rounded up to whole tiles, one tile at least."""
    return max(1, -(-(n // parts) // WIDTH)) * WIDTH


def assign_blocks(edges: DataFrame, block: int) -> DataFrame:
    """Edges with ``r_block`` and ``c_block``."""
    return edges.select("c", "r", F.expr(f"r div {block}").alias("r_block"), F.expr(f"c div {block}").alias("c_block"))


def worker_share(blocked: DataFrame, worker: int, workers: int, blocks: int) -> DataFrame:
    """Edges that one worker needs: it owns a contiguous run of blocks, the last worker the rest too."""
    share = blocks // workers
    start, end = worker * share, blocks if worker == workers - 1 else (worker + 1) * share
    return blocked.where((F.col("c_block") < end) & (F.col("r_block") >= start))


def block_edge_matrix(blocked: DataFrame) -> DataFrame:
    """``(r_block, c_block, nnz)``: edges of each pair as they come, duplicates included."""
    return blocked.groupBy("r_block", "c_block").agg(F.count("*").alias("nnz"))


def cumulative_block_matrix(matrix: DataFrame, blocks: int) -> DataFrame:
    """``(r_block, c_block, nnz, cum_nnz)`` of the dense lower triangle, running along ``c_block``."""
    spark = matrix.sparkSession
    dense = spark.range(blocks).select(F.col("id").alias("r_block"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("c_block"))
    along = W.partitionBy("r_block").orderBy("c_block")
    return dense.join(matrix, ["r_block", "c_block"], "left").select("r_block", "c_block", F.coalesce("nnz", F.lit(0)).alias("nnz")).withColumn("cum_nnz", F.sum("nnz").over(along))


def plan_tasks(cumulative: DataFrame, threshold: int = THRESHOLD, first: int = 0, end: int | None = None) -> DataFrame:
    """``(task_id, mid_block, high_blocks, kind)`` for the middle blocks of one worker.

    Diagonal tasks come first, blocks descending; then for each middle block, descending, its higher
    blocks ascending in groups whose summed ``cum_nnz`` stays strictly below the threshold. A group that
    would reach it is closed and the block at hand opens the next, alone if it is too large itself.
    """
    mine = F.col("mid_block") >= first if end is None else F.col("mid_block").between(first, end - 1)
    cells = cumulative.select(F.col("c_block").alias("mid_block"), F.col("r_block").alias("high"), "cum_nnz").where(mine)
    diagonal = cells.where("high = mid_block").select("mid_block", F.array("high").alias("high_blocks"), F.lit("diagonal").alias("kind"), F.lit(0).alias("part"))
    ordered = cells.where("high > mid_block").groupBy("mid_block").agg(F.sort_array(F.collect_list(F.struct("high", "cum_nnz"))).alias("row"))
    start = F.expr("named_struct('sum', 0L, 'groups', cast(array() as array<array<bigint>>))")

    def step(s, x):
        joins = (F.size(s["groups"]) > 0) & (s["sum"] + x["cum_nnz"] < threshold)
        grown = F.concat(F.slice(s["groups"], 1, F.size(s["groups"]) - 1), F.array(F.concat(F.element_at(s["groups"], -1), F.array(x["high"]))))
        return F.when(joins, F.struct((s["sum"] + x["cum_nnz"]).alias("sum"), grown.alias("groups"))).otherwise(F.struct(x["cum_nnz"].alias("sum"), F.concat(s["groups"], F.array(F.array(x["high"]))).alias("groups")))

    packed = ordered.select("mid_block", F.posexplode(F.aggregate("row", start, step)["groups"]).alias("part", "high_blocks"))
    tasks = diagonal.unionByName(packed.select("mid_block", "high_blocks", F.lit("off_diagonal").alias("kind"), "part"))
    # As many rows as block pairs at most.
    number = F.row_number().over(W.orderBy(F.col("kind") != "diagonal", F.desc("mid_block"), "part")).cast("long") - 1
    return tasks.select(number.alias("task_id"), "mid_block", "high_blocks", "kind")


def block_work_estimate(edges: DataFrame, block: int, mid: int, highs: list[int]) -> DataFrame:
    """``(warps, blocks)`` of an off-diagonal task: a pivot's upper tiles in the middle block times its
    edges into the high blocks in steps of 32."""
    low = edges.where(F.expr(f"c div {block} <= {mid}"))
    tiles = upper_tiles(low.where(F.expr(f"r div {block} = {mid}"))).groupBy("c").agg(F.count("*").alias("tiles"))
    reach = low.where(F.expr(f"r div {block}").isin(highs)).groupBy("c").agg(F.count("*").alias("n"))
    steps = tiles.join(reach, "c").agg(F.coalesce(F.sum(F.expr(f"tiles * ((n + {WIDTH - 1}) div {WIDTH})")), F.lit(0)).alias("warps"))
    return steps.select("warps", F.expr("(warps + 3) div 4").alias("blocks"))


def run_summary(partials: DataFrame, tasks: DataFrame, sizes: DataFrame, devices: int, seconds: float) -> DataFrame:
    """One row a graph: sums of counts and tasks, triangles a second (0 for no time), and its size."""
    total = partials.agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))
    n = tasks.agg(F.count("*").alias("tasks_processed"))
    rate = F.when(F.lit(seconds) > 0, F.col("triangles") / F.lit(seconds)).otherwise(0.0)
    return sizes.join(F.broadcast(total)).join(F.broadcast(n)).select("graph", "nodes", "arcs", "graph_memory_gib", "tasks_processed", "triangles", F.lit(devices).cast("long").alias("gpus"), rate.alias("triangles_per_sec"))
