"""Registered queries and their SQL. Every query derives its graph or result table from the given tables.

The SQL states the result by plain joins and groupings, not by the plan of the Spark side.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import edges as ed
from .functions import tiles as ti
from .operators import count as co
from .operators import results as re
from .operators import scan as sc
from .plans import blocks as bl
from .sources import graph as gr
from .sources import mtx
from .sources import packed as pk
from .sources import tables as ta
from .sources.shared import new_path, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Common table expressions of the SQL side.
RAW = "raw AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey))"
RAW_SUPP = "raw AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey))"
RAW_PARTSUPP = "raw AS (SELECT l_partkey AS src, 10000000 + l_suppkey AS dst FROM lineitem)"
RAW_SEQ = "raw AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
EDGES = "e AS (SELECT DISTINCT least(src, dst) AS c, greatest(src, dst) AS r FROM raw WHERE src <> dst)"
UPPER = "u AS (SELECT c, r // 32 AS tile, bit_or(1::BIGINT << (31 - r % 32)::INT) AS mask FROM e GROUP BY ALL)"
LOWER = "l AS (SELECT c // 32 AS tile, r, bit_or(1::BIGINT << (31 - c % 32)::INT) AS mask FROM e GROUP BY ALL)"
DEGREE = "d AS (SELECT c AS key, count(*) AS n FROM e GROUP BY c)"
TRIANGLES = "t AS (SELECT a.c AS i, a.r AS j, b.r AS k FROM e a JOIN e b ON a.c = b.c AND a.r < b.r JOIN e x ON x.c = a.r AND x.r = b.r)"
PARTS = 8
#: Block size as the tables' sizes give it: vertices over PARTS, rounded up to whole tiles.
BLOCK_SQL = f"greatest(1, (((SELECT max(l_partkey) + 1 FROM lineitem) // {PARTS} + 31) // 32)) * 32"
COPART, BASE = f"WITH {RAW}, {EDGES}", f"WITH {RAW}"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str, name: str = "copart") -> DataFrame:
    raw = getattr(fx, name)(spark, sf_dir)
    # Two lines of an order lead both ways; one way makes the same simple graph.
    return ed.simple_graph(raw.where("src < dst") if name in ("copart", "cosupp") else raw)


def _block(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Vertices a block, and blocks, of the co-purchase graph."""
    n = fx.table(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0] + 1
    size = bl.block_size(n, PARTS)
    return size, -(-n // size)


# ---- counting


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir))


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_adjacency(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir), "adjacency", orient="id")


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_tile(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir), "tile")


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_wedge(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir), "wedge")


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_triples(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir), "triples")


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_saved(spark, sf_dir):
    """The graph saved in buckets, and counted as it lies."""
    name = f"copart_{uuid.uuid4().hex}"
    gr.save_graph(_graph(spark, sf_dir), name)
    found = stored(co.count_saved(spark, name), "count")
    gr.drop_graph(spark, name)
    return found


@query(f"{COPART}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_by_degree(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir), "adjacency", orient="degree")


@query(f"WITH {RAW_SUPP}, {EDGES}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_dense(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir, "cosupp"))


@query(f"WITH {RAW_PARTSUPP}, {EDGES}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_bipartite(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir, "partsupp"))


@query(f"WITH {RAW_SEQ}, {EDGES}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def count_triangles_sequence(spark, sf_dir):
    return co.count_triangles(_graph(spark, sf_dir, "lineseq"))


@query(f"{COPART} SELECT a.c AS i, count(*) AS n FROM e a JOIN e b ON a.c = b.c AND a.r < b.r GROUP BY a.c")
def wedges(spark, sf_dir):
    return co.wedges(_graph(spark, sf_dir)).groupBy("i").agg(F.count("*").alias("n"))


@query(f"{COPART}, {TRIANGLES} SELECT i, count(*) AS n, sum(j)::BIGINT AS js, sum(k)::BIGINT AS ks FROM t GROUP BY i")
def triangles(spark, sf_dir):
    return co.triangles(_graph(spark, sf_dir)).groupBy("i").agg(F.count("*").alias("n"), F.sum("j").alias("js"), F.sum("k").alias("ks"))


@query(f"{COPART}, {TRIANGLES} SELECT e.c, e.r, count(t.j)::BIGINT AS n FROM e LEFT JOIN t ON t.i = e.c AND t.k = e.r GROUP BY ALL")
def common_neighbours(spark, sf_dir):
    return co.common_neighbours(_graph(spark, sf_dir))


@query(f"{COPART}, {UPPER}, {LOWER} SELECT e.c, e.r, u.tile, bit_count(u.mask & l.mask)::BIGINT AS common FROM e JOIN u ON u.c = e.c AND u.tile <= e.r // 32 JOIN l ON l.tile = u.tile AND l.r = e.r")
def tile_join(spark, sf_dir):
    return co.tile_join(_graph(spark, sf_dir))


# ---- edges


@query(f"{BASE} SELECT least(src, dst) AS c, greatest(src, dst) AS r FROM raw WHERE src <> dst")
def canonical_edges(spark, sf_dir):
    return ed.canonical_edges(fx.copart(spark, sf_dir))


@query(f"{COPART} SELECT c, r FROM e")
def distinct_edges(spark, sf_dir):
    return ed.distinct_edges(ed.canonical_edges(fx.copart(spark, sf_dir)))


@query(f"{COPART} SELECT c, r, (c << 32) | r AS key FROM e")
def pack_edges(spark, sf_dir):
    return ed.pack_edges(_graph(spark, sf_dir))


@query(f"{COPART} SELECT c, r FROM e")
def unpack_edges(spark, sf_dir):
    return ed.unpack_edges(ed.pack_edges(_graph(spark, sf_dir)))


@query(f"{COPART} SELECT max(r) + 1 AS n, (max(r) + 1 + 31) // 32 * 32 AS padded FROM e")
def pad_vertices(spark, sf_dir):
    return ed.vertex_count(_graph(spark, sf_dir)).select("n", ed.pad_vertices(F.col("n")).alias("padded"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def flagged_select(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    return ed.flagged_select(lines, (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).select("l_orderkey", "l_partkey", "l_linenumber")


@query(f"{COPART} SELECT c, r FROM e WHERE c IN (SELECT c FROM e GROUP BY c HAVING count(*) >= 2)")
def drop_single_pivots(spark, sf_dir):
    return ed.drop_single_pivots(_graph(spark, sf_dir))


@query(f"{COPART} SELECT c, r, row_number() OVER (ORDER BY c, r) - 1 AS pos FROM e")
def sort_edges(spark, sf_dir):
    return sc.positions_of(_graph(spark, sf_dir), ["c", "r"])


@query(f"{COPART}, {LOWER} SELECT tile, r, row_number() OVER (ORDER BY tile, r) - 1 AS pos FROM l")
def sort_pairs(spark, sf_dir):
    return sc.positions_of(ti.lower_tiles(_graph(spark, sf_dir)), ["tile", "r"])


@query(f"{COPART} SELECT c, r FROM e WHERE r // ({BLOCK_SQL}) IN (1, 2, 5)")
def union_blocks(spark, sf_dir):
    size, _ = _block(spark, sf_dir)
    e = ed.canonical_edges(fx.copart(spark, sf_dir))
    return ed.union_blocks(*(e.where(F.expr(f"r div {size} = {b}")) for b in (1, 2, 5)))


# ---- tiles


@query(f"{COPART} SELECT c, r, 1::BIGINT << (31 - r % 32)::INT AS mask FROM e")
def tile_mask(spark, sf_dir):
    return _graph(spark, sf_dir).select("c", "r", ti.tile_mask("r").alias("mask"))


@query(f"{COPART}, {UPPER} SELECT c, tile, bit_count(mask)::BIGINT AS ones FROM u")
def mask_popcount(spark, sf_dir):
    return ti.upper_tiles(_graph(spark, sf_dir)).select("c", "tile", ti.mask_popcount(F.col("mask")).alias("ones"))


_N = "(SELECT (max(r) + 32) // 32 * 32 FROM e)"


def _padded(e: DataFrame) -> int:
    return ed.vertex_count(e).select(ed.pad_vertices(F.col("n"))).first()[0]


@query(f"{COPART} SELECT c, r, r + (c // 32) * {_N} AS lower_key, c * ({_N} // 32) + r // 32 AS upper_key FROM e")
def tile_keys(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return ti.tile_keys(e, _padded(e))


@query(f"{COPART} SELECT c // 32 AS lower_tile, r AS lower_r, c AS upper_c, r // 32 AS upper_tile FROM e")
def decode_tile_keys(spark, sf_dir):
    e = _graph(spark, sf_dir)
    n = _padded(e)
    return ti.decode_keys(ti.tile_keys(e, n), n)


@query(f"{COPART}, {LOWER} SELECT * FROM l")
def lower_tiles(spark, sf_dir):
    return ti.lower_tiles(_graph(spark, sf_dir))


@query(f"{COPART}, {UPPER} SELECT * FROM u")
def upper_tiles(spark, sf_dir):
    return ti.upper_tiles(_graph(spark, sf_dir))


@query(f"{COPART}, {UPPER} SELECT a.c, a.tile, sum(bit_count(b.mask))::BIGINT AS ones FROM u a JOIN u b ON a.c = b.c AND b.tile >= a.tile GROUP BY a.c, a.tile")
def suffix_ones(spark, sf_dir):
    return ti.suffix_ones(ti.upper_tiles(_graph(spark, sf_dir)))


_WORK = """p AS (SELECT * FROM e WHERE c IN (SELECT c FROM e GROUP BY c HAVING count(*) >= 2)),
pu AS (SELECT DISTINCT c, r // 32 AS tile FROM p),
s AS (SELECT pu.c, pu.tile, count(*) AS ones FROM pu JOIN p ON p.c = pu.c AND p.r // 32 >= pu.tile GROUP BY ALL)"""


@query(f"{COPART}, {_WORK} SELECT sum((ones + 31) // 32)::BIGINT AS warps, ((sum((ones + 31) // 32) + 3) // 4)::BIGINT AS blocks FROM s")
def work_estimate(spark, sf_dir):
    return ti.work_estimate(_graph(spark, sf_dir))


# ---- scans and lookups


def _reduced(op: str):
    sql = f"SELECT l_partkey, {op}(l_suppkey)::BIGINT AS l_suppkey FROM lineitem GROUP BY l_partkey"

    def run(spark, sf_dir):
        return sc.reduce_by_key(fx.table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", op)

    run.__name__ = f"reduce_by_key_{op}"
    query(sql)(run)


for _op in sc.REDUCTIONS:
    _reduced(_op)


#: A product of numbers a + b * sqrt(5) modulo a prime, and lists of the three largest: what no built-in reduces.
PRIME = 10_007


def _product(x: pa.StructArray, y: pa.StructArray) -> pa.StructArray:
    (a, b), (c, d) = ([z.field(i).to_numpy() for i in (0, 1)] for z in (x, y))
    return pa.StructArray.from_arrays([pa.array((a * c + 5 * b * d) % PRIME), pa.array((a * d + b * c) % PRIME)], ["a", "b"])


def _largest(x: pa.ListArray, y: pa.ListArray) -> pa.ListArray:
    row = np.concatenate([pc.list_parent_indices(z).to_numpy() for z in (x, y)])
    value = np.concatenate([z.flatten().to_numpy() for z in (x, y)])
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    starts = np.searchsorted(row, np.arange(len(x)))
    keep = np.arange(len(row)) - starts[row] < 3
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[keep], np.arange(len(x) + 1)).astype(np.int32)), pa.array(value[keep]))


@query(
    f"""SELECT l_partkey, x.a AS a, x.b AS b FROM (SELECT l_partkey, list_reduce(list({{'a': (l_suppkey + 1)::BIGINT, 'b': l_linenumber::BIGINT}}),
lambda x, y: {{'a': (x.a * y.a + 5 * x.b * y.b) % {PRIME}, 'b': (x.a * y.b + x.b * y.a) % {PRIME}}}) AS x FROM lineitem GROUP BY l_partkey)"""
)
def reduce_by_key_product(spark, sf_dir):
    number = F.struct((F.col("l_suppkey") + 1).cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    lines = fx.table(spark, sf_dir, "lineitem").select("l_partkey", number.alias("x"))
    return sc.reduce_by_key(lines, ["l_partkey"], "x", _product).select("l_partkey", "x.a", "x.b")


@query("SELECT l_suppkey, array_to_string(list_slice(list_reverse_sort(list(l_orderkey)), 1, 3), ',') AS largest FROM lineitem GROUP BY l_suppkey")
def reduce_by_key_largest(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_suppkey", F.array(F.col("l_orderkey").cast("long")).alias("x"))
    return sc.reduce_by_key(lines, ["l_suppkey"], "x", _largest).select("l_suppkey", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("largest"))


@query(f"{COPART} SELECT c AS key, count(*) AS n FROM e GROUP BY c")
def histogram(spark, sf_dir):
    return sc.histogram(_graph(spark, sf_dir), "c")


@query(f"{COPART}, {DEGREE} SELECT x AS key, coalesce(n, 0) AS n FROM range((SELECT max(r) + 1 FROM e)) g(x) LEFT JOIN d ON d.key = x")
def histogram_dense(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return sc.histogram(e, "c", ed.vertex_count(e).first()[0])


@query("SELECT l_suppkey AS key, count(*) AS length FROM lineitem GROUP BY l_suppkey")
def run_lengths(spark, sf_dir):
    return sc.run_lengths(fx.table(spark, sf_dir, "lineitem"), "l_suppkey")


@query("SELECT p_partkey, coalesce(sum(l_linenumber), 0)::BIGINT AS total FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def segmented_sum(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    return sc.segmented_sum(lines, fx.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "l_linenumber")


@query("SELECT sum(l_linenumber)::BIGINT AS total FROM lineitem")
def total_sum(spark, sf_dir):
    return sc.total_sum(fx.table(spark, sf_dir, "lineitem"), "l_linenumber")


_ORDERS = "o AS (SELECT o_orderkey AS pos, o_custkey AS value FROM orders)"


def _scan(kind: str, spark, sf_dir):
    return sc.prefix_sum(fx.table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", kind)


@query(f"WITH {_ORDERS} SELECT pos, value, sum(value) OVER (ORDER BY pos)::BIGINT - value AS prefix FROM o")
def prefix_sum_exclusive(spark, sf_dir):
    return _scan("exclusive", spark, sf_dir)


@query(f"WITH {_ORDERS} SELECT pos, value, sum(value) OVER (ORDER BY pos)::BIGINT AS prefix FROM o")
def prefix_sum_inclusive(spark, sf_dir):
    return _scan("inclusive", spark, sf_dir)


@query(f"WITH {_ORDERS} SELECT pos, value, sum(value) OVER (ORDER BY pos)::BIGINT - value AS prefix FROM o UNION ALL SELECT NULL, 0, sum(value)::BIGINT FROM o")
def prefix_sum_complete(spark, sf_dir):
    return _scan("complete", spark, sf_dir)


_OFFSETS = "f AS (SELECT key, (sum(n) OVER (ORDER BY key) - n)::BIGINT AS start, sum(n) OVER (ORDER BY key)::BIGINT AS stop FROM d)"


@query(f"{COPART}, {DEGREE}, {_OFFSETS} SELECT * FROM f")
def offsets(spark, sf_dir):
    return sc.offsets(_graph(spark, sf_dir), "c")


@query(f"{COPART}, {DEGREE}, {_OFFSETS}, p AS (SELECT row_number() OVER (ORDER BY c, r) - 1 AS pos FROM e) SELECT pos, key FROM p ASOF JOIN f ON p.pos >= f.start")
def segment_lookup(spark, sf_dir):
    e = stored(_graph(spark, sf_dir), "edges")
    return sc.segment_lookup(sc.positions_of(e, ["c", "r"]).select("pos"), sc.offsets(e, "c"))


@query("SELECT o_orderkey AS pos, p_size::BIGINT AS value FROM orders LEFT JOIN part ON p_partkey = o_custkey * 3")
def gather(spark, sf_dir):
    values = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("long").alias("value"))
    return sc.gather(values, fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 3).alias("idx")))


@query(f"{COPART}, {LOWER}, k AS (SELECT c // 32 AS tile, r + 1 AS r FROM e) SELECT k.tile, k.r, coalesce(mask, 0) AS mask FROM k LEFT JOIN l USING (tile, r)")
def point_lookup(spark, sf_dir):
    e = _graph(spark, sf_dir)
    keys = e.select(ti.tile_of("c").alias("tile"), (F.col("r") + 1).alias("r"))
    return sc.point_lookup(keys, ti.lower_tiles(e), ["tile", "r"], "mask", F.lit(0).cast("long")).select("tile", "r", "mask")


@query("SELECT key, start FROM (SELECT o_orderkey AS key, o_custkey AS start, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE start < before")
def monotone_check(spark, sf_dir):
    return sc.monotone_check(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("start")))


@query(f"{COPART}, {DEGREE}, {_OFFSETS} SELECT key, start FROM f WHERE start < 0")
def monotone_check_offsets(spark, sf_dir):
    return sc.monotone_check(sc.offsets(_graph(spark, sf_dir), "c"))


# ---- blocks


_BLOCKED = f"b AS (SELECT least(src, dst) AS c, greatest(src, dst) AS r, greatest(src, dst) // ({BLOCK_SQL}) AS r_block, least(src, dst) // ({BLOCK_SQL}) AS c_block FROM raw WHERE src <> dst)"
_MATRIX = "m AS (SELECT r_block, c_block, count(*) AS nnz FROM b GROUP BY ALL)"
_COUNT = f"(((SELECT max(l_partkey) + 1 FROM lineitem) + ({BLOCK_SQL}) - 1) // ({BLOCK_SQL}))"
_DENSE = f"""n AS (SELECT x.i AS r_block, y.i AS c_block FROM range({_COUNT}) x(i), range({_COUNT}) y(i) WHERE y.i <= x.i),
cm AS (SELECT r_block, c_block, coalesce(nnz, 0)::BIGINT AS nnz, sum(coalesce(nnz, 0)) OVER (PARTITION BY r_block ORDER BY c_block)::BIGINT AS cum_nnz FROM n LEFT JOIN m USING (r_block, c_block))"""


def _blocked(spark, sf_dir):
    size, blocks = _block(spark, sf_dir)
    return bl.assign_blocks(ed.canonical_edges(fx.copart(spark, sf_dir)), size), size, blocks


@query(f"{BASE}, {_BLOCKED} SELECT * FROM b")
def assign_blocks(spark, sf_dir):
    return _blocked(spark, sf_dir)[0]


@query(f"{BASE}, {_BLOCKED} SELECT w.i::INT AS worker, b.* FROM b JOIN range(4) w(i) ON c_block < CASE w.i WHEN 3 THEN {PARTS} ELSE 2 * w.i + 2 END AND r_block >= 2 * w.i")
def worker_share(spark, sf_dir):
    """What each of four workers needs."""
    blocked = _blocked(spark, sf_dir)[0]
    return reduce(lambda a, b: a.union(b), (bl.worker_share(blocked, w, 4, PARTS).select(F.lit(w).alias("worker"), "*") for w in range(4)))


@query(f"{BASE}, {_BLOCKED}, {_MATRIX} SELECT * FROM m")
def block_edge_matrix(spark, sf_dir):
    return bl.block_edge_matrix(_blocked(spark, sf_dir)[0])


def _cumulative(spark, sf_dir):
    blocked, _, blocks = _blocked(spark, sf_dir)
    return bl.cumulative_block_matrix(bl.block_edge_matrix(blocked), blocks)


@query(f"{BASE}, {_BLOCKED}, {_MATRIX}, {_DENSE} SELECT * FROM cm")
def cumulative_block_matrix(spark, sf_dir):
    return _cumulative(spark, sf_dir)


def _plan_sql(threshold: str) -> str:
    return f"""WITH RECURSIVE {RAW}, {_BLOCKED}, {_MATRIX}, {_DENSE},
x AS (SELECT c_block AS mid, r_block AS high, cum_nnz AS cum FROM cm WHERE r_block > c_block),
g AS (SELECT mid, high, cum AS s, 0 AS grp FROM x WHERE high = mid + 1
  UNION ALL SELECT g.mid, x.high, CASE WHEN g.s + x.cum < {threshold} THEN g.s + x.cum ELSE x.cum END, CASE WHEN g.s + x.cum < {threshold} THEN g.grp ELSE g.grp + 1 END
  FROM g JOIN x ON x.mid = g.mid AND x.high = g.high + 1),
k AS (SELECT 0 AS o, r_block AS mid, 0 AS grp, r_block::VARCHAR AS highs, 'diagonal' AS kind FROM cm WHERE r_block = c_block
  UNION ALL SELECT 1, mid, grp, string_agg(high::VARCHAR, ',' ORDER BY high), 'off_diagonal' FROM g GROUP BY mid, grp),
z AS (SELECT row_number() OVER (ORDER BY o, mid DESC, grp) - 1 AS task_id, mid AS mid_block, highs AS high_blocks, kind FROM k)"""


def _plan(spark, sf_dir, threshold, joined=True):
    plan = bl.plan_tasks(_cumulative(spark, sf_dir), threshold)
    return plan if not joined else plan.withColumn("high_blocks", F.array_join(F.transform("high_blocks", lambda b: b.cast("string")), ","))


@query(_plan_sql("1000000000") + " SELECT * FROM z")
def plan_tasks(spark, sf_dir):
    return _plan(spark, sf_dir, bl.THRESHOLD)


@query(_plan_sql("40000") + " SELECT * FROM z")
def plan_tasks_small(spark, sf_dir):
    return _plan(spark, sf_dir, 40_000)


@query(_plan_sql("40000") + " SELECT row_number() OVER (ORDER BY task_id) - 1 AS task_id, mid_block, high_blocks, kind FROM z WHERE mid_block BETWEEN 2 AND 4")
def plan_tasks_of_worker(spark, sf_dir):
    """The tasks of a worker that owns the middle blocks 2 to 4."""
    return bl.plan_tasks(_cumulative(spark, sf_dir), 40_000, 2, 5).withColumn("high_blocks", F.array_join(F.transform("high_blocks", lambda b: b.cast("string")), ","))


@query(f"{COPART}, {TRIANGLES} SELECT j // ({BLOCK_SQL}) AS mid_block, k // ({BLOCK_SQL}) AS high_block, count(*) AS triangles FROM t GROUP BY ALL")
def partial_triangles(spark, sf_dir):
    return co.partial_triangles(_graph(spark, sf_dir), _block(spark, sf_dir)[0])


@query(f"{COPART}, {TRIANGLES} SELECT j // ({BLOCK_SQL}) AS mid_block, k // ({BLOCK_SQL}) AS high_block, count(*) AS triangles FROM t WHERE k // ({BLOCK_SQL}) > j // ({BLOCK_SQL}) GROUP BY ALL")
def block_pair_join(spark, sf_dir):
    """Every off-diagonal pair of blocks, as one resumable join."""
    size, blocks = _block(spark, sf_dir)
    pairs = spark.range(blocks).select(F.col("id").alias("mid_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("high_block")).where("high_block > mid_block")
    return co.block_pair_join(_graph(spark, sf_dir), size, pairs, new_path(spark, "pairs")).where("triangles > 0")


@query(
    _plan_sql("40000")
    + f""", e AS (SELECT DISTINCT c, r FROM b), {TRIANGLES}, q AS (SELECT j // ({BLOCK_SQL}) AS mid, k // ({BLOCK_SQL}) AS high, count(*) AS n FROM t GROUP BY ALL)
SELECT task_id, kind, coalesce(sum(n), 0)::BIGINT AS triangles FROM z LEFT JOIN q ON q.mid = z.mid_block AND list_contains(string_split(z.high_blocks, ','), q.high::VARCHAR) GROUP BY ALL"""
)
def task_triangles(spark, sf_dir):
    """Triangles of every task of the plan: the plan's block pairs joined to the counts by block pair."""
    pairs = _plan(spark, sf_dir, 40_000, joined=False).select("task_id", "kind", "mid_block", F.explode("high_blocks").alias("high_block"))
    found = co.partial_triangles(_graph(spark, sf_dir), _block(spark, sf_dir)[0])
    return pairs.join(found, ["mid_block", "high_block"], "left").groupBy("task_id", "kind").agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"))


@query(
    f"""{COPART}, low AS (SELECT * FROM e WHERE c // ({BLOCK_SQL}) <= 1),
a AS (SELECT c, count(DISTINCT r // 32) AS tiles FROM low WHERE r // ({BLOCK_SQL}) = 1 GROUP BY c),
h AS (SELECT c, count(*) AS n FROM low WHERE r // ({BLOCK_SQL}) IN (2, 3) GROUP BY c),
w AS (SELECT coalesce(sum(tiles * ((n + 31) // 32)), 0)::BIGINT AS warps FROM a JOIN h USING (c)) SELECT warps, (warps + 3) // 4 AS blocks FROM w"""
)
def block_work_estimate(spark, sf_dir):
    return bl.block_work_estimate(_graph(spark, sf_dir), _block(spark, sf_dir)[0], 1, [2, 3])


# ---- sources

_LINES = """SELECT l_returnflag AS file, l_orderkey * 10 + l_linenumber AS pos, (l_partkey + 1) || ' ' || (l_suppkey + 1) || ' ' || l_quantity AS line FROM lineitem"""


def _mtx_lines(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    n = F.lit(10_000_000).cast("string")
    body = lines.select(F.col("l_returnflag").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat_ws(" ", (F.col("l_partkey") + 1).cast("string"), (F.col("l_suppkey") + 1).cast("string"), F.col("l_quantity").cast("string")).alias("line"))
    files = lines.select(F.col("l_returnflag").alias("file")).distinct()
    head = files.select("file", F.posexplode(F.array(F.lit("%%MatrixMarket matrix coordinate"), F.lit("% comment"), F.lit(" "), F.concat_ws(" ", n, n, F.lit("77")))).alias("p", "line"))
    return body.union(head.select("file", (F.col("p") - 100).cast("long").alias("pos"), "line"))


@query("SELECT l_returnflag AS file, l_partkey AS src, l_suppkey AS dst FROM lineitem")
def read_mtx_files(spark, sf_dir):
    """Files written from the table, a folder each, and read back."""
    path = new_path(spark, "mtx")
    lines = _mtx_lines(spark, sf_dir).withColumn("of", F.concat("file", F.lit(".mtx")))
    lines.repartition("of").sortWithinPartitions("of", "pos").select("of", "line").write.partitionBy("of").text(path)
    raw = mtx.read_mtx(spark, f"{path}/*")
    return raw.select(F.regexp_extract("file", r"of=(\w)", 1).alias("file"), "src", "dst")


@query("SELECT l_returnflag AS file, 10000000::BIGINT AS nrows, 10000000::BIGINT AS ncols FROM lineitem GROUP BY l_returnflag")
def require_square(spark, sf_dir):
    return mtx.require_square(mtx.mtx_catalog(_mtx_lines(spark, sf_dir))).select("file", "nrows", "ncols")


@query("SELECT l_returnflag AS file, l_partkey AS src, l_suppkey AS dst FROM lineitem")
def read_mtx(spark, sf_dir):
    return mtx.parse_mtx_lines(_mtx_lines(spark, sf_dir))


@query(
    """SELECT l_linestatus || l_linenumber AS file, l_linenumber IN (1, 2) AS is_valid, CASE WHEN l_linenumber IN (1, 2, 3) THEN count(*) ELSE -1 END AS nrows,
CASE WHEN l_linenumber IN (1, 2) THEN count(*) WHEN l_linenumber = 3 THEN count(*) + 1 ELSE -1 END AS ncols, CASE WHEN l_linenumber IN (1, 2, 3) THEN 5 ELSE -1 END::BIGINT AS nnz
FROM lineitem GROUP BY l_linestatus, l_linenumber"""
)
def mtx_catalog(spark, sf_dir):
    sizes = fx.table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))
    size = (
        F.when(F.col("l_linenumber") <= 2, F.concat_ws(" ", "n", "n", F.lit("5"))).when(F.col("l_linenumber") == 3, F.concat_ws(" ", F.col("n"), F.col("n") + 1, F.lit("5"))).when(F.col("l_linenumber") == 4, F.concat_ws(" ", "n", "n")).when(F.col("l_linenumber") == 5, F.lit("a b c")).otherwise(F.lit("% none"))
    )
    lines = sizes.select(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("file"), F.posexplode(F.array(F.lit("% c"), F.lit(""), size)).alias("pos", "line"))
    return mtx.mtx_catalog(lines)


@query(f"{BASE} SELECT src, dst FROM raw")
def read_adjacency(spark, sf_dir):
    return ta.read_adjacency(fx.copart(spark, sf_dir).groupBy("src").agg(F.collect_list("dst").alias("successors")))


def _packed(spark, sf_dir) -> str:
    path = new_path(spark, "packed")
    pk.write_packed(fx.copart(spark, sf_dir), path)
    return path


@query(f"WITH {RAW} SELECT src, dst FROM raw")
def read_packed(spark, sf_dir):
    return pk.read_packed(spark, _packed(spark, sf_dir))


@query(f"WITH {RAW}, q AS (SELECT max(l_partkey) // 4 AS low FROM lineitem) SELECT src, dst FROM raw, q WHERE src BETWEEN low AND 2 * low")
def read_packed_range(spark, sf_dir):
    """The second quarter of the sources."""
    low = fx.table(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0] // 4
    return pk.read_packed(spark, _packed(spark, sf_dir), low, 2 * low)


@query(f"WITH {RAW} SELECT count(DISTINCT src) AS nodes, count(*) AS arcs FROM raw")
def packed_size(spark, sf_dir):
    return pk.packed_size(spark, _packed(spark, sf_dir))


def _properties(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part")
    lines = F.array(F.concat(F.lit("nodes="), F.col("p_partkey")), F.concat(F.lit(" nodes = "), F.col("p_size")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("arcs="), F.col("p_partkey") * 3)).otherwise("arcs=none"), F.lit("#comment"), F.lit("a=b=c"))
    return parts.select(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("graph"), F.posexplode(lines).alias("pos", "line"))


_GRAPH = "p_brand || '-' || p_partkey AS graph"


@query(
    f"""SELECT {_GRAPH}, 'nodes' AS key, p_size::VARCHAR AS value FROM part UNION ALL SELECT {_GRAPH}, 'a', 'b=c' FROM part
UNION ALL SELECT {_GRAPH}, 'arcs', CASE WHEN p_size % 2 = 0 THEN (p_partkey * 3)::VARCHAR ELSE 'none' END FROM part"""
)
def read_properties(spark, sf_dir):
    return ta.read_properties(_properties(spark, sf_dir))


@query(f"SELECT {_GRAPH}, p_size::BIGINT AS nodes, CASE WHEN p_size % 2 = 0 THEN p_partkey * 3 ELSE 0 END AS arcs, CASE WHEN p_size % 2 = 0 THEN p_partkey * 3 ELSE 0 END * 8 / 1073741824.0::DOUBLE AS graph_memory_gib FROM part")
def graph_size(spark, sf_dir):
    return ta.graph_size(ta.read_properties(_properties(spark, sf_dir)))


def _single_reports(spark, sf_dir):
    text = F.concat(F.format_string("Graph              : %s\nBlocks of threads  : %d\nPreprocessing (ms) : %.3f\n", F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_totalprice")), F.when(F.col("o_orderkey") % 7 != 0, F.format_string("Kernel (ms)        : %.3f\n", F.col("o_totalprice") * 2)).otherwise(""), F.format_string("Triangles          : %d\n", F.col("o_orderkey") * 5))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), text.alias("text"))


@query("SELECT o_orderkey AS run_id, o_custkey AS n_blocks, round(o_totalprice, 3) AS preprocessing_time, round(o_totalprice * 2, 3) AS kernel_time, o_orderkey * 5 AS triangles FROM orders WHERE o_orderkey % 7 <> 0")
def parse_single_log(spark, sf_dir):
    return ta.parse_single_log(_single_reports(spark, sf_dir))[0]


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 7 = 0")
def rejected_single_log(spark, sf_dir):
    return ta.parse_single_log(_single_reports(spark, sf_dir))[1]


@query(
    """SELECT o_orderkey AS run_id, o_orderstatus || o_custkey AS graph, o_custkey AS nodes, o_custkey * 7 AS arcs, round(o_custkey / 4.0::DOUBLE, 2) AS graph_memory_gib, 1.5::DOUBLE AS load_time, 64::BIGINT AS partition,
o_orderkey % 30 AS tasks_processed, o_orderkey * 3 AS triangles, round(o_totalprice, 2) AS counting_time, 4::BIGINT AS gpus, 2500000.0::DOUBLE AS triangles_per_sec FROM orders WHERE o_orderkey % 11 <> 0"""
)
def parse_multi_log(spark, sf_dir):
    lines = [
        ("Graph               : %s%d", [F.col("o_orderstatus"), F.col("o_custkey")]),
        ("Nodes (declared)    : %d", [F.col("o_custkey")]),
        ("Arcs (declared)     : %d", [F.col("o_custkey") * 7]),
        ("Graph memory (GiB)  : %.2f", [F.col("o_custkey") / F.lit(4.0)]),
        ("Load time (s)       : 1.50\nPartition           : 64", []),
        ("Tasks processed     : %d", [F.col("o_orderkey") % 30]),
        ("Triangles           : %d", [F.col("o_orderkey") * 3]),
        ("Counting time (s)   : %.2f", [F.col("o_totalprice")]),
        ("Triangles/sec       : 2.50e6", []),
    ]
    text = [F.format_string(t, *c) if c else F.lit(t) for t, c in lines]
    text.append(F.when(F.col("o_orderkey") % 11 != 0, "GPUs                : 4"))
    return ta.parse_multi_log(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat_ws("\n", *text).alias("text")))[0]


_WRITTEN = "SELECT 'wedge' AS exe, o_orderstatus AS graph, o_custkey AS nrows, o_custkey AS ncols, o_orderkey AS nnz, 64::BIGINT AS n_blocks, round(o_totalprice, 3) AS preprocessing_time, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 2) END AS kernel_time, o_orderkey * 5 AS triangles, o_custkey * 1024 AS max_memory_consumption FROM orders"


def _written(spark, sf_dir):
    """A result table appended in two steps and read back."""
    path = new_path(spark, "results")
    rows = fx.table(spark, sf_dir, "orders").select(
        F.lit("wedge").alias("exe"), F.col("o_orderstatus").alias("graph"), F.col("o_custkey").alias("nrows"), F.col("o_custkey").alias("ncols"), F.col("o_orderkey").alias("nnz"), F.lit(64).cast("long").alias("n_blocks"), F.round("o_totalprice", 3).alias("preprocessing_time"),
        F.when(F.col("o_orderkey") % 3 == 0, F.round("o_totalprice", 2)).alias("kernel_time"), (F.col("o_orderkey") * 5).alias("triangles"), (F.col("o_custkey") * 1024).alias("max_memory_consumption"),
    )
    for rest in (0, 1):
        ta.append_results(rows.where(F.col("nnz") % 2 == rest), path, "single")
    return ta.read_results(spark, path, "single")


@query(_WRITTEN)
def append_results(spark, sf_dir):
    return _written(spark, sf_dir)


@query(f"SELECT graph, count(*) AS runs, sum(triangles)::BIGINT AS triangles, count(kernel_time) AS with_kernel FROM ({_WRITTEN}) GROUP BY graph")
def read_results(spark, sf_dir):
    return _written(spark, sf_dir).groupBy("graph").agg(F.count("*").alias("runs"), F.sum("triangles").alias("triangles"), F.count("kernel_time").alias("with_kernel"))


@query("SELECT concat_ws(chr(9), p_brand, p_size::VARCHAR, count(*)::VARCHAR) AS value FROM part GROUP BY p_brand, p_size UNION ALL SELECT concat_ws(chr(9), 'p_brand', 'p_size', 'parts')")
def results_report(spark, sf_dir):
    path = new_path(spark, "report")
    ta.results_report(fx.table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("parts")), path, ["p_brand", "p_size"])
    return spark.read.text(path)


@query("SELECT p_partkey || '/' || p_name AS graph, p_size::BIGINT AS n FROM part")
def read_partitions(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select(F.to_json(F.create_map(F.concat_ws("/", F.col("p_partkey").cast("string"), "p_name"), "p_size")).alias("value"))
    return ta.read_partitions(rows)


@query("""SELECT CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS "group", p_name AS name FROM part""")
def read_names(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(".mtx "))).when(F.col("p_partkey") % 3 == 1, F.concat_ws("/", "p_brand", "p_name")).otherwise(F.concat(F.lit(" x/y/"), "p_brand", F.lit("/"), "p_name", F.lit(".mtx")))
    return ta.read_names(part.select(value.alias("value")).union(part.select(F.lit("  ").alias("value"))))


# ---- results


@query("SELECT DISTINCT p_brand || '/' || p_name AS name FROM part WHERE NOT regexp_matches(p_brand || '/' || p_name, 'Brand#1.*|ring$')")
def deny_filter(spark, sf_dir):
    names = fx.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("name")).distinct()
    lines = spark.createDataFrame([("Brand#1.*",), (" ",), ("ring$",)], "value string")
    return re.deny_filter(names, ta.read_denylist(lines))


@query("SELECT DISTINCT p_brand || '/' || p_name AS name FROM part ORDER BY name LIMIT 25")
def limit_graphs(spark, sf_dir):
    return re.limit_graphs(fx.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("name")).distinct(), 25)


@query("SELECT DISTINCT event_type AS graph FROM events")
def distinct_graphs(spark, sf_dir):
    return re.distinct_graphs(fx.results_multi(spark, sf_dir))


@query("SELECT p_brand || '.' || p_partkey AS name, coalesce(s_suppkey, 64)::BIGINT AS n, s_suppkey IS NULL AS is_default FROM part LEFT JOIN supplier ON p_brand = 'Brand#' || s_suppkey")
def partition_lookup(spark, sf_dir):
    graphs = fx.table(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("name"))
    partitions = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey")).alias("graph"), F.col("s_suppkey").alias("n"))
    return re.partition_lookup(graphs, partitions)


_WANTED = """w AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand END AS g, CASE WHEN p_size % 5 = 0 THEN p_name || '?' ELSE p_name END AS name FROM part),
f AS (SELECT w.g, w.name, min(p_partkey) AS id FROM w JOIN part ON p_name = w.name AND (w.g IS NULL OR w.g = p_brand) GROUP BY ALL)"""


def _resolved(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    wanted = part.select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("group"), F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name")).distinct()
    existing = part.where("p_partkey < 3").select(F.col("p_name").alias("name"))
    return re.resolve_catalog(wanted, part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group"), F.col("p_name").alias("name")), existing)


@query(f"""WITH {_WANTED} SELECT id, p_brand AS "group", f.name FROM f JOIN part ON p_partkey = id WHERE f.name NOT IN (SELECT p_name FROM part WHERE p_partkey < 3)""")
def resolve_catalog(spark, sf_dir):
    return _resolved(spark, sf_dir)[0]


@query(f"""WITH {_WANTED} SELECT g AS "group", name FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.name = w.name AND f.g IS NOT DISTINCT FROM w.g)""")
def unresolved_catalog(spark, sf_dir):
    return _resolved(spark, sf_dir)[1]


_SINGLE = """s AS (SELECT o_orderstatus || '-' || o_orderpriority AS graph, o_custkey AS nnz, o_totalprice / 7 AS preprocessing_time, CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice / 3 END AS kernel_time,
CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey * 1024 END AS max_memory_consumption, o_orderkey AS seq FROM orders)"""
_MULTI = "m AS (SELECT event_type AS graph, ([1, 2, 3, 4, 8, 12, 16, 20, 24, 28, 32])[user_id % 11 + 1]::BIGINT AS gpus, value AS counting_time, event_id AS seq FROM events)"
_MERGED = "g AS (SELECT graph, gpus, avg(counting_time) AS counting_time FROM m GROUP BY ALL)"
_SPEED = "v AS (SELECT g.graph, g.gpus, CASE WHEN g.counting_time <> 0 THEN b.counting_time / g.counting_time END AS speedup FROM g JOIN g b ON b.graph = g.graph AND b.gpus = 1)"


@query(
    f"""WITH {_SINGLE}, x AS (SELECT *, preprocessing_time + coalesce(kernel_time, 0) AS t FROM s)
SELECT seq, round(t, 6) AS total_time, round(t - coalesce(kernel_time, 0), 6) AS auxiliary_time, round(t / 1000, 6) AS total_time_s, round((t - coalesce(kernel_time, 0)) / 1000, 6) AS auxiliary_time_s, round(max_memory_consumption / 1073741824.0::DOUBLE, 6) AS memory_gib FROM x"""
)
def derived_times(spark, sf_dir):
    return re.derived_times(fx.results_single(spark, sf_dir)).select("seq", *(F.round(c, 6).alias(c) for c in ("total_time", "auxiliary_time", "total_time_s", "auxiliary_time_s", "memory_gib")))


@query(
    f"""WITH {_SINGLE} SELECT graph, arg_min(nnz, seq) AS nnz, round(avg(preprocessing_time), 4) AS preprocessing_time, round(avg(kernel_time), 4) AS kernel_time,
arg_min(max_memory_consumption, seq) FILTER (WHERE max_memory_consumption IS NOT NULL) AS max_memory_consumption FROM s WHERE graph IS NOT NULL GROUP BY graph"""
)
def merge_runs(spark, sf_dir):
    out = re.merge_runs(fx.results_single(spark, sf_dir), ["graph"])
    return out.withColumn("preprocessing_time", F.round("preprocessing_time", 4)).withColumn("kernel_time", F.round("kernel_time", 4))


def _speedups(spark, sf_dir):
    return re.speedup(re.merge_runs(fx.results_multi(spark, sf_dir), ["graph", "gpus"]))


@query(f"WITH {_MULTI}, {_MERGED}, {_SPEED} SELECT graph, gpus, round(speedup, 6) AS speedup FROM v")
def speedup(spark, sf_dir):
    return _speedups(spark, sf_dir).withColumn("speedup", F.round("speedup", 6))


@query(f"WITH {_MULTI}, {_MERGED}, {_SPEED}, a AS (SELECT unnest([1, 2, 3, 4, 8, 12, 16, 20, 24, 28, 32])::BIGINT AS gpus), h AS (SELECT DISTINCT graph FROM v) SELECT graph, gpus, round(speedup, 6) AS speedup FROM (SELECT * FROM h, a) LEFT JOIN (SELECT * FROM v WHERE gpus <> 3) USING (graph, gpus)")
def axis_reindex(spark, sf_dir):
    return re.axis_reindex(_speedups(spark, sf_dir).where("gpus <> 3")).withColumn("speedup", F.round("speedup", 6))


@query(f"WITH {_MULTI}, {_MERGED}, {_SPEED} SELECT gpus, round(exp(avg(ln(speedup))), 6) AS geomean FROM v GROUP BY gpus")
def geomean_speedup(spark, sf_dir):
    return re.geomean_speedup(re.axis_reindex(_speedups(spark, sf_dir))).withColumn("geomean", F.round("geomean", 6))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {_MULTI}, {_MERGED}, {_SPEED} SELECT gpus, {', '.join(f"round(max(speedup) FILTER (WHERE graph = '{t}'), 6) AS {t}" for t in _TYPES)} FROM v GROUP BY gpus")
def speedup_pivot(spark, sf_dir):
    return re.speedup_pivot(re.axis_reindex(_speedups(spark, sf_dir)), list(_TYPES)).select("gpus", *(F.round(t, 6).alias(t) for t in _TYPES))


@query("SELECT run_id, max(value) AS peak FROM (SELECT user_id AS run_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'error' AND value IS NOT NULL) WHERE k > 2 GROUP BY run_id")
def peak_memory(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return re.peak_memory(events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("value")).alias("value")))


@query(f"WITH {_SINGLE} SELECT min(nnz) AS min_nnz, max(nnz) AS max_nnz, count(DISTINCT graph) AS graphs FROM s")
def axis_range(spark, sf_dir):
    return re.axis_range(fx.results_single(spark, sf_dir))


@query(
    f"""{COPART}, {TRIANGLES}, q AS (SELECT count(*) AS n FROM t), z AS (SELECT count(DISTINCT src) AS nodes, count(*) AS arcs FROM raw)
SELECT 'copart' AS graph, nodes, arcs, round(arcs * 8 / 1073741824.0::DOUBLE, 9) AS graph_memory_gib, (SELECT count(*) FROM (SELECT DISTINCT j // ({BLOCK_SQL}), k // ({BLOCK_SQL}) FROM t)) AS tasks_processed, n AS triangles, 4::BIGINT AS gpus, n / 2.5::DOUBLE AS triangles_per_sec FROM q, z"""
)
def run_summary(spark, sf_dir):
    raw = fx.copart(spark, sf_dir)
    partials = co.partial_triangles(_graph(spark, sf_dir), _block(spark, sf_dir)[0])
    sizes = raw.agg(F.count_distinct("src").alias("nodes"), F.count("*").alias("arcs")).select(F.lit("copart").alias("graph"), "nodes", "arcs", F.round(F.col("arcs") * 8 / F.lit(2.0**30), 9).alias("graph_memory_gib"))
    return bl.run_summary(partials, partials, sizes, 4, 2.5)
