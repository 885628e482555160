"""Graphs as compressed successor lists.

Edges in order of (src, dst) are cut into blocks of some 65,000, a hub's over several. A block is a row: the first and last source
in it, its counts, and its lists as variable-length integers (seven bits a byte): gaps between sources, numbers of successors, the first
successor as a signed distance from its source, gaps between successors. The blocks' ranges of sources are the index: a range of
sources is a pushed-down filter on two columns, and sizes need no list at all. Reading is one task for each split of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 16  #: edges
SCHEMA = "first long, last long, sources long, arcs long, lists binary"
_U = np.uint64


def varints(values: np.ndarray) -> bytes:
    """Unsigned numbers, low seven bits first; the last byte of each has its high bit clear."""
    values = values.astype(_U)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> _U(7 * k) > 0
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        more = np.where(size[own] > k + 1, 128, 0)
        out[start[own] + k] = ((values[own] >> _U(7 * k)) & _U(127)).astype(np.int64) | more
    return out.tobytes()


def numbers(data: bytes) -> np.ndarray:
    """The numbers that ``varints`` has written."""
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate(([0], end[:-1] + 1))
    size = end - start + 1
    out = np.zeros(len(end), _U)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[own] |= (b[start[own] + k].astype(_U) & _U(127)) << _U(7 * k)
    return out


def packed_lists(src: np.ndarray, dst: np.ndarray) -> tuple:
    """A row of SCHEMA of edges in order."""
    at = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
    own = src[at]
    away = dst[at] - own
    gaps = np.delete(np.diff(dst, prepend=dst[0]), at)
    parts = ([len(at)], np.diff(own, prepend=own[0]), np.diff(np.append(at, len(src))), (away << 1) ^ (away >> 63), gaps)
    return int(src[0]), int(src[-1]), len(at), len(src), varints(np.concatenate(parts))


def unpacked(first: int, lists: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of a block."""
    x = numbers(lists)
    k, x = int(x[0]), x[1:]
    own, size, away = first + np.cumsum(x[:k].astype(np.int64)), x[k : 2 * k].astype(np.int64), x[2 * k : 3 * k]
    begin = own + ((away >> _U(1)).astype(np.int64) ^ -(away & _U(1)).astype(np.int64))
    at = np.cumsum(size) - size
    step = np.zeros(int(size.sum()), np.int64)
    rest = np.ones(len(step), bool)
    rest[at] = False
    step[rest] = x[3 * k :].astype(np.int64)
    run = np.cumsum(step)
    return np.repeat(own, size), run + np.repeat(begin - run[at], size)


def _writer(block: int) -> Callable:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = pa.schema([*((c, pa.int64()) for c in names[:-1]), (names[-1], pa.binary())])

    def rows(held: list, last: bool) -> Iterator[pa.RecordBatch]:
        src, dst = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        whole = len(src) if last else len(src) // block * block
        for at in range(0, whole, block):
            row = packed_lists(src[at : min(at + block, whole)], dst[at : min(at + block, whole)])
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)
        held[:] = [(src[whole:], dst[whole:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n >= block:
                yield from rows(held, False)
                n = len(held[0][0])
        if n:
            yield from rows(held, True)

    return run


def write_packed(edges: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write ``edges(src, dst)``, ``block`` of them a block; repeated edges stay, rows with a null go."""
    plain = edges.where("src is not null and dst is not null").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    spread = plain.withColumn("place", F.monotonically_increasing_id())  # an edge that repeats very often lies in several ranges
    spread.repartitionByRange("src", "dst", "place").sortWithinPartitions("src", "dst").select("src", "dst").mapInArrow(_writer(block), SCHEMA).write.parquet(path)


def packed_blocks(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The blocks that hold sources from ``low`` to ``high``."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    blocks = blocks if low is None else blocks.where(F.col("last") >= low)
    return blocks if high is None else blocks.where(F.col("first") <= high)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, lists in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, unpacked(first.as_py(), lists.as_py()))), ["src", "dst"])


def read_packed(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``(src, dst)`` of the sources from ``low`` to ``high``, both included; only their blocks are unpacked."""
    edges = packed_blocks(spark, path, low, high).select("first", "lists").mapInArrow(_read, "src long, dst long")
    edges = edges if low is None else edges.where(F.col("src") >= low)
    return edges if high is None else edges.where(F.col("src") <= high)


def packed_size(spark: SparkSession, path: str) -> DataFrame:
    """``(nodes, arcs)``: sources and edges, off the index; a source that lies in several blocks counts once."""
    blocks = packed_blocks(spark, path)
    ends = blocks.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("v")).groupBy("v").agg((F.count("*") - 1).alias("again"))
    again = ends.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("again"))
    total = blocks.agg(F.coalesce(F.sum("sources"), F.lit(0)).alias("sources"), F.coalesce(F.sum("arcs"), F.lit(0)).alias("arcs"))
    return total.crossJoin(again).select((F.col("sources") - F.col("again")).alias("nodes"), "arcs")  # a row each
