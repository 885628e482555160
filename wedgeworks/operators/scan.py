"""Scans, histograms, keyed reductions and lookups over tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import in_order, scanned, stored
from .reduce import Merge, merge_by_key

REDUCTIONS = {"sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or, "bit_and": F.bit_and, "bit_xor": F.bit_xor}


def reduce_by_key(df: DataFrame, keys: list[str], value: str, op: str | Merge) -> DataFrame:
    """``value`` reduced for each key by an associative ``op``: one of REDUCTIONS by name, or the caller's own, which
    merges two Arrow arrays row by row (see ``merge_by_key``)."""
    if callable(op):
        return merge_by_key(df, keys, value, op)
    if op not in REDUCTIONS:
        raise ValueError(f"no such reduction: {op}; there are {sorted(REDUCTIONS)}, or a function of two Arrow arrays")
    return df.groupBy(*keys).agg(REDUCTIONS[op](value).alias(value))


def histogram(df: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """``(key, n)``; with ``size`` also the keys below it that do not occur."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    if size is None:
        return counts
    return df.sparkSession.range(size).withColumnRenamed("id", "key").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def run_lengths(df: DataFrame, key: str) -> DataFrame:
    """``(key, length)``: run lengths of the key column once sorted."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("length"))


def segmented_sum(df: DataFrame, segments: DataFrame, segment: str, value: str) -> DataFrame:
    """Sum of each segment in ``segments``, 0 where it has no row."""
    return segments.join(df.groupBy(segment).agg(F.sum(value).alias("total")), segment, "left").select(segment, F.coalesce("total", F.lit(0)).alias("total"))


def total_sum(df: DataFrame, value: str) -> DataFrame:
    """Sum of a column, 0 without rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def _before(sums: DataFrame) -> DataFrame:
    """``(part, before)``: what the ranges before each one hold; a row a range, which is what is broadcast."""
    return F.broadcast(sums.select("part", (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("before")))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, value, x, part) of one range to the same with the running sum of x."""
    before = 0
    for batch in batches:
        if batch.num_rows:
            kind = batch.schema.field(2).type
            if pa.types.is_decimal(kind):
                sums = list(accumulate(batch.column(2).to_pylist(), initial=before))[1:]
            else:
                sums = np.cumsum(batch.column(2).to_numpy()) + before
            before = sums[-1]
            yield batch.set_column(2, "within", pa.array(sums, kind))


def prefix_sum(df: DataFrame, order: str, value: str, kind: str = "exclusive") -> DataFrame:
    """``(order, value, prefix)`` over the whole table in order of a unique column.

    Rows are dealt by ranges of the order column, whatever its values are; each range is summed up in one pass as it is stored,
    and only the ranges' sums run through a window. A null value counts as 0. ``kind``: exclusive, inclusive, or
    complete (exclusive and a last row, with null order, that holds the total).
    """
    if kind not in ("exclusive", "inclusive", "complete"):
        raise ValueError(f"no such prefix sum: {kind}")
    rows = df.select(F.col(order).alias("pos"), F.col(value).alias("value"))
    total = rows.agg(F.sum("value")).schema[0].dataType.simpleString()
    summed = F.coalesce(F.col("value").cast(total), F.lit(0).cast(total)).alias("within")
    pos, kept = (rows.schema[c].dataType.simpleString() for c in ("pos", "value"))
    rows = scanned(rows.select("pos", "value", summed), ["pos"], _running, f"pos {pos}, value {kept}, within {total}, part int")
    sums = rows.groupBy("part").agg(F.sum(F.coalesce("value", F.lit(0))).alias("held"))
    upto = rows.join(_before(sums), "part").select("pos", "value", (F.col("before") + F.col("within")).alias("upto"))
    if kind == "inclusive":
        return upto.select("pos", "value", F.col("upto").alias("prefix"))
    out = upto.select("pos", "value", (F.col("upto") - F.coalesce("value", F.lit(0))).alias("prefix"))
    if kind == "exclusive":
        return out
    end = rows.agg(F.lit(None).cast("long").alias("pos"), F.lit(0).cast("long").alias("value"), F.coalesce(F.sum("value"), F.lit(0)).alias("prefix"))
    return out.union(end)


def offsets(df: DataFrame, key: str) -> DataFrame:
    """``(key, start, stop)`` of each key's rows in key order."""
    return prefix_sum(histogram(df, key), "key", "n").select(F.col("pos").alias("key"), F.col("prefix").alias("start"), (F.col("prefix") + F.col("value")).alias("stop"))


def _last_started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, kind, segment, part) of one range in order to (pos, segment, part): each position with the segment that
    started last, null before any, and a row without a position for the segment that the range ends in."""
    last, part = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, kind, segment, parts = batch.columns
        kind, part = kind.to_numpy(), parts[0].as_py()
        known = pa.concat_arrays([pa.array([last], segment.type), segment])  # place 0 is what came before the batch
        place = np.maximum.accumulate(np.where(kind == 0, np.arange(1, len(kind) + 1), 0))
        last = known[int(place[-1])].as_py()
        points = np.flatnonzero(kind == 1)
        yield pa.RecordBatch.from_arrays([at.take(pa.array(points)), known.take(pa.array(place[points])), parts.take(pa.array(points))], ["pos", "segment", "part"])
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([None], at.type), pa.array([last], segment.type), pa.array([part], parts.type)], ["pos", "segment", "part"])


def segment_lookup(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """``(pos, key)``: the segment ``start <= pos < stop`` of each position; no row where there is none.

    A merge: starts and positions are put in one order, dealt by ranges, and the last start is carried forward within a range and, a row
    a range, from range to range. A segment is one row however long it is, and positions that repeat are spread over ranges. Segments
    do not overlap; empty ones own nothing.
    """
    key = segments.schema["key"].dataType.simpleString()
    kind = f"struct<key:{key},stop:bigint>"
    starts = segments.where("start < stop").select(F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("spread"), F.struct("key", F.col("stop").cast("long").alias("stop")).cast(kind).alias("segment"))
    points = positions.where("pos is not null").select(F.col("pos").cast("long").alias("at"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("spread"), F.lit(None).cast(kind).alias("segment"))
    both = starts.union(points).repartitionByRange("at", "kind", "spread").sortWithinPartitions("at", "kind", "spread")
    found = stored(both.select("at", "kind", "segment", F.spark_partition_id().alias("part")).mapInArrow(_last_started, f"pos long, segment {kind}, part int"), "segments")
    ends = found.where("pos is null").select("part", F.last("segment", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    own = found.where("pos is not null").join(F.broadcast(ends), "part").select("pos", F.coalesce("segment", "before").alias("s"))  # a row a range
    return own.where("pos < s.stop").select("pos", F.col("s.key").alias("key"))


def positions_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(pos, *keys)``: 0-based place in order of ``keys``: rows of the ranges before, and the place in the range."""
    rows = in_order(df.select(*keys), keys)
    before = _before(rows.groupBy("part").agg(F.count("*").alias("held")))
    return rows.join(before, "part").select((F.col("before") + F.col("at")).alias("pos"), *keys)


def gather(values: DataFrame, idxs: DataFrame) -> DataFrame:
    """``(pos, value)`` with the value found at ``idx``; null where there is none."""
    return idxs.join(values.select(F.col("pos").alias("idx"), "value"), "idx", "left").select("pos", "value")


def point_lookup(keys: DataFrame, table: DataFrame, on: list[str], value: str, missing: Column) -> DataFrame:
    """Exact-match lookup, ``missing`` where there is no match."""
    return keys.join(table.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), missing))


def monotone_check(pointers: DataFrame) -> DataFrame:
    """``(key, start)`` of pointers below their predecessor's; none if all is well.

    The predecessor is the row before in the same range of keys or, for a range's first row, the last one of the
    range before.
    """
    rows = in_order(pointers.select("key", "start"), ["key"])
    last = rows.groupBy("part").agg(F.max_by("start", "at").alias("end"))
    last = F.broadcast(last.select("part", F.lag("end").over(W.orderBy("part")).alias("end")))  # a row a range
    inside = rows.withColumn("lag", F.lag("start").over(W.partitionBy("part").orderBy("at")))
    return inside.join(last, "part").where(F.col("start") < F.coalesce("lag", "end")).select("key", "start")
