"""Reductions by key with an operation that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Merges two Arrow arrays of one length, row by row; associative and commutative, and never given a null.
Merge = Callable[[pa.Array, pa.Array], pa.Array]

#: Rows a task holds before it reduces them; what it then still holds beyond half of them goes on to the next phase.
HELD = 1 << 17
#: Rows of one key that one task merges; a key with more is merged in a tree.
FAN = 64


def _breaks(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; nulls are equal, and so are NaNs."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        one, two = column[:-1], column[1:]
        differ = pc.or_kleene(pc.fill_null(pc.not_equal(one, two), False), pc.xor(pc.is_null(one), pc.is_null(two)))
        if pa.types.is_floating(column.type):
            differ = pc.and_(differ, pc.invert(pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def merged(table: pa.Table, keys: list[str], value: str, merge: Merge) -> pa.Table:
    """A row for each run of equal keys of a table in order of them: neighbours are merged two by two, all keys at once,
    so that a run of n rows takes log n calls. Null values give way to others."""
    group = np.cumsum(_breaks(table, keys)) - 1
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    values = table.column(value).combine_chunks()
    some = values.is_valid().to_numpy(zero_copy_only=False)
    values, own = values.filter(pa.array(some)), group[some]
    while np.any(own[1:] == own[:-1]):
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        left = np.flatnonzero(place % 2 == 0)
        pair = np.append(own, -1)[left + 1] == own[left]
        both = merge(values.take(pa.array(left[pair])), values.take(pa.array(left[pair] + 1))).cast(values.type)
        at = np.where(pair, len(own) + np.cumsum(pair) - 1, left)
        values, own = pa.concat_arrays([values, both]).take(pa.array(at)), own[left]
    place = np.full(len(firsts), -1)
    place[own] = np.arange(len(own))
    column = values.take(pa.array(place, mask=place < 0))
    return table.select(keys).take(pa.array(firsts)).append_column(value, column)


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without marks of columns that hold no null, which merged ones lack."""
    return pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)


def _in_task(keys: list[str], value: str, merge: Merge, most: int = HELD) -> Callable:
    """Rows in any order to partial results. What a task holds is bounded, so a key may leave it more than once."""

    def reduced(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held)
        return merged(table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys])), keys, value, merge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_plain(batch))
            n += batch.num_rows
            if n >= most:
                table = reduced(held)
                if table.num_rows > most // 2:
                    yield from table.to_batches()
                    held, n = [], 0
                else:
                    held, n = table.combine_chunks().to_batches(), table.num_rows
        if n:
            yield from reduced(held).to_batches()

    return run


def _in_order(keys: list[str], value: str, merge: Merge) -> Callable:
    """Rows in order of the keys to one row for each of them: the last key of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([_plain(batch)])
                table = merged(pa.concat_tables([last, table]) if last else table, keys, value, merge)
                last = table.slice(table.num_rows - 1)
                yield from table.slice(0, table.num_rows - 1).to_batches()
        if last:
            yield from last.to_batches()

    return run


def _met(rows: DataFrame, by: list[str], value: str, merge: Merge) -> DataFrame:
    """``rows`` brought together by ``by`` and merged."""
    schema = rows.select(*by, value).schema
    return rows.select(*by, value).repartition(*by).sortWithinPartitions(*by).mapInArrow(_in_order(by, value, merge), schema)


def merge_by_key(df: DataFrame, keys: list[str], value: str, merge: Merge, held: int = HELD, fan: int = FAN) -> DataFrame:
    """``value`` merged over the rows of each key: first within each task, then by key.

    Only a task's partial results are shuffled. A key that occurs in more than ``fan`` of them, as a hot one does, is
    merged in a tree: by key and group of ``fan`` tasks first, in rounds, until it has ``fan`` rows or fewer. Keys are of atomic
    types; null is a key like others; a task holds some ``held`` rows; a null value gives way, and is the result only where a key has no other.
    """
    kinds = dict(df.dtypes)
    whole = [F.when(F.col(k) == 0, F.lit(0).cast(kinds[k])).otherwise(F.col(k)).alias(k) if kinds[k] in ("float", "double") else F.col(k) for k in keys]
    rows = df.select(*whole, value)
    parts = rows.mapInArrow(_in_task(keys, value, merge, held), rows.schema).withColumn("_task", F.spark_partition_id())
    parts = stored(parts, "partial")
    done = []
    while True:
        many = parts.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > fan)
        many = stored(many.select(*[F.col(k).alias(f"_{k}") for k in keys]), "hot-keys")
        if many.isEmpty():
            break
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        hot = parts.join(many, same, "left_semi")
        done.append(parts.join(many, same, "left_anti"))
        slot = F.expr(f"_task div {fan}").alias("_task")
        parts = stored(_met(hot.select(*keys, value, slot), [*keys, "_task"], value, merge), "partial")
    for other in done:
        parts = parts.unionByName(other)
    return _met(parts, keys, value, merge)
