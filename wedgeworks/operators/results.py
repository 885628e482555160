"""Benchmark results: filters on inputs, merged repeats, speedups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored

# Device counts of the scaling table.
AXIS = (1, 2, 3, 4, 8, 12, 16, 20, 24, 28, 32)
MOST_PATTERNS = 10_000
DEFAULT_PARTITIONS = 64
WARM_UP_SAMPLES = 2


def required_literal(pattern: str) -> str:
    """The longest text that every match of a regular expression contains; empty where none is certain.

    Only plain sequences are read: an alternative, a flag, a quoted stretch or a character by number leaves nothing certain, groups and classes are passed
    over, and what a quantifier follows ends a text, without its last character if it may be absent.
    """
    if "|" in pattern or "(?" in pattern or "\\Q" in pattern:
        return ""
    texts, now, i, depth = [], "", 0, 0
    while i < len(pattern):
        c, step = pattern[i], 1
        if c == "\\":
            step = 2
            c = pattern[i + 1 : i + 2]
            plain = bool(c) and not c.isalnum()
            if c.isalnum() and c not in "dDwWsSbBAzZGhHvVRtnrfae":
                return ""
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0 or "[" in pattern[i + 1 : end] or "\\" in pattern[i:end]:
                return ""
            step, plain = end + 1 - i, False
        elif c == "{":
            step, plain = pattern.find("}", i) + 1 - i, False
            if step <= 0:
                return ""
        else:
            plain = c not in ".^$*+?}()"
        after = pattern[i + step : i + step + 1]
        depth += (c == "(" and step == 1) - (c == ")" and step == 1)
        if plain and not depth and after not in ("*", "?", "{"):
            now += c
            if after == "+":
                texts, now = [*texts, now], ""
        else:
            texts, now = [*texts, now], ""
        i += step
    return max([*texts, now], key=len)


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(required_literal, batch.column(0).to_pylist()), pa.string())], ["pattern", "literal"])


def trigrams(text: str) -> Column:
    """The distinct stretches of three characters of a column."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda k: F.substring(text, k, F.lit(3))))


def deny_filter(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names in which no pattern is found; rows with a null name stay.

    Names and patterns meet by an equal stretch of three characters that a pattern requires, of several the one that fewest names
    have; only names that have it are matched. Patterns that require no such stretch are held against every name: they are broadcast, and
    more than MOST_PATTERNS of them are an error.
    """
    known = patterns.where("pattern is not null").select("pattern").distinct().mapInArrow(_literals, "pattern string, literal string")
    known = stored(known, "patterns")
    loose = known.where("length(literal) < 3").select("pattern")
    if loose.count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns without three characters that they require")
    each = names.where("name is not null").select("name").distinct()
    of_names = stored(each.where("length(name) > 2").select("name", F.explode(trigrams("name")).alias("gram")), "trigrams")
    often = of_names.groupBy("gram").agg(F.count("*").alias("n"))
    of_patterns = known.where("length(literal) > 2").select("pattern", F.explode(trigrams("literal")).alias("gram"))
    # A stretch that no name has makes its pattern match none.
    rarest = of_patterns.join(often, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    found = of_names.join(rarest, "gram").where("name rlike pattern").select("name")
    if not loose.isEmpty():
        found = found.union(each.join(F.broadcast(loose), F.expr("name rlike pattern"), "left_semi"))
    return names.join(found.distinct(), "name", "left_anti").select(names.columns)


def limit_graphs(names: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by name; 0 is no limit."""
    return names.orderBy("name").limit(n) if n else names


def distinct_graphs(results: DataFrame) -> DataFrame:
    """Each graph once."""
    return results.select("graph").distinct()


def partition_lookup(graphs: DataFrame, partitions: DataFrame) -> DataFrame:
    """``(name, n, is_default)``: partitions of the graph that a name is up to its first dot."""
    keyed = graphs.withColumn("graph", F.substring_index("name", ".", 1))
    return keyed.join(partitions, "graph", "left").select("name", F.coalesce("n", F.lit(DEFAULT_PARTITIONS)).cast("long").alias("n"), F.col("n").isNull().alias("is_default"))


def resolve_catalog(names: DataFrame, catalog: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted ``(group, name)`` against ``(id, group, name)``: the first match by id (a null group matches
    any) that is not present yet, and what was not found."""
    right = catalog.select("id", F.col("group").alias("found_group"), F.col("name").alias("found"))
    hit = names.join(right, (F.col("name") == F.col("found")) & (F.col("group").isNull() | (F.col("group") == F.col("found_group"))))
    first = hit.groupBy("name", "group").agg(F.min(F.struct("id", "found_group")).alias("m")).select("name", "group", "m.id", "m.found_group")
    new = first.join(existing.select("name"), "name", "left_anti").select("id", F.col("found_group").alias("group"), "name")
    same = (names["name"] == first["name"]) & names["group"].eqNullSafe(first["group"])
    return new, names.join(first, same, "left_anti").select("group", "name").distinct()


def time_columns(results: DataFrame) -> list[str]:
    """Columns whose name holds "time"."""
    return [c for c in results.columns if "time" in c and c != "gpu_total_s_time"]


def derived_times(results: DataFrame) -> DataFrame:
    """Add ``total_time`` (all times, nulls as 0), ``auxiliary_time`` (without the kernel's), both also in
    seconds, and memory in GiB."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in time_columns(results)))
    out = results.withColumn("total_time", total).withColumn("auxiliary_time", F.col("total_time") - F.coalesce("kernel_time", F.lit(0.0)))
    return out.withColumn("total_time_s", F.col("total_time") / 1000).withColumn("auxiliary_time_s", F.col("auxiliary_time") / 1000).withColumn("memory_gib", F.col("max_memory_consumption") / F.lit(2.0**30))


def merge_runs(results: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a key: the mean of times, of the rest the first that is not null by ``seq``. Null keys go."""
    times = set(time_columns(results))
    rest = [c for c in results.columns if c not in {*keys, seq}]
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return results.where(known).groupBy(*keys).agg(*(F.avg(c).alias(c) if c in times else F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest))


def speedup(results: DataFrame) -> DataFrame:
    """``(graph, gpus, speedup)``: time on one device over the time on each count."""
    base = results.where("gpus = 1").select("graph", F.col("counting_time").alias("base"))
    return results.join(base, "graph").select("graph", "gpus", F.try_divide("base", "counting_time").alias("speedup"))


def axis_reindex(speedups: DataFrame, axis: tuple[int, ...] = AXIS) -> DataFrame:
    """Every graph at every count of the axis, null where it has no run; other counts are dropped."""
    every = distinct_graphs(speedups).withColumn("gpus", F.explode(F.array(*(F.lit(a).cast("long") for a in axis))))
    return every.join(speedups, ["graph", "gpus"], "left").select("graph", "gpus", "speedup")


def geomean_speedup(aligned: DataFrame) -> DataFrame:
    """``(gpus, geomean)`` over graphs, nulls ignored."""
    return aligned.groupBy("gpus").agg(F.exp(F.avg(F.ln("speedup"))).alias("geomean"))


def speedup_pivot(aligned: DataFrame, graphs: list[str]) -> DataFrame:
    """Device counts as rows, graphs as columns."""
    return aligned.groupBy("gpus").pivot("graph", graphs).agg(F.max("speedup"))


def peak_memory(samples: DataFrame, value: str = "value") -> DataFrame:
    """``(run_id, peak)`` of samples that are not null, but for the first two of a run."""
    order = W.partitionBy("run_id").orderBy("seq")
    return samples.where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(order)).where(F.col("k") > WARM_UP_SAMPLES).groupBy("run_id").agg(F.max(value).alias("peak"))


def axis_range(results: DataFrame) -> DataFrame:
    """Smallest and largest nnz, and the number of graphs."""
    return results.agg(F.min("nnz").alias("min_nnz"), F.max("nnz").alias("max_nnz"), F.count_distinct("graph").alias("graphs"))
