"""MatrixMarket coordinate text as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, line)`` of text files; ``pos`` grows along a file over its splits."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place within the task
    return lines.select(F.col("file_path").alias("file"), F.struct(F.col("file_block_start").alias("block"), inside.alias("at")).alias("pos"), "line")


def _trimmed(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines with single spaces, and whether a line is neither blank nor a comment."""
    return lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))), (F.col("line") != "") & ~F.col("line").startswith("%")


def size_lines(lines: DataFrame) -> DataFrame:
    """``(file, size, first)``: every file's first line of content and its place, null where there is none."""
    trimmed, content = _trimmed(lines)
    at = F.when(content, F.col("pos"))
    return trimmed.groupBy("file").agg(F.min_by("line", at).alias("size"), F.min(at).alias("first"))


def parse_mtx_lines(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``(file, src, dst)``, 0-based, of ``(file, pos, line)``. Comments and blank lines are skipped, the
    first other line of a file is its size, numbers after the first two are ignored.

    Ids of 0 or less, and ids beyond the size, are an error that names the file. ``sizes`` are the files' size lines, if
    known; else the lines are gone through once more for them.
    """
    trimmed, is_content = _trimmed(lines)
    sizes = size_lines(lines) if sizes is None else sizes
    pairs = trimmed.where(is_content).join(sizes, "file").where("pos <> first").select("file", "size", F.expr("try_cast(split(line, ' ')[0] as bigint)").alias("row"), F.expr("try_cast(split(line, ' ')[1] as bigint)").alias("col"))
    most = F.greatest(*(F.expr(f"try_cast(split(size, ' ')[{i}] as bigint)") for i in (0, 1)))
    fine = F.col("row").isNotNull() & F.col("col").isNotNull() & (F.least("row", "col") > 0) & (F.greatest("row", "col") <= most)
    bad = F.raise_error(F.concat(F.lit("vertex id outside the matrix in "), F.col("file"))).cast("long")
    return pairs.select("file", F.when(fine, F.col("row") - 1).otherwise(bad).alias("src"), F.when(fine, F.col("col") - 1).otherwise(bad).alias("dst"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """Raw edges of MatrixMarket files, which must be square. The text is read twice, for sizes and for pairs."""
    lines = read_lines(spark, path)
    sizes = stored(size_lines(lines), "mtx-sizes")
    require_square(mtx_catalog(lines, sizes))
    return parse_mtx_lines(lines, sizes)


def mtx_catalog(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``(file, is_valid, nrows, ncols, nnz)`` by the first line that is no comment and not blank: three
    integers, and square to be valid. No such line or another count of words gives -1 for all sizes."""
    numbers = F.transform(F.split("size", " "), lambda x: x.try_cast("long"))
    read = (size_lines(lines) if sizes is None else sizes).withColumn("n", numbers)
    right = F.coalesce((F.size("n") == 3) & ~F.exists("n", lambda x: x.isNull()), F.lit(False))
    at = [F.when(right, F.get("n", F.lit(i))).otherwise(F.lit(-1)).cast("long") for i in range(3)]
    return read.select("file", (right & F.coalesce(at[0] == at[1], F.lit(False))).alias("is_valid"), *(c.alias(k) for c, k in zip(at, ("nrows", "ncols", "nnz"), strict=True)))


def require_square(catalog: DataFrame) -> DataFrame:
    """The catalogue, if no file is rectangular; else an error that names the sizes (up to ten files)."""
    bad = catalog.where("nrows <> ncols").select("file", "nrows", "ncols").limit(10).collect()
    if bad:
        raise ValueError("not square: " + ", ".join(f"{r['file']} is {r['nrows']} x {r['ncols']}" for r in bad))
    return catalog
