"""Tables kept for the length of a job in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files are deleted at its end.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without it gets a folder of its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: they go as soon as its result is written."""
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, so that lost executors cost a re-read and nothing is computed twice. Its shuffle files
    go at once. ``clear`` deletes what was written, once results that read it are safe, ``discard`` one table."""
    path = new_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        for known in [w for w in _written if path.endswith(w.rsplit("/", 1)[1])]:
            _written.remove(known)
            delete(df.sparkSession, known)


def _at(spark: SparkSession, path: str) -> tuple:
    """A path of any file system, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists."""
    at, files = _at(spark, path)
    return files.exists(at)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small text file appear whole, by one rename, unless it is there already; whether it was made."""
    at, files = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at) or not files.rename(aside, at):
        files.delete(aside, False)
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system."""
    at, files = _at(spark, path)
    files.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``stored`` has written; what reads them must have been written out before."""
    while _written:
        delete(spark, _written.pop())


def in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ranges of ``keys`` and stored, with ``part``, a range's number in order, and ``at``, a row's
    0-based place in its range. Ranges hold about as many rows each, however the keys are spread."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return stored(ranged.select(*df.columns, F.spark_partition_id().alias("part"), inside.alias("at")), "in-order")


def scanned(df: DataFrame, keys: list[str], task: Callable, schema: str) -> DataFrame:
    """``df`` dealt by ranges of ``keys``, and each range, in order and with its number as the last column ``part``, gone
    through by ``task`` on Arrow batches once, before the result (columns of ``schema``) is stored: no second exchange."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*df.columns, F.spark_partition_id().alias("part"))
    return stored(ranged.mapInArrow(task, schema), "scanned")
