"""Helpers shared by the training-data operators: tables, shared folders, joins by checked sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a key and a few numbers a row) is broadcast.
BROADCAST_ROWS = 400_000
#: Rows of one key from which a key counts as hot: a join then broadcasts its partner, of which a table of n rows
#: has n / HOT_ROWS at most.
HOT_ROWS = 1_000_000

#: Bytes of an Arrow batch: with rows of any length, a Python worker then holds a few megabytes at a time.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
_written: list[DataFrame] = []


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session within BATCH_BYTES; a smaller bound of the user's stays.

    The setting outlives the call, as the tables returned here run later, in the caller's hands.
    """
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(_BATCH).strip().lower()).groups()
    if not 0 < int(number) << _UNITS[unit] <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where it is unset, a local master gets a folder of its own; a cluster gets an error, as no local folder
    is seen by all executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _written.append(out)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system exists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            _written[:] = [other for other in _written if other is not df]


def clear() -> None:
    """Delete all stored tables that are left, once the results that read them have been written."""
    forget(*list(_written))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows at most ``limit`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def join_keyed(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", broadcast: bool = True) -> DataFrame:
    """Join a stored ``right`` of one row a key, ``weight`` being a key's rows in ``left`` (or more).

    A right side of few rows is broadcast, if ``broadcast``. Otherwise both are shuffled, but for keys of more than HOT_ROWS rows:
    their partners, of which there are few, are broadcast, so that no task gathers a hot key. ``how`` is inner or left.
    """
    plain = right.drop(weight)
    if broadcast and right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(plain), on, how)
    hot = right.where(F.col(weight) > HOT_ROWS).drop(weight)
    if hot.isEmpty():
        return left.join(plain, on, how)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(F.col(weight) <= HOT_ROWS).drop(weight), on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def utf8(text: Column) -> Column:
    """Text as UTF-8 bytes, null as none."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus == remainder
