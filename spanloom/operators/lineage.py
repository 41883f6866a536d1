"""Cutting lineage by tables in the folder that driver and executors share.

A long plan is written as a table and read again: a lost executor then costs one stage, not the whole lineage.  The
folder is the session's ``spark.checkpoint.dir``.  On a cluster it must be set; only a local session, as in tests, makes
a temporary folder of its own where it is not.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Tables that were written and not deleted yet, with their sessions.
_left: dict[str, SparkSession] = {}
#: A broadcast hint is given to frames with at most so many rows and bytes.
SMALL_ROWS, SMALL_BYTES = 100_000, 8 << 20
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Whole URI of the shared folder, for Spark's file systems and others."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + own)
        path = spark.sparkContext.getCheckpointDir()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted with the tables left there."""
    path = fresh_path(spark, name)
    _left[path] = spark
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame, written to the shared folder and read again."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def counted(df: DataFrame, name: str = "step", what: Column | None = None) -> tuple[DataFrame, int]:
    """The frame, written and read again, and its number of rows (or another count), observed while writing: no second job."""
    seen = Observation()
    out = written(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), name)
    return out, seen.get["n"]


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of each table as soon as it is written, not when the driver happens to
    collect its garbage: a loop then takes the disk of one round, not of all."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _left.pop(path, None)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written`; frames that still read them must not be used afterwards."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            _delete(df.sparkSession, path)


def release() -> None:
    """Delete every table still left: those that returned frames read.  For drivers that have used their results."""
    for path, spark in list(_left.items()):
        _delete(spark, path)


@atexit.register
def _sweep() -> None:
    try:
        release()
    except (Py4JError, Py4JNetworkError, OSError, AttributeError):  # the session's JVM has gone before
        _left.clear()


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint if a first count, up to the bound, finds few rows; else the frame is shuffled.

    Strings are counted in bytes: the hint needs all columns together to be within SMALL_BYTES.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    fixed = sum(t not in ("string", "binary") for _, t in df.dtypes) * 8
    if any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        return df
    size = F.lit(fixed) + sum(wide, F.lit(0))
    told = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if told.n <= rows and told.b <= SMALL_BYTES else df


def running(df: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """With the sum of `value` over all rows up to each, in a total order, as column `name`.

    The rows are written in key ranges; each needs a window of its own and the totals of those before it, so no task
    holds more than a range.
    """
    dealt = written(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_total"))  # as many rows as ranges
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.sum("_value").over(inside)).drop("_range", "_value", "_before")
