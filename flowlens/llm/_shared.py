"""Helpers that every corpus operator shares: shared storage, bounded Arrow batches, sized broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker; long texts must not meet by the thousand.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set, a local master gets a folder of this machine; on a cluster that is an error, since
    executors elsewhere wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowlens-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A fresh path in the shared folder; it goes with the innermost `scratch` (outlive: the one around that), else when the driver ends."""
    path = f"{shared_dir(spark)}/flowlens-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    around = _scopes[:-1] if outlive else _scopes
    if around:
        around[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that are written within, all but those that outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        forget(spark, _scopes.pop())


def written(df: DataFrame, name: str, drop_after: list[str] | None = None, outlive: bool = False, **options) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation. options: the writer's."""
    path = new_path(df.sparkSession, name, outlive)
    df.write.options(**options).parquet(path)
    if drop_after is not None:
        drop_after.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the texts' lengths. These are settings of the session, read
    when a plan runs, so there is no narrower place for them; a session's own smaller bounds are left as they are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def sized(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if it holds at most `limit` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
