"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "millrace", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where nothing is set.

    Raises on a cluster without that setting, because a machine-local folder would not survive a lost executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder (reliable checkpoint, cleaned with its last reference)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Rows of a few scalars up to which the smaller side of a join is broadcast.
BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a key and a few scalars a row, to be broadcast if it is counted to have ``BROADCAST_ROWS`` at most: the
    other side of the join then stays where it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Folders of the tables written outside of any scope, and of those of the innermost scope of this context.
_TABLES: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: columnar, so later reads prune columns
    and skip pages, and independent of any executor. Columns in ``by`` become folders, of which a filter reads only its own.

    Results that read it stay lazy, so it is kept until its ``scope`` ends; outside of a scope until ``drop_written`` or the
    end of the process.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    mine = _SCOPE.get()
    if mine is None:
        if not _TABLES:
            atexit.register(_drop_at_exit, spark)
        mine = _TABLES
    mine.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written within it, by this thread or task: store results before."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _drop(spark, mine)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of frames that nothing refers to any more: Spark removes them after a collection of the
    driver's garbage, which else may not come before the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables written outside of any scope; call it once their readers' results are stored. Gives their number."""
    n = len(_TABLES)
    _drop(spark, _TABLES)
    return n


def _drop(spark: SparkSession, tables: list[str]) -> None:
    while tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit(spark: SparkSession) -> None:
    with suppress(Exception):  # the JVM may be gone
        _drop(spark, _TABLES)
