"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one set on the context.

    Where none is set and Spark runs in one process, a temporary folder is set; on a cluster that is an error, as executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-speechtab-"))
    return context._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, which cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, which cuts its lineage and takes a fraction of a checkpoint's disk; deleted when the driver ends.

    Shuffle files of plans that are done stay until the driver collects its garbage, so it is asked to: the next step finds their disk free. ``done`` are staged tables that no
    other plan reads: they go as soon as ``df`` is written.
    """
    path = shared_path(df.sparkSession, "staged")
    df.write.option("compression", "zstd").parquet(path)
    discard(*done)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no plan still to run reads; others are left alone."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            _delete(t.sparkSession, path)


def bounded(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; beyond that joins shuffle it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
