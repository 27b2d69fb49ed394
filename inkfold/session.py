"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What every job here relies on.  AQE splits skewed join partitions and turns a
#: shuffle join into a broadcast only after it has seen the real size of a side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows that go to Python at once: whole documents stand in them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

#: Only when a session is built: plans are long, and recording the Python line of
#: every column makes them slow to write down.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on a session somebody else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path every executor can reach, for written tables and checkpoints.

    The cluster names the folder in ``spark.checkpoint.dir``.  Only where that is
    unset (a local test session) does a machine-local folder take its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="inkfold-")
    return os.path.join(base, f"{_MARK}{spark.sparkContext.applicationId}-{purpose}-{uuid.uuid4().hex}")


def land(rows: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage, is made once
    however often it is used, and outlives executors."""
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table._landed_path = path
    return table


def drop_landed(*tables: DataFrame) -> None:
    """Delete landed tables that no later result reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._landed_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_MARK = "inkfold-"


def expire_shared(spark: SparkSession, older_than_hours: float = 48.0) -> int:
    """Delete folders of :func:`shared_dir` that nothing has changed for so long.

    The application that made a folder owns it and is named in it; this is for what ended
    applications have left.  Returns how many were deleted.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(base)
    files, limit, gone = folder.getFileSystem(conf), (time.time() - older_than_hours * 3600) * 1000, 0
    for status in files.listStatus(folder) if files.exists(folder) else []:
        name, own = status.getPath().getName(), f"{_MARK}{spark.sparkContext.applicationId}-"
        if name.startswith(_MARK) and not name.startswith(own) and status.getModificationTime() < limit:
            gone += bool(files.delete(status.getPath(), True))
    return gone
