"""Draining the message queue into the store with Structured Streaming.

The queue is a folder of text files, one message per line.  Batch and stream use the
same decoding, routing and store.  A micro-batch is stored under the identity of its
stream, which lies in the checkpoint, and its batch id: a retry after a lost executor or
a restart replaces it, so every message is stored once, and another queue or a new
checkpoint never touches what is there.

A batch is decoded once: its routed rows are landed, counted and dealt to files.  Its rows
carry the branch they belong to as a partition, and each reader below sees its own branch only.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold.operators import routing as R
from inkfold.operators.messages import decode_messages
from inkfold.operators.store import DRAINED, DRAINED_SCHEMA, read_or_empty, store_rows, stored, visible


def enqueue(messages: DataFrame, queue: str) -> None:
    """Put messages (``value``) on the queue."""
    messages.select("value").write.mode("append").text(queue)


def store_batch(batch: DataFrame, batch_id: int, root: str, run: str) -> None:
    """Route one micro-batch ``(value, file)`` and store it as a batch of its run."""
    path = store_rows(R.branches(R.route(decode_messages(batch))), root, run, batch_id)
    # Last: files count as drained once their messages are stored.
    files = batch.sparkSession.read.schema("file string").parquet(path).groupBy("file").agg(F.count("*").alias("messages"))
    files.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        os.path.join(root, DRAINED, f"run={run}", f"batch_id={batch_id}")
    )


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns a checkpoint; it survives restarts."""
    text = spark.read.text(os.path.join(checkpoint, "metadata")).first().value
    return json.loads(text)["id"].replace("-", "")


def settled_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a stream will not write again, -1 before the first; for joining."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint, "commits"))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return max((int(name) for name in names if name.isdigit()), default=-1)


def _make_folder(spark: SparkSession, path: str) -> None:
    """A stream needs its source to be there, if empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def start_drain(
    spark: SparkSession,
    queue: str,
    root: str,
    checkpoint: str,
    max_bytes: int = 1 << 40,
    until_empty: bool = True,
    archive: str | None = None,
) -> StreamingQuery:
    """Start draining, about ``max_bytes`` of the queue per micro-batch.

    With ``until_empty`` the query ends when what is there is stored.  Files that are
    done go to the folder ``archive``, if one is named.
    """
    _make_folder(spark, queue)
    reader = spark.readStream.option("maxBytesPerTrigger", max_bytes)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.text(queue).select("value", F.col("_metadata.file_path").alias("file"))
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: store_batch(batch, batch_id, root, stream_identity(batch.sparkSession, checkpoint))
    )
    if until_empty:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def drain(spark: SparkSession, queue: str, root: str, checkpoint: str, max_bytes: int = 1 << 40) -> None:
    """Store everything that is on the queue, then return."""
    start_drain(spark, queue, root, checkpoint, max_bytes).awaitTermination()


def stop_when_idle(
    query: StreamingQuery, wait_step: float = 1.0, max_waits: int = 5, producer_ended: Callable[[], bool] | None = None
) -> bool:
    """Stop a running drain after ``max_waits`` polls in a row without new messages, or
    after one such poll once the producer has ended.

    False: it was stopped.  True: the query had ended by itself.
    """
    if wait_step * max_waits <= 0:
        raise ValueError("wait_step * max_waits must be greater than 0")
    idle, last_batch = 0, None
    while idle < max_waits:
        # Asked before the poll: what the producer sent last is seen by the poll.
        ended = producer_ended is not None and producer_ended()
        if query.awaitTermination(wait_step):
            return True
        progress = query.lastProgress
        batch = progress["batchId"] if progress and progress["numInputRows"] else last_batch
        busy = query.status["isTriggerActive"] and query.status["isDataAvailable"]
        idle = 0 if busy or batch != last_batch else idle + 1
        last_batch = batch
        if ended and idle:
            query.processAllAvailable()
            break
    query.stop()
    return False


# ---------------------------------------------------------------- readers


def drained_articles(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, root, R.ARTICLE_BRANCH).select(*R.ARTICLE_COLUMNS, "ingested_at", "run", "batch_id")


def drained_log(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, root, R.LOG_BRANCH).select(*R.LOG_COLUMNS, "ingested_at", "run", "batch_id")


def drained_rejects(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, root, R.REJECT_BRANCH).select(*R.REJECT_COLUMNS, "ingested_at", "run", "batch_id")


def drained_files(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, os.path.join(root, DRAINED), DRAINED_SCHEMA).filter(visible(spark, root))


def backlog(spark: SparkSession, queue: str, root: str) -> DataFrame:
    """How many messages are still on the queue: one row ``(files, messages)``; files
    without a byte do not count.

    The queue is listed by name, and the names of drained files are taken away by a join.
    What is read starts at the oldest file that waits: of the drained ones only those that
    are younger than it.  The driver sees that one time, no names.
    """
    empty = spark.createDataFrame([(0, 0)], "files bigint, messages bigint")
    file = F.col("_metadata.file_path").alias("file")
    try:
        names = spark.read.format("binaryFile").load(queue).select(file, "modificationTime")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    waiting = names.join(drained_files(spark, root).select("file").distinct(), "file", "left_anti")
    # A second less: the option takes whole seconds and what is later.
    oldest = F.date_format(F.date_trunc("second", F.min("modificationTime")) - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")
    since = waiting.agg(oldest).first()[0]
    if since is None:
        return empty
    lines = spark.read.option("modifiedAfter", since).text(queue).select(file).groupBy("file").agg(F.count("*").alias("n"))
    counted = waiting.join(lines, "file", "left")
    return counted.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
