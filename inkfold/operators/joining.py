"""Joining the small files of ended batches.

Each micro-batch writes a file for every branch and bucket it touches.  :func:`join_batches`
writes the rows of many batches as one run, dealt to files anew, and then replaces the batches
in one step: the small table of joins (``joins/``, a folder a version) names the runs that
count and the batches that do not count any more.  Readers take that table first, so they see
the batches or the joined run and never both: a joined run counts only once it is named, and
what it replaces stays until :func:`delete_replaced`.

A join that dies leaves a run that nobody reads, and the next one starts again.  One join at a
time; drains and batch jobs may go on beside it.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkfold.operators.store import (
    BUCKETS, DRAINED, DRAINED_SCHEMA, INDEX, INDEX_SCHEMA, JOB, JOINED, ROWS_A_TASK, STORE, STORED,
    joins, new_run, read_or_empty, store_rows, visible,
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _chosen(index: DataFrame, streams: dict[str, int]) -> list[tuple[str, int]]:
    """Runs and the batch up to which they are joined.

    Joined runs are taken along when they are no larger than what is joined so far, so that
    a row is written anew only as often as the store doubles.
    """
    ended = F.col("run").startswith(JOB) | _any([(F.col("run") == run) & (F.col("batch_id") <= upto) for run, upto in streams.items()])
    sizes = index.filter(ended | F.col("run").startswith(JOINED)).groupBy("run").agg(
        F.sum("rows").alias("rows"), F.max("batch_id").alias("upto"), F.count_distinct("batch_id").alias("batches"))
    # A row a run that is not joined yet: fewer than the folders that Spark lists to read the store.
    runs = sizes.collect()
    fresh = [r for r in runs if not r.run.startswith(JOINED)]
    taken = [(r.run, streams.get(r.run, r.upto)) for r in fresh]
    rows, pieces = sum(r.rows for r in fresh), sum(r.batches for r in fresh)
    for old in sorted((r for r in runs if r.run.startswith(JOINED)), key=lambda r: (r.rows, r.run)):
        if not fresh or old.rows > rows:
            break
        taken.append((old.run, old.upto))
        rows, pieces = rows + old.rows, pieces + 1
    return taken if pieces > 1 else []


def join_batches(
    spark: SparkSession, root: str, streams: dict[str, int] | None = None, buckets: int = BUCKETS, rows_a_task: int = ROWS_A_TASK
) -> str | None:
    """Write the rows of ended batches as one run that replaces them; the name of that run.

    Batch jobs count as ended once their index is written.  Of a stream the batches up to the
    number in `streams` (run to last settled batch, see ``drain.settled_batch``) are joined, so
    it may go on.  Rows keep their run, batch and time of storing.  None: fewer than two
    batches are there to join.
    """
    table = joins(spark, root)
    index = read_or_empty(spark, os.path.join(root, INDEX), INDEX_SCHEMA).filter(visible(spark, root))
    chosen = _chosen(index, streams or {})
    if not chosen:
        return None
    whole = [run for run, _ in chosen if run not in (streams or {})]
    mine = F.col("run").isin(whole) | _any([(F.col("run") == run) & (F.col("batch_id") <= upto) for run, upto in chosen if run not in whole])
    # Batches of a stream that an earlier join has replaced, and that are not deleted yet.
    mine &= visible(spark, root)
    rows = spark.read.schema(STORE).parquet(os.path.join(root, STORED)).filter(mine)
    rows = rows.withColumns({
        "origin_run": F.coalesce("origin_run", "run"), "origin_batch": F.coalesce("origin_batch", "batch_id")})
    into = new_run(JOINED)
    store_rows(rows, root, into, 0, buckets, rows_a_task)
    files = read_or_empty(spark, os.path.join(root, DRAINED), DRAINED_SCHEMA).filter(mine)
    files.groupBy("file").agg(F.sum("messages").alias("messages")).write.mode("overwrite").parquet(
        os.path.join(root, DRAINED, f"run={into}", "batch_id=0"))
    replaced = {run: upto for run, upto in chosen}
    known = [tuple(r) for r in table.read().collect() if r.run not in replaced]
    entries = known + [(run, upto, False) for run, upto in chosen] + [(into, 0, True)]
    # The one step in which the batches stop counting and the joined run begins to.
    table.replace(spark.createDataFrame(entries, table.schema).coalesce(1))
    return into


def delete_replaced(spark: SparkSession, root: str) -> int:
    """Delete the batches that joined runs have replaced, and what dead joins have left.

    To be called when readers that began before the join have ended, and not beside a join.
    Returns how many batches were deleted.
    """
    table = joins(spark, root)
    entries = table.read().collect()
    live = {r.run for r in entries if r.live}
    replaced = {r.run: r.upto for r in entries if not r.live}
    context, gone = spark.sparkContext, 0
    at = lambda *parts: context._jvm.org.apache.hadoop.fs.Path(os.path.join(root, *parts))
    files = at().getFileSystem(context._jsc.hadoopConfiguration())
    listed = lambda path: [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
    for part in (STORED, INDEX, DRAINED):
        for run in listed(at(part)):
            name = run.getName().removeprefix("run=")
            dead = name.startswith(JOINED) and name not in live and name not in replaced
            if not dead and name not in replaced:
                continue
            batches = [b for b in listed(run) if b.getName().startswith("batch_id=")]
            old = [b for b in batches if dead or int(b.getName().removeprefix("batch_id=")) <= replaced[name]]
            for batch in old:
                files.delete(batch, True)
            gone += len(old) if part == STORED else 0
            if len(old) == len(batches) and (dead or not name.isalnum()):
                files.delete(run, True)
    if replaced:
        table.replace(spark.createDataFrame([(r, 0, True) for r in sorted(live)], table.schema).coalesce(1))
    return gone
