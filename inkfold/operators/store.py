"""Writing and finding stored documents.

One layout serves batch and stream: ``stored/run=../batch_id=../branch=../bucket=..``.
A run is one batch job or one stream (its checkpoint's identity), so nothing that
another run stored is ever replaced.  Small batches are joined by :mod:`inkfold.operators.joining`.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from inkfold.operators import routing as R
from inkfold.operators.folded import FoldedTable
from inkfold.session import drop_landed, land

#: Partitions of the article store.
BUCKETS = 64
#: Rows that a task of a write takes at most, and those that are worth a task.
ROWS_A_TASK, LEAST_ROWS = 200_000, 2_000

STORED = "stored"
_TEXT = ("collection", "keywords", "link", "title", "content", "post_info", "list_type", "stage", "reason", "payload", "file")
STORE = (
    T.StructType([T.StructField(name, T.StringType()) for name in _TEXT])
    .add("pre_info", T.ArrayType(T.StringType())).add("date", "date").add("total", "long")
    .add("ingested_at", "timestamp_ntz").add("origin_run", "string").add("origin_batch", "long")
    .add("run", "string").add("batch_id", "long").add("branch", "string").add("bucket", "integer")
)

DRAINED = "drained"
DRAINED_SCHEMA = T.StructType().add("file", "string").add("messages", "long").add("run", "string").add("batch_id", "long")

INDEX = "collections"
INDEX_SCHEMA = (
    T.StructType().add("branch", "string").add("bucket", "integer").add("collection", "string").add("rows", "long")
    .add("newest", "timestamp_ntz").add("run", "string").add("batch_id", "long")
)


#: What the names of runs begin with: a batch job's, a joined run's; a stream's is hexadecimal.
JOB, JOINED = "job-", "joined-"


def new_run(kind: str) -> str:
    return kind + uuid.uuid4().hex


def joins(spark: SparkSession, root: str) -> FoldedTable:
    """Joined runs that count (live), and runs whose batches up to a number do not any more."""
    return FoldedTable(spark, os.path.join(root, "joins"), "run string, upto long, live boolean")


def visible(spark: SparkSession, root: str) -> Column:
    """Which ``run`` and ``batch_id`` count: a condition on folders, so others are not opened."""
    table = joins(spark, root)
    # Live joined runs, few, and runs replaced since the last `delete_replaced`.
    entries = table.read().collect() if table.versions() else []
    run, condition = F.col("run"), ~F.col("run").startswith(JOINED)
    whole = [r.run for r in entries if not r.live and r.run.startswith(JOB)]
    if whole:
        condition &= ~run.isin(whole)
    for r in entries:
        if not r.live and not r.run.startswith((JOB, JOINED)):
            condition &= ~((run == r.run) & (F.col("batch_id") <= r.upto))
    return condition | run.isin([r.run for r in entries if r.live])


def stamp(df: DataFrame) -> DataFrame:
    """Add the time of storing."""
    return df.withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))


def bucket_of(collection: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(collection, F.lit(""))), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, counts: DataFrame, tasks: int, total: int) -> DataFrame:
    """Rows with their task: ranges of (branch, bucket, collection), equal to a row or two.

    All rows stand in one order, given by the counts alone: a collection begins where those
    before it end, and its rows take its places by a hash of their text.  So the rows of a
    large collection go to several tasks, and no task's range overlaps another's.
    """
    before = Window.partitionBy("branch", "bucket").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each branch and bucket: a fixed number.
    buckets = counts.groupBy("branch", "bucket").agg(F.sum("rows").alias("all"))
    ahead = Window.orderBy("branch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.select("branch", "bucket", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("begin"))
    places = counts.withColumn("inside", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(begins, ["branch", "bucket"])
    places = places.select("branch", "bucket", "name", "rows", (F.col("begin") + F.col("inside")).alias("place"))
    place = F.col("place") + F.pmod(F.col("_salt"), F.col("rows"))
    placed = rows.join(places, ["branch", "bucket", "name"])
    return placed.withColumn("_task", F.floor(place * tasks / max(1, total)).cast("int")).drop("rows", "place", "_salt", "name")


def store_rows(rows: DataFrame, root: str, run: str, batch_id: int, buckets: int = BUCKETS, rows_a_task: int = ROWS_A_TASK) -> str:
    """Store rows that carry their ``branch``; a batch of a run replaces only itself.

    The rows are made once, landed, counted by collection and dealt by these counts: the
    files of a bucket hold ranges of collections that do not overlap, so the ranges in the
    footers let a reader of one collection skip the other files, and no task gets an
    oversized share.  The counts are kept as the index of collections, written last: a
    batch without them is found by :func:`rebuild_index`.  Rows that carry ``ingested_at``
    keep it.
    """
    spark = rows.sparkSession
    path = os.path.join(root, STORED, f"run={run}", f"batch_id={batch_id}")
    known = {f.name: f.dataType for f in STORE.fields}
    columns = [F.col(c).cast(known[c]).alias(c) for c in rows.columns if c in known and c not in ("run", "batch_id", "bucket")]
    salt = F.xxhash64(*[c for c in ("link", "title", "content", "payload") if c in rows.columns] or ["collection"])
    kept = rows.select(*columns)
    named = (kept if "ingested_at" in kept.columns else stamp(kept)).select(
        "*", bucket_of(F.col("collection"), buckets).alias("bucket"), salt.alias("_salt"), F.coalesce("collection", F.lit("")).alias("name"))
    staged = land(named, "staged")
    counts = land(staged.groupBy("branch", "bucket", "name").agg(F.count("*").alias("rows"), F.max("ingested_at").alias("newest")), "counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    tasks = max(1, -(-total // rows_a_task), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)))
    (
        _dealt(staged, counts.drop("newest"), tasks, total)
        .repartitionById(tasks, F.col("_task"))
        .drop("_task")
        .sortWithinPartitions("branch", "bucket", "collection")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("branch", "bucket")
        .parquet(path)
    )
    index = counts.withColumnRenamed("name", "collection")
    index.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        os.path.join(root, INDEX, f"run={run}", f"batch_id={batch_id}"))
    drop_landed(staged, counts)
    return path


def append_articles(articles: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Append to the collections; a collection comes to be with its first article."""
    store_rows(articles.withColumn("branch", F.lit(R.ARTICLE_BRANCH)), root, new_run(JOB), 0, buckets)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows where nothing has been written yet; other faults are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored(spark: SparkSession, root: str, branch: str = R.ARTICLE_BRANCH) -> DataFrame:
    """What batch jobs and streams have stored of a branch; no rows on the first day."""
    rows = read_or_empty(spark, os.path.join(root, STORED), STORE).filter((F.col("branch") == branch) & visible(spark, root))
    # Rows of a joined run name the batch that brought them.
    return rows.withColumns({"run": F.coalesce("origin_run", "run"), "batch_id": F.coalesce("origin_batch", "batch_id")}).drop(
        "origin_run", "origin_batch")


def read_collection(articles: DataFrame, collection: str, buckets: int = BUCKETS) -> DataFrame:
    """One collection of the stored articles, reading its bucket's partitions only."""
    name = F.lit(collection)
    return articles.filter((F.col("bucket") == bucket_of(name, buckets)) & (F.col("collection") == name))


def collection_index(spark: SparkSession, root: str, branch: str = R.ARTICLE_BRANCH) -> DataFrame:
    """``(collection, rows, newest)`` of what is stored, from the index: no article is read."""
    index = read_or_empty(spark, os.path.join(root, INDEX), INDEX_SCHEMA).filter((F.col("branch") == branch) & visible(spark, root))
    return index.groupBy("collection").agg(F.sum("rows").alias("rows"), F.max("newest").alias("newest"))


def rebuild_index(spark: SparkSession, root: str) -> int:
    """Index the batches that have no index: those of an older store, or of a job that died
    between its two writes.  Returns how many index rows were added."""
    batch = ["run", "batch_id"]
    known = land(read_or_empty(spark, os.path.join(root, INDEX), INDEX_SCHEMA).select(*batch).distinct(), "indexed")
    rows = read_or_empty(spark, os.path.join(root, STORED), STORE).filter(visible(spark, root)).join(known, batch, "left_anti")
    missing = rows.groupBy(*batch, "branch", "bucket", F.coalesce("collection", F.lit("")).alias("collection")).agg(
        F.count("*").alias("rows"), F.max("ingested_at").alias("newest"))
    missing = land(missing, "missing")
    added = missing.count()
    if added:
        missing.write.mode("append").partitionBy(*batch).parquet(os.path.join(root, INDEX))
    drop_landed(known, missing)
    return added


def collection_exists(spark: SparkSession, root: str, collection: str | None = None) -> bool:
    """Is anything stored and, if named, the collection?  The index answers."""
    index = read_or_empty(spark, os.path.join(root, INDEX), INDEX_SCHEMA).filter(
        (F.col("branch") == R.ARTICLE_BRANCH) & visible(spark, root))
    if collection is not None:
        index = index.filter(F.col("collection") == collection)
    return not index.isEmpty()


def mark_existing(names: DataFrame, articles: DataFrame) -> DataFrame:
    """Add ``present`` to many collection names at once: ``(collection, present)``.

    Hand over :func:`collection_index`, which has a row a collection; stored articles do too.
    """
    there = articles.select("collection").distinct().withColumn("present", F.lit(True))
    return names.join(there, "collection", "left").select(
        "collection", F.coalesce("present", F.lit(False)).alias("present")
    )


def export_items(items: DataFrame, path: str) -> None:
    """Items as JSON lines in UTF-8, null fields kept."""
    items.write.mode("overwrite").option("ignoreNullFields", "false").option(
        "encoding", "UTF-8"
    ).json(path)
