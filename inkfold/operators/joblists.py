"""URL lists and the job messages made of them.

A list is the set of rows ``(date, part, pos, url, pre_info)`` with one key
``(date, part)`` and positions 0, 1, 2, ...  Its log is one row ``(date, part, total)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from inkfold.functions.json_text import is_object, parse_object, the_object, to_json_text
from inkfold.functions.once import compute_once
from inkfold.sources.feeds import LIST_KEY

#: URLs per job message.  A longer list becomes several messages, so no row ever
#: has to hold a list of unknown length.
MAX_URLS = 10_000
SUB_LIST = "subList"
#: Consecutive parts of a day that are numbered together.
_PARTS_PER_BLOCK = 4_096


def list_counts(lists: DataFrame) -> DataFrame:
    """Length of every list."""
    return lists.groupBy(*LIST_KEY).agg(F.count("*").alias("n"))


def append_lists(lists: DataFrame, more: DataFrame) -> DataFrame:
    """Put the rows of ``more`` behind the list of the same key, in their own order."""
    moved = (
        more.join(list_counts(lists), LIST_KEY, "left")
        .withColumn("pos", F.col("pos") + F.coalesce("n", F.lit(0)))
        .drop("n")
    )
    return lists.unionByName(moved)


def replace_lists(lists: DataFrame, new: DataFrame) -> DataFrame:
    """Lists whose key occurs in ``new`` are swapped for the new rows."""
    return clear_lists(lists, new).unionByName(new)


def clear_lists(lists: DataFrame, keys: DataFrame) -> DataFrame:
    """Empty the lists with the given keys."""
    return lists.join(keys.select(*LIST_KEY).distinct(), LIST_KEY, "left_anti")


def write_lists(lists: DataFrame, path: str) -> None:
    """Store lists by day; the days that occur replace what was stored for them."""
    (
        lists.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def slice_lists(lists: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The rows ``[start:stop]`` of every list; negative bounds count from its end.

    Bounds from the front are a plain filter.  Only negative ones need the lengths.
    """
    need_length = (start or 0) < 0 or (stop is not None and stop < 0)
    rows = lists.join(list_counts(lists), LIST_KEY) if need_length else lists

    def bound(value: int) -> Column:
        return F.col("n") + value if value < 0 else F.lit(value)

    first = F.greatest(bound(start), F.lit(0)) if start else F.lit(0)
    if start:
        rows = rows.filter(F.col("pos") >= first)
    if stop is not None:
        rows = rows.filter(F.col("pos") < bound(stop))
    return (
        rows.withColumn("pos", F.col("pos") - first)
        .withColumn("list_type", F.lit(SUB_LIST))
        .drop("n")
    )


def number_jobs(logs: DataFrame, first: int = 0) -> DataFrame:
    """Add ``index``: lists counted from ``first`` in the order of (date, part).

    Counting is done in blocks of neighbouring parts, then over the blocks of a day,
    then over the days, so that no window ever holds more than a block, a day's
    blocks or the calendar.
    """
    blocks = logs.withColumn("block", F.floor(F.col("part") / _PARTS_PER_BLOCK))
    per_block = blocks.groupBy("date", "block").agg(F.count("*").alias("jobs"))
    per_day = per_block.groupBy("date").agg(F.sum("jobs").alias("jobs"))

    def jobs_before(window) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("jobs").over(earlier), F.lit(0))

    # One row per calendar day: small whatever the number of lists.
    day_start = per_day.select("date", jobs_before(Window.orderBy("date")).alias("day_start"))
    in_day = jobs_before(Window.partitionBy("date").orderBy("block"))
    starts = (
        per_block.select("date", "block", in_day.alias("in_day"))
        .join(day_start, "date")
        .select("date", "block", (F.col("day_start") + F.col("in_day")).alias("block_start"))
    )
    in_block = F.row_number().over(Window.partitionBy("date", "block").orderBy("part")) - 1
    # The join key is the window's: the lists are shuffled once, in groups of a block.
    return (
        blocks.withColumn("in_block", in_block)
        .join(starts, ["date", "block"])
        .withColumn("index", F.lit(first) + F.col("block_start") + F.col("in_block"))
        .drop("block", "in_block", "block_start")
    )


# ---------------------------------------------------------------- messages

LOG_INFO = T.StructType().add("Date", "string").add("Total", "long").add("type", "string")
# The keys index, logInfo, preInfo, urlList and the type subList.  The keys
# start and pairing are added by this library and may be absent.
JOB = (
    T.StructType()
    .add("index", "long")
    .add("start", "long")
    .add("pairing", "string")
    .add("logInfo", LOG_INFO)
    .add("preInfo", T.ArrayType(T.ArrayType(T.StringType())))
    .add("urlList", T.ArrayType(T.StringType()))
)


def log_struct(date: str = "date", total: str = "total") -> Column:
    """The log of a list as it stands in messages."""
    return F.struct(F.date_format(date, "yyyy-MM-dd").alias("Date"), F.col(total).alias("Total"))


def job_messages(numbered: DataFrame, lists: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """``(index, start, message)``: each list as JSON, at most ``max_urls`` URLs a message.

    A message carries all of itself: the position of its first URL, the way its companies
    are paired, and the type of a sub list.  A list without entries still gives one
    message, for its log.  Lists without a log are for :func:`unlogged_lists`.

    The slices of a long list share its key; they are the left side of an inner join
    with a row for each list, so AQE can split them.
    """
    kind = F.max("list_type") if "list_type" in lists.columns else F.max(F.lit(None).cast("string"))
    slices = (
        lists.withColumn("start", F.floor(F.col("pos") / max_urls) * max_urls)
        .groupBy(*LIST_KEY, "start")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "url", "pre_info"))).alias("entries"),
            kind.alias("list_type"),
        )
    )
    filled = slices.join(numbered, LIST_KEY)
    empty = numbered.join(lists.select(*LIST_KEY).distinct(), LIST_KEY, "left_anti").select(
        "*", F.lit(0).alias("start"), F.lit(None).cast("string").alias("list_type"),
        F.array().cast("array<struct<pos:bigint,url:string,pre_info:array<string>>>").alias("entries"),
    )
    columns = ["index", "start", "date", "total", "list_type", "entries"]
    rows = filled.select(*columns).unionByName(empty.select(*columns))
    log = log_struct()
    typed = F.struct(log["Date"].alias("Date"), log["Total"].alias("Total"), F.col("list_type").alias("type"))

    def text(info: Column) -> Column:
        return to_json_text(
            F.struct(
                "index", F.col("start").cast("bigint").alias("start"), F.lit("paired").alias("pairing"),
                info.alias("logInfo"),
                F.transform("entries", lambda e: e["pre_info"]).alias("preInfo"),
                F.transform("entries", lambda e: e["url"]).alias("urlList"),
            )
        )

    message = F.when(F.col("list_type").isNull(), text(log)).otherwise(text(typed))
    return rows.select("index", F.col("start").cast("bigint").alias("start"), message.alias("message"))


def unlogged_lists(numbered: DataFrame, lists: DataFrame) -> DataFrame:
    """Entries of lists that have no log, as rejects: no job can be made of them."""
    return lists.join(numbered.select(*LIST_KEY), LIST_KEY, "left_anti").select(
        F.lit("job").alias("stage"), F.lit("list without log").alias("reason"), F.col("url").alias("payload")
    )


def parse_jobs(messages: DataFrame) -> DataFrame:
    """``(index, start, log_date, total, list_type, pairing, pre_infos, urls, bad, message)``.

    Only the column ``message`` is read.  A message without ``start`` begins its list.
    """
    parsed = messages.select("message", parse_object(F.col("message"), JOB).alias("_p"))
    return compute_once(parsed, "_p").withColumn("job", the_object(F.col("_p"))).select(
        "job.index",
        F.coalesce("job.start", F.lit(0)).cast("bigint").alias("start"),
        F.col("job.logInfo.Date").alias("log_date"),
        F.col("job.logInfo.Total").alias("total"),
        F.col("job.logInfo.type").alias("list_type"),
        "job.pairing",
        F.col("job.preInfo").alias("pre_infos"),
        F.col("job.urlList").alias("urls"),
        (~is_object(F.col("_p"))).alias("bad"),
        "message",
    )


def job_logs(jobs: DataFrame) -> DataFrame:
    """One log row per job, whatever the number of its messages."""
    return jobs.filter((F.col("start") == 0) & ~F.col("bad")).select(
        "index", "log_date", "total", "list_type"
    )


def job_rejects(jobs: DataFrame) -> DataFrame:
    """Job messages that could not be read."""
    return jobs.filter("bad").select(
        F.lit("job").alias("stage"), F.lit("bad json").alias("reason"),
        F.col("message").alias("payload"),
    )
