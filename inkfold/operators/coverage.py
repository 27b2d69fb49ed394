"""Which days the stored log covers, and which to collect next."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from inkfold.functions.dates import days_between
from inkfold.operators.folded import FoldedTable

# Fixed value: the first day worth collecting.
FLOOR = dt.date(2015, 10, 1)


def log_days(log: DataFrame, date: str = "date") -> DataFrame:
    """The distinct days of a log: combined per task before the one small shuffle."""
    return log.select(F.col(date).cast("date").alias("date")).filter("date is not null").distinct()


def coverage(log: DataFrame, date: str = "date") -> DataFrame:
    """One row ``(n_dates, min_date, max_date, n_calendar, has_gap)`` from one pass."""
    return (
        log_days(log, date)
        .agg(
            F.count("*").alias("n_dates"),
            F.min("date").alias("min_date"),
            F.max("date").alias("max_date"),
        )
        .withColumn("n_calendar", F.date_diff("max_date", "min_date").cast("bigint") + 1)
        .withColumn("has_gap", F.col("n_dates") != F.col("n_calendar"))
    )


def next_dates(log: DataFrame, today: dt.date, floor: dt.date = FLOOR, date: str = "date") -> DataFrame:
    """What to collect next, as one row.

    ``status`` is ``no_collection`` (nothing stored), ``gap`` (days are missing in
    between), ``backfill`` (days before the first one are open) or ``forward``.
    ``before`` and ``after`` are the days next to what is stored; ``first`` and
    ``last`` bound the range to collect and are NULL for a gap.
    """
    return _next_of(coverage(log, date), today, floor)


def _next_of(covered: DataFrame, today: dt.date, floor: dt.date) -> DataFrame:
    low, now = F.lit(floor), F.lit(today)
    status = (
        F.when(F.col("n_dates") == 0, "no_collection")
        .when(F.col("has_gap"), "gap")
        .when(F.col("min_date") > low, "backfill")
        .otherwise("forward")
    )
    is_backfill, is_forward = F.col("status") == "backfill", F.col("status") == "forward"
    return (
        covered.withColumn("status", status)
        .withColumn("before", F.when(is_backfill, F.date_sub("min_date", 1)))
        .withColumn("after", F.when(is_backfill | is_forward, F.date_add("max_date", 1)))
        .withColumn(
            "first",
            F.when(is_backfill | (F.col("status") == "no_collection"), low).when(
                is_forward, F.col("after")
            ),
        )
        .withColumn(
            "last",
            F.when(is_backfill, F.col("before")).when(F.col("status") != "gap", now),
        )
        .select("status", "n_dates", "min_date", "max_date", "before", "after", "first", "last")
    )


def date_walk(ranges: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Every day from first to last; none when first is later or unknown."""
    days = F.explode_outer(days_between(F.col(first), F.col(last)))
    return ranges.select(days.alias("date")).filter("date is not null")


def missing_dates(log: DataFrame, date: str = "date") -> DataFrame:
    """The days between the first and the last stored one that are not stored."""
    spine = date_walk(coverage(log, date), "min_date", "max_date")
    return spine.join(log_days(log, date), "date", "left_anti")


# ---------------------------------------------------------------- covered days as intervals

INTERVALS = "first date, last date"


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals ``(first, last)`` without those that overlap or follow on the day after.

    Days are few, whatever the log: the window runs over the distinct intervals of a calendar.
    """
    order = Window.orderBy("first", "last")
    upto = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > F.date_add(upto, 1), F.lit(True))
    island = F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.filter("first <= last").distinct().withColumn("begins", begins)
    return marked.withColumn("island", island).groupBy("island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def covered_intervals(log: DataFrame, date: str = "date") -> DataFrame:
    """The unbroken runs of days that a log covers, from one pass over it."""
    return merge_intervals(log_days(log, date).select(F.col("date").alias("first"), F.col("date").alias("last")))


def fold_coverage(table: FoldedTable, log: DataFrame, date: str = "date") -> DataFrame:
    """Fold new log rows into the covered intervals; rows may come late and more than once."""
    return table.replace(merge_intervals(table.read().unionByName(covered_intervals(log, date))))


def coverage_of(intervals: DataFrame) -> DataFrame:
    """:func:`coverage` from intervals, without the log."""
    days = F.date_diff("last", "first").cast("bigint") + 1
    return (
        intervals.agg(F.coalesce(F.sum(days), F.lit(0).cast("bigint")).alias("n_dates"), F.min("first").alias("min_date"), F.max("last").alias("max_date"))
        .withColumn("n_calendar", F.date_diff("max_date", "min_date").cast("bigint") + 1)
        .withColumn("has_gap", F.col("n_dates") != F.col("n_calendar"))
    )


def next_dates_of(intervals: DataFrame, today: dt.date, floor: dt.date = FLOOR) -> DataFrame:
    """:func:`next_dates` from intervals, without the log."""
    return _next_of(coverage_of(intervals), today, floor)


def missing_dates_of(intervals: DataFrame) -> DataFrame:
    """:func:`missing_dates` from intervals: the days between one and the next."""
    following = F.lead("first").over(Window.orderBy("first"))
    gaps = intervals.withColumn("next", following).filter("next is not null")
    return date_walk(gaps.select(F.date_add("last", 1).alias("first"), F.date_sub("next", 1).alias("last")))
