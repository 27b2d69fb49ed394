"""Stored answers of queries, looked up by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.functions.json_text import to_json_text
from inkfold.operators.folded import FoldedTable


# What a client gets instead of dates.
NO_DATABASE = "database: {} is not existed"
NO_LOG = "No This Collection: LogInfo"


def latest_results(results: DataFrame) -> DataFrame:
    """The newest value per key of ``(key, seq, value)``.

    An aggregate, not a window: a key written very often is combined on the map side.
    """
    return results.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


ANSWERS = "key string, seq long, value string"


def fold_results(table: FoldedTable, results: DataFrame) -> DataFrame:
    """Fold new rows ``(key, seq, value)`` into the newest answer of each key.

    A read costs the number of keys, whatever the history.  Rows may come in any order, also
    late ones, and a batch that is folded twice changes nothing.  Of equal ``seq`` the
    largest value counts.
    """
    rows = table.read().unionByName(results.select("key", "seq", "value")).filter(F.col("seq").isNotNull())
    newest = rows.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("newest"))
    return table.replace(newest.select("key", "newest.*"))


def folded_results(table: FoldedTable) -> DataFrame:
    """The newest value per key, as :func:`latest_results` finds it in the whole history."""
    return table.read().select("key", "value")


def next_dates_result(
    answer: DataFrame | None, seq: int, database: str, spark: SparkSession
) -> DataFrame:
    """The answer to ``nextDate`` as a row ``(key, seq, value)``.

    Without a database or a log the value holds the message the client gets.
    """
    head = [F.lit("nextDate").alias("key"), F.lit(seq).cast("bigint").alias("seq")]
    if answer is None:
        text = F.lit(NO_DATABASE.format(database))
        value = F.struct(F.lit("no_database").alias("status"), text.alias("message"))
        return spark.range(1).select(*head, to_json_text(value).alias("value"))
    message = F.when(F.col("status") == "no_collection", F.lit(NO_LOG))
    row = F.struct(*answer.columns, message.alias("message"))
    return answer.select(*head, to_json_text(row).alias("value"))
