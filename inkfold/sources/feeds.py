"""Daily news listings: addresses, unwrapping, parsing with repair, flattening.

A listing is a row ``(date, part, body)``.  ``part`` numbers the responses of one
day and is 0 where a day has a single one, so a busy day is many bounded rows and
never one huge row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkfold.functions.json_text import is_object, parse_object, the_object
from inkfold.functions.once import compute_once

LIST_KEY = ["date", "part"]

# The frame around the JSON of a listing, in bytes.
HEAD_BYTES = 15
TAIL_BYTES = 5
# Fixed value: a backslash that starts none of the escapes the feed really uses.
STRAY_BACKSLASH = r'\\(?![/u"])'
# Fixed value: where the daily listings are.
ADDRESS_ROOT = "http://stock.jrj.com.cn/share/news/company/"

NEWS = T.StructType().add("infourl", "string").add("stockname", "string")
PAYLOAD = T.StructType().add("newsinfo", T.ArrayType(T.ArrayType(NEWS)))


def source_addresses(dates: DataFrame, date: str = "date", root: str = ADDRESS_ROOT) -> DataFrame:
    """Add the address of each day's listing (without the cache-breaking query string)."""
    return dates.withColumn(
        "address", F.concat(F.lit(root), F.date_format(date, "yyyy-MM-dd"), F.lit(".js"))
    )


def unwrap(body: Column) -> Column:
    """The JSON bytes between the two parts of the frame."""
    length = F.greatest(F.octet_length(body) - (HEAD_BYTES + TAIL_BYTES), F.lit(0))
    return F.substring(body, F.lit(HEAD_BYTES + 1), length)


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """``(date, part, body)`` to ``(date, part, status, newsinfo, payload)``.

    status is ``ok``, ``repaired`` (parsed after doubling stray backslashes) or the
    reason of a reject: ``not utf-8``, ``bad json`` or ``no newsinfo``.
    """
    text = feeds.withColumn("payload", unwrap(F.col("body")).cast("string")).drop("body")
    first = text.withColumn("_first", parse_object(F.col("payload"), PAYLOAD))
    fixed = F.regexp_replace("payload", STRAY_BACKSLASH, r"\\\\")
    # Only rows that failed are parsed again: CASE evaluates its branches on demand.
    both = first.withColumn("_ok", is_object(F.col("_first"))).withColumn(
        "_second", F.when(~F.col("_ok"), parse_object(fixed, PAYLOAD))
    )
    news = F.when(F.col("_ok"), the_object(F.col("_first"))["newsinfo"]).when(
        is_object(F.col("_second")), the_object(F.col("_second"))["newsinfo"]
    )
    status = (
        F.when(~F.is_valid_utf8("payload"), "not utf-8")
        .when(~F.col("_ok") & ~is_object(F.col("_second")), "bad json")
        .when(F.col("newsinfo").isNull(), "no newsinfo")
        .when(F.col("_ok"), "ok")
        .otherwise("repaired")
    )
    judged = (
        both.withColumn("newsinfo", news)
        .withColumn("status", status)
        .select(*LIST_KEY, "status", "newsinfo", "payload")
    )
    return compute_once(judged, "status", "newsinfo")


def _accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status").isin("ok", "repaired"))


def _usable(entry: Column) -> Column:
    first = F.get(entry, F.lit(0))
    return first["infourl"].isNotNull() & first["stockname"].isNotNull()


def flatten_feeds(parsed: DataFrame) -> DataFrame:
    """One row per news entry: ``(date, part, pos, url, pre_info)``.

    Only the first element of an entry counts.  The company text is split at commas
    without trimming.  Unusable entries go to :func:`feed_rejects`; positions count
    the usable ones, so a list has no holes.
    """
    entries = F.transform(
        F.filter("newsinfo", lambda e: F.coalesce(_usable(e), F.lit(False))),
        lambda e: F.get(e, F.lit(0)),
    )
    rows = _accepted(parsed).select(*LIST_KEY, F.posexplode_outer(entries).alias("pos", "e"))
    return rows.filter("pos is not null").select(
        *LIST_KEY,
        F.col("pos").cast("bigint").alias("pos"),
        F.col("e.infourl").alias("url"),
        F.split("e.stockname", ",").alias("pre_info"),
    )


def daily_log(parsed: DataFrame) -> DataFrame:
    """One log row per listing, zero-news days included: ``(date, part, total)``."""
    return _accepted(parsed).select(
        *LIST_KEY, F.size("newsinfo").cast("bigint").alias("total")
    )


def feed_rejects(parsed: DataFrame) -> DataFrame:
    """``(stage, reason, payload)`` of unreadable listings and unusable entries."""
    bodies = parsed.filter(~F.col("status").isin("ok", "repaired")).select(
        F.lit("feed").alias("stage"), F.col("status").alias("reason"), "payload"
    )

    def judged(entry: Column) -> Column:
        first = F.get(entry, F.lit(0))
        reason = (
            F.when(first.isNull(), "empty entry")
            .when(first["infourl"].isNull(), "entry without infourl")
            .when(first["stockname"].isNull(), "entry without stockname")
        )
        return F.struct(reason.alias("reason"), F.to_json(first).alias("payload"))

    bad = F.filter(F.transform("newsinfo", judged), lambda j: j["reason"].isNotNull())
    entries = (
        _accepted(parsed)
        .select(F.explode_outer(bad).alias("j"))
        .filter("j is not null")
        .select(F.lit("feed entry").alias("stage"), "j.reason", "j.payload")
    )
    return bodies.unionByName(entries)
