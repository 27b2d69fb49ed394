"""Typed messages between the page jobs and the store.

``{"type": "logInfo", "content": {"data": {Date, Total}}}`` and
``{"type": "crawlerResult", "content": {"data": {link, title, content}, "preInfo": [..]}}``;
an older producer put the log or the item flat into ``content``, with title and
content as lists of text nodes.  One schema reads both forms in a single parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from inkfold.functions.json_text import is_object, parse_object, the_object, to_json_text
from inkfold.functions.once import compute_once

LOG, RESULT = "logInfo", "crawlerResult"

_TEXTS = T.ArrayType(T.StringType())
DATA = (
    T.StructType()
    .add("Date", "string").add("Total", "long").add("type", "string")
    .add("link", "string").add("title", "string").add("content", "string")
)
CONTENT = (
    T.StructType()
    .add("data", DATA)
    .add("preInfo", _TEXTS)
    # The flat form of the older producer.
    .add("Date", "string").add("Total", "long")
    .add("link", "string").add("title", _TEXTS).add("content", _TEXTS)
)
ENVELOPE = T.StructType().add("type", "string").add("content", CONTENT)


def log_messages(logs: DataFrame) -> DataFrame:
    """``(log_date, total[, list_type])`` to one message each."""
    plain = F.struct(F.col("log_date").alias("Date"), F.col("total").alias("Total"))
    if "list_type" in logs.columns:
        typed = F.struct(
            F.col("log_date").alias("Date"), F.col("total").alias("Total"),
            F.col("list_type").alias("type"),
        )
        text = F.when(F.col("list_type").isNull(), _log_json(plain)).otherwise(_log_json(typed))
    else:
        text = _log_json(plain)
    return logs.select(text.alias("value"))


def _log_json(data):
    return to_json_text(
        F.struct(F.lit(LOG).alias("type"), F.struct(data.alias("data")).alias("content"))
    )


def result_messages(results: DataFrame) -> DataFrame:
    """``(url, title, content, pre_info)`` to one message each."""
    data = F.struct(F.col("url").alias("link"), "title", "content")
    content = F.struct(data.alias("data"), F.col("pre_info").alias("preInfo"))
    return results.select(
        to_json_text(F.struct(F.lit(RESULT).alias("type"), content.alias("content"))).alias("value")
    )


def legacy_log_messages(logs: DataFrame) -> DataFrame:
    content = F.struct(F.col("log_date").alias("Date"), F.col("total").alias("Total"))
    return logs.select(
        to_json_text(F.struct(F.lit(LOG).alias("type"), content.alias("content"))).alias("value")
    )


def legacy_result_messages(results: DataFrame) -> DataFrame:
    """As :func:`result_messages`, for title and content as lists of text nodes."""
    content = F.struct(
        F.col("url").alias("link"), "title", "content", F.col("pre_info").alias("preInfo")
    )
    return results.select(
        to_json_text(F.struct(F.lit(RESULT).alias("type"), content.alias("content"))).alias("value")
    )


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Message texts to ``(kind, has_data, log_date, total, list_type, link, title,
    content, pre_info, payload, bad)`` plus the other columns of the input."""
    others = [c for c in messages.columns if c != value]
    parsed = messages.select(
        *others, F.col(value).alias("payload"),
        parse_object(F.col(value), ENVELOPE).alias("_p"),
    )
    opened = compute_once(parsed, "_p").select(
        *others,
        "payload",
        (~is_object(F.col("_p"))).alias("bad"),
        F.when(is_object(F.col("_p")), the_object(F.col("_p"))).alias("m"),
    )
    body, data = F.col("m.content"), F.col("m.content.data")
    flat = (
        body["Date"].isNotNull() | body["Total"].isNotNull() | body["link"].isNotNull()
        | body["title"].isNotNull() | body["content"].isNotNull()
    )
    return opened.select(
        *others,
        F.when(~F.col("bad"), F.col("m.type")).alias("kind"),
        F.coalesce(data.isNotNull() | flat, F.lit(False)).alias("has_data"),
        F.coalesce(data["Date"], body["Date"]).alias("log_date"),
        F.coalesce(data["Total"], body["Total"]).alias("total"),
        data["type"].alias("list_type"),
        F.coalesce(data["link"], body["link"]).alias("link"),
        F.coalesce(data["title"], F.array_join(body["title"], "")).alias("title"),
        F.coalesce(data["content"], F.array_join(body["content"], "")).alias("content"),
        body["preInfo"].alias("pre_info"),
        "payload",
        "bad",
    )
