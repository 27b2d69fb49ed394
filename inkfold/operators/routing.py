"""Where a message goes: to a collection, or to the rejects with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkfold.functions.dates import parse_log_date
from inkfold.operators.messages import LOG, RESULT

# Names of the two shared collections.
LOG_COLLECTION = "LogInfo"
MULTI_COLLECTION = "multiCompaniesTogether"


def route(decoded: DataFrame) -> DataFrame:
    """Add ``collection``, ``keywords``, ``date`` and ``reason`` (NULL when accepted).

    One projection, no shuffle; the branches are filters over its result.
    """
    is_log, is_result = F.col("kind") == LOG, F.col("kind") == RESULT
    pre, count = F.col("pre_info"), F.size("pre_info")
    first = F.get(pre, F.lit(0))
    has_null = F.exists(pre, lambda c: c.isNull())
    reason = (
        F.when(F.col("bad"), "bad json")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(LOG, RESULT), "unknown type")
        .when(~F.col("has_data"), "missing key data")
        .when(is_log & parse_log_date(F.col("log_date")).isNull(), "bad date")
        .when(is_log, F.lit(None))
        .when(pre.isNull(), "missing key preInfo")
        .when(count == 0, "no company")
        .when(has_null, "company is null")
        .when((count == 1) & (first == ""), "empty company")
    )
    collection = (
        F.when(is_log, LOG_COLLECTION).when(count > 1, MULTI_COLLECTION).otherwise(first)
    )
    return (
        decoded.withColumn("reason", reason)
        .withColumn("collection", F.when(F.col("reason").isNull(), collection))
        .withColumn(
            "keywords",
            F.when(F.col("reason").isNull() & is_result & (count > 1), F.array_join(pre, "_")),
        )
        .withColumn("date", F.when(is_log, parse_log_date(F.col("log_date"))))
    )


# Columns of the three branches, and the names of these in the store.
LOG_COLUMNS = ["date", "total", "list_type"]
ARTICLE_COLUMNS = ["collection", "pre_info", "keywords", "link", "title", "content", "post_info"]
REJECT_COLUMNS = ["stage", "reason", "payload"]
LOG_BRANCH, ARTICLE_BRANCH, REJECT_BRANCH = "log", "article", "reject"


def branches(routed: DataFrame) -> DataFrame:
    """All rows with their ``branch`` and the columns of every branch, for one write.

    The text of a message is only kept for rejects: the others have it in columns.
    """
    rejected = F.col("reason").isNotNull()
    branch = (
        F.when(rejected, REJECT_BRANCH)
        .when(F.col("kind") == LOG, LOG_BRANCH)
        .otherwise(ARTICLE_BRANCH)
    )
    kept = {"branch", "kind", "has_data", "bad", "log_date", "payload", "reason"}
    others = [c for c in routed.columns if c not in kept]
    return routed.select(
        branch.alias("branch"),
        *others,
        F.lit("").alias("post_info"),
        F.when(rejected, "route").alias("stage"),
        "reason",
        F.when(rejected, F.col("payload")).alias("payload"),
    )


def accepted_logs(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("reason").isNull() & (F.col("kind") == LOG)).select(*LOG_COLUMNS)


def accepted_articles(routed: DataFrame) -> DataFrame:
    return (
        routed.filter(F.col("reason").isNull() & (F.col("kind") == RESULT))
        .withColumn("post_info", F.lit(""))
        .select(*ARTICLE_COLUMNS)
    )


def message_rejects(routed: DataFrame) -> DataFrame:
    return (
        routed.filter(F.col("reason").isNotNull())
        .withColumn("stage", F.lit("route"))
        .select(*REJECT_COLUMNS)
    )


def route_results(results: DataFrame) -> DataFrame:
    """Route rows that never were messages: ``(url, title, content, pre_info)``.

    The one-plan way from pages to collections, without writing and reading JSON.
    """
    return route(
        results.select(
            F.lit(RESULT).alias("kind"),
            F.lit(True).alias("has_data"),
            F.lit(None).cast("string").alias("log_date"),
            F.lit(None).cast("bigint").alias("total"),
            F.lit(None).cast("string").alias("list_type"),
            F.col("url").alias("link"),
            "title",
            "content",
            "pre_info",
            F.col("url").alias("payload"),
            F.lit(False).alias("bad"),
        )
    )


# ---------------------------------------------------------------- required keys


def check_required(
    df: DataFrame, keys: list[str], empty_ok: tuple[str, ...] = ()
) -> DataFrame:
    """Keep the listed keys only; fill '' for keys that may be empty.

    Adds ``reason``: the first listed key whose value is missing, or NULL.  Empty
    strings and zeros count as present.
    """
    columns = [
        (F.coalesce(_column(df, k), F.lit("")) if k in empty_ok else _column(df, k)).alias(k)
        for k in keys
    ]
    missing = [
        F.when(F.col(k).isNull(), F.lit(f"missing key {k}")) for k in keys if k not in empty_ok
    ]
    kept = df.select(*columns)
    reason = F.coalesce(*missing) if missing else F.lit(None).cast("string")
    return kept.withColumn("reason", reason)


def _column(df: DataFrame, key: str) -> Column:
    return F.col(key) if key in df.columns else F.lit(None).cast("string")


def require(
    df: DataFrame, keys: list[str], empty_ok: tuple[str, ...] = (), stage: str = "required"
) -> tuple[DataFrame, DataFrame]:
    """The rows with all required keys, and the rejects of the others."""
    checked = check_required(df, keys, empty_ok)
    kept = checked.filter(F.col("reason").isNull()).drop("reason")
    rejects = checked.filter(F.col("reason").isNotNull()).select(
        F.lit(stage).alias("stage"), "reason", F.to_json(F.struct(*keys)).alias("payload")
    )
    return kept, rejects


def union_rejects(*parts: DataFrame) -> DataFrame:
    """All rejects in one side table ``(stage, reason, payload)``."""
    return reduce(DataFrame.unionByName, parts)
