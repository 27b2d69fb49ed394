"""Which companies a fetched page is about.

Shapes: ``jobs`` come from :func:`inkfold.operators.joblists.parse_jobs`; ``entries``
are rows ``(index, pos, url, pre_info, pairing)``, one per listed URL; pages or
articles carry the URL they were fetched from.  Rows of a URL list serve as entries
as they are, with ``job=("date", "part")``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from inkfold.operators.redirects import at_final_address


def list_entries(jobs: DataFrame) -> DataFrame:
    """One row per listed URL, duplicates included.

    ``pairing`` says how its companies are known: ``paired`` by position, ``single``
    (one company list for the whole job) or ``none``.  A message of several for one list
    says it itself; else the lengths of its two lists do.
    """
    n_pre, n_urls = F.size("pre_infos"), F.size("urls")
    pairing = F.coalesce(
        "pairing", F.when(n_pre == n_urls, "paired").when(n_pre == 1, "single").otherwise("none")
    )
    rows = (
        jobs.filter(~F.col("bad"))
        .withColumn("pairing", pairing)
        .select(
            "index", "start", "pairing", "pre_infos",
            F.posexplode_outer("urls").alias("at", "url"),
        )
        .filter("at is not null")
    )
    pre_info = F.when(F.col("pairing") == "paired", F.get("pre_infos", "at")).when(
        F.col("pairing") == "single", F.get("pre_infos", F.lit(0))
    )
    return rows.select(
        "index",
        (F.col("start") + F.col("at")).alias("pos"),
        "url",
        pre_info.alias("pre_info"),
        "pairing",
    )


def last_companies(entries: DataFrame, job: Sequence[str] = ("index",)) -> DataFrame:
    """The companies of each URL of a job: those at its last position.

    A plain aggregate: a URL listed very often is combined on the map side.
    """
    return entries.groupBy(*job, "url").agg(F.max_by("pre_info", "pos").alias("pre_info"))


def resolve_entries(entries: DataFrame, job: Sequence[str] = ("index",)) -> DataFrame:
    """Give every entry of a URL the companies of its last one; entries are all kept.

    The joined side has one row per key, so the join adds no rows, and a hot key
    leaves its entries in many shuffle blocks that AQE can split.
    """
    return entries.drop("pre_info").join(last_companies(entries, job), [*job, "url"])


def attach_companies(
    entries: DataFrame, pages: DataFrame, job: Sequence[str] = ("index",), url: str = "url",
    newest: str | None = None, redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per listed URL that was fetched, with the page's columns.

    With ``redirects`` (what :func:`inkfold.operators.redirects.follow_redirects` resolved)
    a page that answers under another address has the companies of the one asked for,
    which the column ``asked`` names.

    Hand over pages with their text already extracted: extraction is narrow, and
    the raw HTML then never enters a shuffle.  Where a URL may have several fetched
    copies, name the column whose largest value is the newest.
    """
    fetched = pages.withColumnRenamed(url, "url")
    if newest:
        fetched = newest_pages(fetched, newest)
    known = resolve_entries(entries, job)
    if redirects is not None:
        known = at_final_address(known, redirects)
    return known.join(fetched, "url")


def newest_pages(pages: DataFrame, by: str) -> DataFrame:
    """One page a URL: that with the largest ``by``; of equal ones the largest row.

    A plain aggregate, combined before the shuffle, whose partitioning the lookup uses again.
    """
    others = [c for c in pages.columns if c not in ("url", by)]
    best = F.max(F.struct(by, *others)).alias("page")
    return pages.groupBy("url").agg(best).select("url", "page.*")


#: Bits of one value of the filter, and how many such values it may have.
SHARD_BITS, MAX_SHARDS = 24, 64
#: Bits of the filter for each listed key, and places that a key marks.
BITS_PER_KEY, PLACES = 16, 4


@dataclass(frozen=True)
class FilterSize:
    """``shards`` values of ``words`` words of 64 bits."""

    shards: int
    words: int


def filter_size(keys: int, shard_bits: int = SHARD_BITS, max_shards: int = MAX_SHARDS) -> FilterSize:
    """Enough bits for so many keys, in values of bounded size; the filter ends at
    ``max_shards`` of them (128 MB), from where on more keys are let through."""
    bits = 1 << max(16, (max(1, keys) * BITS_PER_KEY - 1).bit_length())
    shards = min(max_shards, max(1, bits >> shard_bits))
    return FilterSize(shards, min(bits // shards, 1 << shard_bits) // 64)


def maybe_in(keys: DataFrame, rows: DataFrame, columns: Sequence[str], size: FilterSize | None = None) -> DataFrame:
    """Rows without most of those whose key no row of ``keys`` has, before any work on them.

    A key marks ``PLACES`` bits of one word, in a table sized by the number of distinct keys
    (counted here, if ``size`` does not say it).  About one in 250 other rows is let through;
    an exact lookup has to follow.  The table is a few values of bounded size, so rows are
    tested where they are read and not shuffled.  A null key is in no list.
    """
    if size is None:
        size = filter_size(keys.agg(F.approx_count_distinct(F.xxhash64(*columns))).first()[0])
    where, which = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
    shard = F.pmod(where, F.lit(size.shards)).cast("int")
    word = F.pmod(F.call_function("shiftrightunsigned", where, F.lit(8)), F.lit(size.words)).cast("int")
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.call_function("shiftrightunsigned", which, F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int")) for k in range(PLACES)]
    mask = reduce(Column.bitwiseOR, bits)
    known = keys.dropna(subset=list(columns))
    held = known.select(shard.alias("shard"), word.alias("word"), mask.alias("mask")).groupBy("shard", "word").agg(F.bit_or("mask").alias("mask"))
    every = keys.sparkSession.range(size.shards * size.words).select(
        (F.col("id") / size.words).cast("int").alias("shard"), F.pmod("id", F.lit(size.words)).cast("int").alias("word"))
    dense = every.join(held, ["shard", "word"], "left")

    def value(k: int) -> Column:
        own = dense.filter(F.col("shard") == k)
        marks = F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))))
        return own.agg(marks.alias("t")).select(F.col("t.mask")).scalar()

    found = F.get(value(0), word)
    for k in range(1, size.shards):
        found = F.when(shard == k, F.get(value(k), word)).otherwise(found)
    no_null = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    # The mask is settled before the test: it stands on both sides of it.
    tested = rows.select("*", F.inline(F.array(F.struct(found.alias("__found"), mask.alias("__mask")))))
    return tested.filter(no_null & (F.col("__found").bitwiseAND(F.col("__mask")) == F.col("__mask"))).drop("__found", "__mask")


def maybe_listed(entries: DataFrame, pages: DataFrame, url: str = "url", size: FilterSize | None = None) -> DataFrame:
    """Pages without most of those that no list names; the exact lookup follows."""
    return maybe_in(entries.select(F.col("url").alias(url)), pages, [url], size)


def maybe_newest(pages: DataFrame, newest: str, url: str = "url") -> DataFrame:
    """Pages without most copies that are not the newest of their URL.

    Only URL and ``newest`` are shuffled to find the newest copies; HTML is not.
    """
    best = pages.groupBy(url).agg(F.max(newest).alias(newest))
    return maybe_in(best, pages, [url, newest])


def unfetched_entries(entries: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Listed entries whose URL no page has; only URLs are read."""
    there = pages.select(F.col(url).alias("url")).distinct()
    return entries.join(there, "url", "left_anti").select(
        F.lit("enrich").alias("stage"), F.lit("listed url has no page").alias("reason"), F.col("url").alias("payload")
    )


def unlisted_pages(entries: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose own URL is in no list, for example after a redirect.

    Only the URL column of the pages is read.
    """
    listed = entries.select("url").distinct()
    return (
        pages.select(F.col(url).alias("url"))
        .join(listed, "url", "left_anti")
        .select(
            F.lit("enrich").alias("stage"),
            F.lit("page url not in any list").alias("reason"),
            F.col("url").alias("payload"),
        )
    )
