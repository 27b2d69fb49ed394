"""Feeds, lists and messages derived from the given tables.

The reference data of this kind of job are live listings.  Here they are made from
``pages`` (what was published), ``supplier`` (company names) and ``events`` (which
days exist).  Everything grows with these tables, and every page takes part.

Rules (the SQL used to check the queries follows the same ones):

* a page belongs to day ``2024-01-01 + page_id % 28``; each part of a day lists at
  most 4 pages, so a listing stays small however many pages there are;
* its company is the ``page_id % n``-th supplier, every third page has the next one too;
* the listing names a page without its ``utm_source`` parameter, so such pages answer
  under another address than the listed one;
* pages whose address ends in ``#top`` are listed once more, late, for the next company;
* every seventh day has a stray backslash in some company names; three days have
  unreadable listings, one of them with readable late ones, two have unusable entries; days
  without pages have no news.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkfold.functions.json_text import to_json_text
from inkfold.operators.extract import extract_articles
from inkfold.operators.messages import LOG, RESULT
from inkfold.sources.feeds import LIST_KEY
from inkfold.sources.tables import table

DAYS = 28
#: Small, so that a day has several parts at every size of the tables.
PAGES_PER_PART = 4
#: A day whose listings close the brackets around them.
BREAK_OUT_DAY = 12
#: A day of unreadable first and readable late listings.
LATE_ONLY_DAY = 14
HEAD = "jsonpCallback( "
TAIL = " );\r\n"


def page_companies(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, date, day_no, part, listed, stockname, next_name)``."""
    names = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    n = names.agg(F.count("*")).scalar()
    pages = (
        table(spark, folder, "pages")
        .select("page_id", "url")
        .withColumn("first_key", F.col("page_id") % n)
        .withColumn("next_key", (F.col("page_id") + 1) % n)
    )
    first = names.select(F.col("s_suppkey").alias("first_key"), F.col("s_name").alias("first_name"))
    following = names.select(F.col("s_suppkey").alias("next_key"), F.col("s_name").alias("next_name"))
    day_no = (F.col("page_id") % DAYS).cast("int")
    return (
        pages.join(first, "first_key")
        .join(following, "next_key")
        .select(
            "page_id",
            "url",
            F.date_add(F.lit("2024-01-01").cast("date"), day_no).alias("date"),
            day_no.alias("day_no"),
            F.floor(F.col("page_id") / (DAYS * PAGES_PER_PART)).cast("int").alias("part"),
            F.regexp_replace("url", "[?&]utm_source=[^#]*", "").alias("listed"),
            F.when(F.col("page_id") % 3 == 0, F.concat_ws(",", "first_name", "next_name"))
            .otherwise(F.col("first_name"))
            .alias("stockname"),
            "next_name",
        )
    )


def feeds_of(listed: DataFrame) -> DataFrame:
    """``(date, part, body)`` from ``(page_id, date, day_no, part, listed, stockname)``."""
    day = F.col("day_no")
    stray = F.when((day % 7 == 0) & (F.col("page_id") % 5 == 0), "\\d").otherwise("")
    address = F.replace(F.col("listed"), F.lit("/"), F.lit("\\/"))
    entry = F.concat(
        F.lit('[{"infourl":"'), address, F.lit('","stockname":"'), stray, F.col("stockname"),
        F.lit('"}]'),
        F.when(day == 20, ",[]").when(day == 21, ',[{"infourl":"nameless"}]').otherwise(""),
    )
    news = F.array_join(F.transform(F.sort_array("entries"), lambda e: e["entry"]), ",")
    json = (
        F.when(day == 10, F.concat(F.lit('{"news":['), news, F.lit("]}")))
        .when(day == BREAK_OUT_DAY, F.concat(F.lit('{"newsinfo":['), news, F.lit(']}],"x":[{"newsinfo":['), news, F.lit("]}")))
        .when(day == 14, F.concat(F.lit('{"newsinfo":['), news, F.lit("]")))
        .otherwise(F.concat(F.lit('{"newsinfo":['), news, F.lit("]}")))
    )
    return (
        listed.withColumn("entry", entry)
        .groupBy("date", "part", "day_no")
        .agg(F.collect_list(F.struct("page_id", "entry")).alias("entries"))
        .select(*LIST_KEY, _framed(json).alias("body"))
    )


def _framed(json: Column) -> Column:
    return F.concat(F.lit(HEAD), json, F.lit(TAIL)).cast("binary")


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """The daily listings, with an empty one for days without pages."""
    listed = feeds_of(page_companies(spark, folder))
    days = table(spark, folder, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    quiet = days.join(listed.select("date").distinct(), "date", "left_anti").select(
        "date", F.lit(0).alias("part"), _framed(F.lit('{"newsinfo":[]}')).alias("body")
    )
    return listed.unionByName(quiet)


def late_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Second listings, for pages that are listed twice; also for a day whose first listing
    is unreadable."""
    twice = page_companies(spark, folder).filter(F.col("url").endswith("#top"))
    late = feeds_of(twice.filter(F.col("day_no") != LATE_ONLY_DAY).withColumn("stockname", F.col("next_name")))
    # As if it were another day, the listing is whole.
    whole = twice.filter(F.col("day_no") == LATE_ONLY_DAY).withColumn("day_no", F.lit(1))
    return late.unionByName(feeds_of(whole.withColumn("stockname", F.col("next_name"))))


def page_copies(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url)`` of the pages; every third one has two older copies."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    older = pages.filter(F.col("page_id") % 3 == 0).select(
        F.explode(F.array(-F.col("page_id") - 1, -F.col("page_id") - 2)).alias("page_id"), "url"
    )
    return pages.unionByName(older)


def redirects(spark: SparkSession, folder: str) -> DataFrame:
    """``(asked, target)``: pages that answer under another address than the listed one are
    reached in 1 to 3 hops; some lead back to where they began, and some name two targets."""
    moved = page_companies(spark, folder).filter(F.col("url") != F.col("listed"))
    hops = (F.col("page_id") % 3 + 1).cast("int")
    end = F.when(F.col("page_id") % 11 == 0, F.col("listed")).otherwise(F.col("url"))

    def stop(k: Column) -> Column:
        return F.when(k == 0, F.col("listed")).when(k == hops, end).otherwise(F.concat("listed", F.lit("#hop"), k.cast("string")))

    steps = F.transform(F.sequence(F.lit(0), hops - 1), lambda k: F.struct(stop(k).alias("asked"), stop(k + 1).alias("target")))
    rows = moved.select("page_id", "url", F.explode(steps).alias("step")).select("page_id", "step.*")
    # An older answer, which sorts before the one that counts.
    return rows.select("asked", "target").unionByName(rows.filter(F.col("page_id") % 2 == 0).select("asked", F.lit("!").alias("target")))


def framed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, html)``: the given pages with text of other kinds behind the article."""
    after = (
        "</article><p>Comments (3)</p><p>One reader writes that this is all very well but that it could have been said in fewer words, and then "
        "goes on for quite a while about it.</p><p>Related articles</p><ul><li><a href='/x'>Another one</a></li></ul>"
    )
    pages = table(spark, folder, "pages").select("page_id", "html")
    return pages.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(after)))


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, html)``: the given pages with heading and text in the places of the
    collected site, one inside another element of its kind, and sections in sections."""
    pages = table(spark, folder, "pages").select("page_id", "html")
    html = F.replace(F.col("html"), F.lit("<h1>"), F.lit('<div class="titmain"><div><section>a<section>b</section>c</section><h1>'))
    html = F.replace(html, F.lit("</h1>"), F.lit("</h1></div></div>"))
    html = F.replace(html, F.lit("<article>"), F.lit('<article><div class="texttit_m1">'))
    return pages.withColumn("html", F.replace(html, F.lit("</article>"), F.lit("</div></article>")))


def page_articles(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, title, content)`` of all pages."""
    return extract_articles(table(spark, folder, "pages").select("page_id", "url", "html"))


def result_message_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One message per page; by ``page_id % 16`` some are of an old or a broken form."""
    rows = page_articles(spark, folder).join(
        page_companies(spark, folder).select("page_id", "stockname"), "page_id"
    )
    data = F.struct(F.col("url").alias("link"), "title", "content")
    pre_info = F.split("stockname", ",")

    def message(content: Column, kind: str = RESULT) -> Column:
        return to_json_text(F.struct(F.lit(kind).alias("type"), content.alias("content")))

    def with_companies(companies: Column, item: Column = data) -> Column:
        return F.struct(item.alias("data"), companies.alias("preInfo"))

    legacy = F.struct(
        F.col("url").alias("link"),
        F.array("title").alias("title"),
        F.split("content", "\n").alias("content"),
        pre_info.alias("preInfo"),
    )
    whole = message(with_companies(pre_info))
    no_companies = F.lit(None).cast("array<string>")
    variant = F.col("page_id") % 16
    value = (
        F.when(variant == 0, message(with_companies(no_companies)))
        .when(variant == 1, message(with_companies(pre_info), "heartbeat"))
        .when(variant == 2, F.substr(whole, F.lit(1), F.length(whole) - 2))
        .when(variant == 3, message(with_companies(pre_info, F.struct("title", "content"))))
        .when(variant == 4, message(with_companies(F.array().cast("array<string>"))))
        .when(variant == 5, message(legacy))
        .when(variant == 6, message(with_companies(F.array(F.lit("")))))
        .when(variant == 7, message(F.struct(pre_info.alias("preInfo"))))
        .when(variant == 8, F.concat(whole, F.lit('],"end":true,"w":['), whole))
        .when(variant == 9, F.concat(whole, F.lit('],"x":['), whole))
        .otherwise(whole)
    )
    return rows.select(value.alias("value"))


def log_message_texts(logs: DataFrame) -> DataFrame:
    """One message per log ``(date, part, total)``; some dates are unpadded or wrong."""
    day_no = F.date_diff("date", F.lit("2024-01-01").cast("date"))
    text = (
        F.when(day_no == 27, "2020-13-40")
        .when(day_no % 5 == 1, F.date_format("date", "y-M-d"))
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
    )
    log = F.struct(text.alias("Date"), F.col("total").alias("Total"))
    nested = F.struct(F.lit(LOG).alias("type"), F.struct(log.alias("data")).alias("content"))
    flat = F.struct(F.lit(LOG).alias("type"), log.alias("content"))
    return logs.select(
        F.when(day_no == 3, to_json_text(flat)).otherwise(to_json_text(nested)).alias("value")
    )
