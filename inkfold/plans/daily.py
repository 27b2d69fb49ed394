"""The two jobs end to end: collecting a day's news, and finding the next days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from inkfold.operators import coverage, enrich, routing
from inkfold.operators.extract import extract_articles
from inkfold.operators.messages import log_messages, result_messages
from inkfold.operators.redirects import follow_redirects
from inkfold.sources import feeds as S


Land = Callable[[DataFrame], DataFrame] | None


class DailyNews(NamedTuple):
    routed: DataFrame
    log: DataFrame
    rejects: DataFrame


def _articles(lists: DataFrame, pages: DataFrame, newest: str | None) -> DataFrame:
    """Articles of listed pages, and of their copies the newest: others are left before
    their text is extracted."""
    columns = ["url", "html", *([newest] if newest else [])]
    listed = enrich.maybe_listed(lists, pages.select(*columns))
    return extract_articles(enrich.maybe_newest(listed, newest) if newest else listed)


def collect_news(
    feeds: DataFrame, pages: DataFrame, newest: str | None = None, land: Land = None, redirects: DataFrame | None = None
) -> DailyNews:
    """Listings ``(date, part, body)`` and pages ``(url, html, ..)`` to routed articles.

    Text is extracted where a page is read, of listed pages only; text and URLs are
    shuffled, once, for the lookup of companies.  ``newest`` names the column of pages that
    tells the newest copy of a URL.  ``land`` writes the parsed listings and reads them
    back, so that log, lists and rejects do not parse them again.  ``redirects`` are rows
    ``(asked, target)``: a page they lead to has the companies of the address asked for.
    """
    parsed = S.parse_feeds(feeds)
    parsed = land(parsed) if land else parsed
    lists = S.flatten_feeds(parsed)
    followed = follow_redirects(redirects) if redirects is not None else None
    resolved = followed.resolved if followed else None
    final = enrich.at_final_address(lists, resolved) if followed else lists
    results = enrich.attach_companies(lists, _articles(final, pages, newest), job=S.LIST_KEY, newest=newest, redirects=resolved)
    # What is rejected depends on URLs and companies only, so no page text is read for it.
    no_text = F.lit(None).cast("string")
    bare = pages.select("url").distinct().select("url", no_text.alias("title"), no_text.alias("content"))
    refused = routing.route_results(enrich.attach_companies(lists, bare, job=S.LIST_KEY, redirects=resolved))
    rejects = routing.union_rejects(
        S.feed_rejects(parsed),
        enrich.unlisted_pages(final, pages),
        enrich.unfetched_entries(final, pages),
        routing.message_rejects(refused),
        *([followed.rejects] if followed else []),
    )
    return DailyNews(routing.route_results(results), S.daily_log(parsed), rejects)


def collected_messages(feeds: DataFrame, pages: DataFrame, newest: str | None = None, land: Land = None) -> DataFrame:
    """The same work as messages for the queue, to be drained by the stream."""
    parsed = S.parse_feeds(feeds)
    parsed = land(parsed) if land else parsed
    lists = S.flatten_feeds(parsed)
    results = enrich.attach_companies(lists, _articles(lists, pages, newest), job=S.LIST_KEY, newest=newest)
    logs = S.daily_log(parsed).select(
        F.date_format("date", "yyyy-MM-dd").alias("log_date"), "total"
    )
    return log_messages(logs).unionByName(result_messages(results))


def addresses_to_fetch(log: DataFrame, today: dt.date, floor: dt.date = coverage.FLOOR) -> DataFrame:
    """Stored log to the dates to collect next and the addresses of their listings."""
    days = coverage.date_walk(coverage.next_dates(log, today, floor))
    return S.source_addresses(days)
