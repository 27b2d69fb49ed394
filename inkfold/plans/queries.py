"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkfold.operators import (
    article, coverage, enrich, extract, folded, joblists, joining, messages, redirects, results, routing, store,
)
from inkfold.plans import daily
from inkfold.session import shared_dir
from inkfold.sources import derived, feeds as S
from inkfold.sources.tables import table
from inkfold.streaming import drain as D

TODAY = dt.date(2024, 2, 5)
#: What the queries spent on writing derived inputs and tables they read again.
LANDING_SECONDS: list[float] = []
LATE_FLOOR = dt.date(2024, 1, 1)



def _joined(name: str) -> Column:
    """Arrays are shown as one text."""
    return F.array_join(name, "|").alias(name)


def _events(spark, folder):
    return table(spark, folder, "events").select(F.col("ts").cast("date").alias("date"))


def _orders(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date"))


def _landed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Write rows as a table and read it back: what follows reads them several times."""
    start = time.perf_counter()
    path = shared_dir(spark, name)
    rows.write.parquet(path)
    LANDING_SECONDS.append(time.perf_counter() - start)
    return spark.read.schema(rows.schema).parquet(path)


def _feeds(spark, folder):
    """Listings as they land from fetching."""
    return _landed(spark, derived.feeds(spark, folder), "feeds")


def _parsed(spark, folder):
    """Listings, parsed once for all that is made of them."""
    return _landed(spark, S.parse_feeds(derived.feeds(spark, folder)), "parsed")


def _lists(spark, folder):
    return S.flatten_feeds(_parsed(spark, folder))


def _late_lists(spark, folder):
    late = _landed(spark, derived.late_feeds(spark, folder), "late-feeds")
    return S.flatten_feeds(S.parse_feeds(late))


def _all_lists(spark, folder):
    return joblists.append_lists(_lists(spark, folder), _late_lists(spark, folder))


def _sent_jobs(spark, folder, max_urls: int = joblists.MAX_URLS) -> DataFrame:
    """Job messages as they stand on the job queue."""
    parsed = _parsed(spark, folder)
    lists = joblists.append_lists(S.flatten_feeds(parsed), _late_lists(spark, folder))
    numbered = joblists.number_jobs(S.daily_log(parsed))
    return _landed(spark, joblists.job_messages(numbered, lists, max_urls), "jobs")


def _jobs(spark, folder):
    return joblists.parse_jobs(_sent_jobs(spark, folder))


def _messages(spark, folder, parsed=None):
    logs = derived.log_message_texts(S.daily_log(_parsed(spark, folder) if parsed is None else parsed))
    return logs.unionByName(derived.result_message_texts(spark, folder))


def _routed(spark, folder, parsed=None):
    return routing.route(messages.decode_messages(_messages(spark, folder, parsed)))


# ---------------------------------------------------------------- coverage


def coverage_events(spark, folder):
    return coverage.coverage(_events(spark, folder))


def coverage_orders(spark, folder):
    return coverage.coverage(_orders(spark, folder))


def next_dates(spark, folder):
    return coverage.next_dates(_events(spark, folder), TODAY)


def next_dates_gap(spark, folder):
    return coverage.next_dates(_orders(spark, folder), TODAY)


def next_dates_forward(spark, folder):
    return coverage.next_dates(_events(spark, folder), TODAY, LATE_FLOOR)


def next_dates_no_log(spark, folder):
    # Log rows of events without a date: there are none.
    return coverage.next_dates(_events(spark, folder).filter("date is null"), TODAY)


def date_walk(spark, folder):
    return coverage.date_walk(coverage.coverage(_orders(spark, folder)), "min_date", "max_date")


def missing_dates(spark, folder):
    return coverage.missing_dates(_orders(spark, folder))


def source_addresses(spark, folder):
    return daily.addresses_to_fetch(_events(spark, folder), TODAY)


# ---------------------------------------------------------------- feeds and lists


def feed_unwrap_parse(spark, folder):
    return _parsed(spark, folder).select(
        "date", "part", "status", F.size("newsinfo").cast("bigint").alias("entries"), "payload"
    )


def feed_flatten(spark, folder):
    return _lists(spark, folder).withColumn("pre_info", _joined("pre_info"))


def daily_log(spark, folder):
    return S.daily_log(_parsed(spark, folder))


def feed_rejects(spark, folder):
    return S.feed_rejects(_parsed(spark, folder)).select("stage", "reason")


def joblist_append(spark, folder):
    return _all_lists(spark, folder).withColumn("pre_info", _joined("pre_info"))


def joblist_replace(spark, folder):
    lists = joblists.replace_lists(_lists(spark, folder), _late_lists(spark, folder))
    return lists.withColumn("pre_info", _joined("pre_info"))


def joblist_clear(spark, folder):
    lists = joblists.clear_lists(_lists(spark, folder), _late_lists(spark, folder))
    return lists.withColumn("pre_info", _joined("pre_info"))


def joblist_slice(spark, folder):
    lists = joblists.slice_lists(_lists(spark, folder), 0, 2)
    return lists.withColumn("pre_info", _joined("pre_info"))


def joblist_slice_from_end(spark, folder):
    lists = joblists.slice_lists(_lists(spark, folder), -3, -1)
    return lists.withColumn("pre_info", _joined("pre_info"))


def joblist_count(spark, folder):
    return joblists.list_counts(_all_lists(spark, folder))


def job_numbers(spark, folder):
    return joblists.number_jobs(S.daily_log(_parsed(spark, folder)))


def job_messages(spark, folder):
    """Messages of at most 5 URLs, decoded again."""
    return joblists.parse_jobs(_sent_jobs(spark, folder, max_urls=5)).select(
        "index", "start", "log_date", "total",
        F.array_join("urls", "|").alias("urls"),
        F.array_join(F.transform("pre_infos", lambda p: F.array_join(p, "+")), "|").alias("pre_infos"),
    )


def sublist_messages(spark, folder):
    """The first three URLs of every list, sent as a sub list and decoded again."""
    parsed = _parsed(spark, folder)
    numbered = joblists.number_jobs(S.daily_log(parsed))
    lists = joblists.slice_lists(S.flatten_feeds(parsed), 0, 3)
    sent = _landed(spark, joblists.job_messages(numbered, lists, 2), "sublists")
    return joblists.parse_jobs(sent).select(
        "index", "start", "log_date", "total", "list_type", F.array_join("urls", "|").alias("urls")
    )


# ---------------------------------------------------------------- companies of pages


def _page_ids(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url")


def url_companies(spark, folder):
    entries = enrich.list_entries(_jobs(spark, folder))
    return enrich.attach_companies(entries, _page_ids(spark, folder)).select(
        "index", "pos", "page_id", "url", "pairing", _joined("pre_info")
    )


def url_companies_split(spark, folder):
    """The same from messages of five URLs that travelled as text alone."""
    path = shared_dir(spark, "job-texts")
    _sent_jobs(spark, folder, max_urls=5).select("message").write.text(path)
    jobs = joblists.parse_jobs(spark.read.text(path).withColumnRenamed("value", "message"))
    return enrich.attach_companies(enrich.list_entries(jobs), _page_ids(spark, folder)).select(
        "index", "pos", "page_id", "url", "pairing", _joined("pre_info")
    )


def url_companies_copies(spark, folder):
    """Pages with older copies: the newest one of a URL counts."""
    entries = enrich.list_entries(_jobs(spark, folder))
    pages = derived.page_copies(spark, folder)
    return enrich.attach_companies(entries, pages, newest="page_id").select(
        "index", "pos", "page_id", "url", "pairing", _joined("pre_info")
    )


def _unpaired(spark, folder):
    """Jobs of a producer that does not say how companies are paired."""
    return _jobs(spark, folder).withColumn("pairing", F.lit(None).cast("string"))


def url_companies_single(spark, folder):
    """Jobs that name companies once for the whole list."""
    jobs = _unpaired(spark, folder).withColumn("pre_infos", F.slice("pre_infos", 1, 1))
    return enrich.attach_companies(enrich.list_entries(jobs), _page_ids(spark, folder)).select(
        "index", "pos", "page_id", "pairing", _joined("pre_info")
    )


def url_no_companies(spark, folder):
    """Jobs whose two lists do not fit together."""
    jobs = _unpaired(spark, folder).withColumn("pre_infos", F.slice("pre_infos", 1, 2))
    return enrich.attach_companies(enrich.list_entries(jobs), _page_ids(spark, folder)).select(
        "index", "pos", "page_id", "pairing", _joined("pre_info")
    )


def url_unmatched(spark, folder):
    entries = enrich.list_entries(_jobs(spark, folder))
    return enrich.unlisted_pages(entries, table(spark, folder, "pages"))


def _followed(spark, folder):
    return redirects.follow_redirects(derived.redirects(spark, folder))


def url_redirected(spark, folder):
    """Pages that answer under other addresses take the companies of the one asked for."""
    entries = enrich.list_entries(_jobs(spark, folder))
    found = enrich.attach_companies(entries, _page_ids(spark, folder), redirects=_followed(spark, folder).resolved)
    return found.select("index", "pos", "page_id", "asked", "url", _joined("pre_info"))


def redirect_hops(spark, folder):
    """How far each redirected address leads."""
    return _followed(spark, folder).resolved


def redirect_rejects(spark, folder):
    """Loops, pages that no list leads to, and listed addresses that lead to no page."""
    entries = enrich.list_entries(_jobs(spark, folder))
    followed = _followed(spark, folder)
    final = enrich.at_final_address(entries, followed.resolved)
    pages = table(spark, folder, "pages")
    parts = (followed.rejects, enrich.unlisted_pages(final, pages), enrich.unfetched_entries(final, pages))
    return routing.union_rejects(*parts).groupBy("stage", "reason").agg(F.count("*").alias("n"))


def listed_filter(spark, folder):
    """Pages that the filter sized by the lists lets through and that are listed."""
    lists = _lists(spark, folder)
    pages = enrich.maybe_listed(lists, _page_ids(spark, folder))
    return pages.join(lists.select("url").distinct(), "url", "left_semi").select("page_id", "url")


# ---------------------------------------------------------------- extraction


def article_main(spark, folder):
    """The article of each page: without heading, footer and what follows the text."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return article.main_articles(pages).select("page_id", "title", "content")


def article_main_layouts(spark, folder):
    """The same of pages with comments, related links and a second heading behind the text."""
    return article.main_articles(derived.framed_pages(spark, folder)).select("page_id", "title", "content")


def text_blocks(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    return extract.text_blocks(pages).select(
        "page_id", "is_content", "text",
        *[F.col(c).cast("bigint").alias(c) for c in ("pos", "words", "link_words")],
    )


def article_content(spark, folder):
    return extract.page_items(derived.page_articles(spark, folder))


def selector_extract(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    found = extract.select_articles(
        pages, title=("article", None, "h1"), content=("article", None, "p")
    )
    return found.select("page_id", _joined("title"), _joined("content"))


def selector_places(spark, folder):
    """The places of the collected site, in pages that have them."""
    pages = derived.site_pages(spark, folder)
    return extract.select_articles(pages).select("page_id", _joined("title"), _joined("content"))


def selector_blocks(spark, folder):
    """Inner elements that hold others of their kind."""
    pages = derived.site_pages(spark, folder).select(
        "page_id", extract.select_texts(F.col("html"), "article", "section").alias("texts")
    )
    return pages.select("page_id", _joined("texts"))


def selector_links(spark, folder):
    """The link texts of the navigation."""
    markup = table(spark, folder, "pages").select("page_id", "html")
    links = extract.select_texts(F.col("html"), "nav", "a")
    return markup.select("page_id", F.array_join(links, "|").alias("links"))


# ---------------------------------------------------------------- messages and routing


def messages_decoded(spark, folder):
    return messages.decode_messages(_messages(spark, folder)).select(
        "kind", "has_data", "log_date", "total", "link", "title", "content",
        _joined("pre_info"), "bad",
    )


def messages_encoded(spark, folder):
    """The messages of the daily job, read back."""
    landed = lambda parsed: _landed(spark, parsed, "parsed")
    sent = daily.collected_messages(derived.feeds(spark, folder), table(spark, folder, "pages"), land=landed)
    return messages.decode_messages(sent).select(
        "kind", "log_date", "total", "link", "title", "content", _joined("pre_info")
    )


def legacy_normalised(spark, folder):
    """All results in the old form, read as new ones."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    nodes = extract.select_articles(
        pages, title=("article", None, "h1"), content=("article", None, "p")
    )
    named = nodes.join(derived.page_companies(spark, folder).select("page_id", "stockname"), "page_id")
    sent = messages.legacy_result_messages(named.withColumn("pre_info", F.split("stockname", ",")))
    logs = S.daily_log(_parsed(spark, folder)).select(
        F.date_format("date", "yyyy-MM-dd").alias("log_date"), "total"
    )
    return messages.decode_messages(sent.unionByName(messages.legacy_log_messages(logs))).select(
        "kind", "log_date", "total", "link", "title", "content", _joined("pre_info")
    )


def routed(spark, folder):
    return routing.accepted_articles(_routed(spark, folder)).withColumn("pre_info", _joined("pre_info"))


def route_counts(spark, folder):
    return (
        _routed(spark, folder)
        .filter("reason is null")
        .groupBy("collection")
        .agg(F.count("*").alias("n"))
    )


def keywords(spark, folder):
    return (
        routing.accepted_articles(_routed(spark, folder))
        .groupBy("keywords")
        .agg(F.count("*").alias("n"))
    )


def log_dates(spark, folder):
    return routing.accepted_logs(_routed(spark, folder)).select("date", "total")


def rejects(spark, folder):
    parsed = _parsed(spark, folder)
    parts = (
        S.feed_rejects(parsed),
        enrich.unlisted_pages(S.flatten_feeds(parsed), table(spark, folder, "pages")),
        routing.message_rejects(_routed(spark, folder, parsed)),
        joblists.unlogged_lists(S.daily_log(parsed), _late_lists(spark, folder)),
    )
    return routing.union_rejects(*parts).groupBy("stage", "reason").agg(F.count("*").alias("n"))


def required_gate(spark, folder):
    """Items of result messages, checked for their keys; post_info may be empty."""
    items = messages.decode_messages(_messages(spark, folder)).filter("kind = 'crawlerResult'")
    checked = routing.check_required(
        items, ["pre_info", "link", "title", "content", "post_info"], ("post_info",)
    )
    return checked.select("link", "title", "post_info", "reason")


# ---------------------------------------------------------------- store and stream


def store_roundtrip(spark, folder):
    path = shared_dir(spark, "articles")
    begin = spark.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0]
    store.append_articles(routing.accepted_articles(_routed(spark, folder)), path)
    stamped = F.coalesce(F.col("ingested_at") >= F.lit(begin), F.lit(False))
    return store.stored(spark, path).groupBy("collection").agg(
        F.count("*").alias("n"), F.bool_and(stamped).alias("stamped")
    )


def collection_exists(spark, folder):
    """Which suppliers have a collection in the store."""
    path = shared_dir(spark, "articles")
    store.append_articles(routing.accepted_articles(_routed(spark, folder)), path)
    names = table(spark, folder, "supplier").select(F.col("s_name").alias("collection"))
    return store.mark_existing(names, store.collection_index(spark, path))


def collection_rows(spark, folder):
    """How many articles each collection has, from the index; half of it was lost and made again."""
    path = shared_dir(spark, "articles")
    articles = routing.accepted_articles(_routed(spark, folder))
    store.append_articles(articles, path)
    # A job that died before it wrote its index.
    store.append_articles(articles, f"{path}-other")
    lost = store.stored(spark, f"{path}-other").drop("ingested_at", "run", "batch_id")
    lost.write.partitionBy("branch", "bucket").parquet(f"{path}/{store.STORED}/run=died/batch_id=0")
    store.rebuild_index(spark, path)
    return store.collection_index(spark, path).select("collection", F.col("rows").alias("n"))


def item_export(spark, folder):
    path = shared_dir(spark, "items")
    store.export_items(extract.page_items(derived.page_articles(spark, folder)), path)
    return spark.read.schema("link STRING, title STRING, content STRING").json(path)


def _queued(spark, folder):
    base = shared_dir(spark, "drain")
    queue, root = f"{base}/queue", f"{base}/store"
    D.enqueue(_messages(spark, folder), queue)
    return queue, root, f"{base}/checkpoint"


def stream_drain(spark, folder):
    queue, root, checkpoint = _queued(spark, folder)
    D.drain(spark, queue, root, checkpoint)
    articles = D.drained_articles(spark, root).drop("ingested_at", "run", "batch_id")
    return articles.withColumn("pre_info", _joined("pre_info"))


def stream_two_queues(spark, folder):
    """Two queues with a checkpoint each, one store: what both brought is there."""
    queue, root, checkpoint = _queued(spark, folder)
    other = f"{queue}-2"
    D.enqueue(_messages(spark, folder), other)
    D.drain(spark, queue, root, checkpoint)
    D.drain(spark, other, root, f"{checkpoint}-2")
    return D.drained_articles(spark, root).groupBy("collection").agg(F.count("*").alias("n"))


def stream_collection_exists(spark, folder):
    """Which suppliers have a collection, in a store that a stream and a batch have filled."""
    queue, root, checkpoint = _queued(spark, folder)
    D.drain(spark, queue, root, checkpoint)
    late = D.drained_articles(spark, root).select("link").withColumn("collection", F.lit("a late one"))
    store.append_articles(late, root)
    names = table(spark, folder, "supplier").select(F.col("s_name").alias("collection"))
    names = names.unionByName(spark.range(1).select(F.lit("a late one").alias("collection")))
    return store.mark_existing(names, store.collection_index(spark, root))


def store_joined(spark, folder):
    """A stream of small batches and two batch jobs, joined while the stream is not at its end:
    articles by collection, as stored and as indexed."""
    base = shared_dir(spark, "joined")
    queue, root, checkpoint = f"{base}/queue", f"{base}/store", f"{base}/checkpoint"
    messages = _messages(spark, folder)
    halves = [messages.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == k) for k in (0, 1)]
    for k, half in enumerate(halves):
        D.enqueue(half, queue)
        D.drain(spark, queue, root, checkpoint)
        store.append_articles(routing.accepted_articles(_routed(spark, folder)), root)
        if k == 0:
            joining.join_batches(spark, root, {D.stream_identity(spark, checkpoint): D.settled_batch(spark, checkpoint)})
    joining.join_batches(spark, root, {D.stream_identity(spark, checkpoint): D.settled_batch(spark, checkpoint)})
    joining.delete_replaced(spark, root)
    rows = D.drained_articles(spark, root).groupBy("collection").agg(F.count("*").alias("n"))
    return rows.join(store.collection_index(spark, root).select("collection", F.col("rows").alias("indexed")), "collection", "full")


def stream_stop_rule(spark, folder):
    """A drain that runs until its queue has been idle, then stops: what it has stored."""
    queue, root, checkpoint = _queued(spark, folder)
    query = D.start_drain(spark, queue, root, checkpoint, until_empty=False)
    D.stop_when_idle(query, wait_step=1.0, max_waits=3)
    return D.drained_articles(spark, root).groupBy("collection").agg(F.count("*").alias("n"))


def stream_empty(spark, folder):
    """The first day of every supplier: no queue, no store, then an empty queue drained."""
    base = shared_dir(spark, "first-day")
    queue, root = f"{base}/queue", f"{base}/store"
    names = table(spark, folder, "supplier").select(F.col("s_name").alias("collection"))

    def state(name: str) -> DataFrame:
        marked = store.mark_existing(names, store.stored(spark, root)).agg(
            F.count("*").alias("suppliers"), F.count_if("present").alias("present")
        )
        waiting = _landed(spark, D.backlog(spark, queue, root), "backlog").select("messages")
        answer = coverage.next_dates(D.drained_log(spark, root), TODAY).select("status")
        return _landed(spark, marked.join(waiting).join(answer).withColumn("state", F.lit(name)), "state")

    before = state("before")
    D.drain(spark, queue, root, f"{base}/checkpoint")
    return before.unionByName(state("after"))


def stream_rejects(spark, folder):
    queue, root, checkpoint = _queued(spark, folder)
    D.drain(spark, queue, root, checkpoint)
    return D.drained_rejects(spark, root).groupBy("stage", "reason").agg(F.count("*").alias("n"))


def stream_next_dates(spark, folder):
    """The days to collect next, from the log a drain has stored."""
    queue, root, checkpoint = _queued(spark, folder)
    D.drain(spark, queue, root, checkpoint)
    return coverage.next_dates(D.drained_log(spark, root), TODAY)


def stream_backlog(spark, folder):
    """Messages on the queue before and after a drain."""
    queue, root, checkpoint = _queued(spark, folder)
    # Settled before the drain changes what it counts.
    before = _landed(spark, D.backlog(spark, queue, root), "backlog")
    D.drain(spark, queue, root, checkpoint)
    after = D.backlog(spark, queue, root)
    return (
        before.select(F.lit("before").alias("state"), "messages")
        .unionByName(after.select(F.lit("after").alias("state"), "messages"))
    )


def latest_result(spark, folder):
    """Every event is a result stored under its user; the newest one is served."""
    answers = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("value"),
    )
    return results.latest_results(answers)


def _in_batches(rows: DataFrame, number: Column, n: int = 3) -> list[DataFrame]:
    """All rows, in batches that come one after the other and out of order."""
    return [rows.filter(F.pmod(number, F.lit(n)) == k) for k in range(n)]


def latest_result_folded(spark, folder):
    """The same answers from a table that each batch of events was folded into."""
    answers = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
    kept = folded.FoldedTable(spark, shared_dir(spark, "answers"), results.ANSWERS)
    for batch in _in_batches(answers, F.xxhash64("seq")):
        results.fold_results(kept, batch)
    return results.folded_results(kept)


def _folded_days(spark, days: DataFrame) -> DataFrame:
    kept = folded.FoldedTable(spark, shared_dir(spark, "covered"), coverage.INTERVALS)
    for batch in _in_batches(days, F.xxhash64("date")):
        coverage.fold_coverage(kept, batch)
    return kept.read()


def coverage_intervals(spark, folder):
    """The unbroken runs of days with orders."""
    return coverage.covered_intervals(_orders(spark, folder))


def missing_dates_folded(spark, folder):
    return coverage.missing_dates_of(_folded_days(spark, _orders(spark, folder)))


def next_dates_folded(spark, folder):
    return coverage.next_dates_of(_folded_days(spark, _events(spark, folder)), TODAY)


def next_dates_answer(spark, folder):
    """The stored answer to the date query, read by its key."""
    answer = coverage.next_dates(_events(spark, folder), TODAY)
    older = coverage.next_dates(_orders(spark, folder), TODAY)
    stored = results.next_dates_result(older, 1, "news_db", spark).unionByName(
        results.next_dates_result(answer, 2, "news_db", spark)
    )
    value = F.from_json("value", "status STRING, before DATE, after DATE")
    return results.latest_results(stored).withColumn("v", value).select("key", "v.*")


# ---------------------------------------------------------------- end to end


def daily_news(spark: SparkSession, folder: str) -> DataFrame:
    landed = lambda parsed: _landed(spark, parsed, "parsed")
    news = daily.collect_news(derived.feeds(spark, folder), table(spark, folder, "pages"), land=landed)
    return routing.accepted_articles(news.routed).withColumn("pre_info", _joined("pre_info"))


def daily_news_redirected(spark: SparkSession, folder: str) -> DataFrame:
    """The daily job over pages with older copies, redirects followed: articles by company."""
    landed = lambda parsed: _landed(spark, parsed, "parsed")
    html = table(spark, folder, "pages").select("url", "html")
    copies = derived.page_copies(spark, folder).join(html, "url")
    news = daily.collect_news(derived.feeds(spark, folder), copies, newest="page_id", land=landed, redirects=derived.redirects(spark, folder))
    return routing.accepted_articles(news.routed).select("collection", _joined("pre_info"), "link", "title", "content")


def daily_news_rejects(spark: SparkSession, folder: str) -> DataFrame:
    landed = lambda parsed: _landed(spark, parsed, "parsed")
    news = daily.collect_news(derived.feeds(spark, folder), table(spark, folder, "pages"), land=landed)
    return news.rejects.groupBy("stage", "reason").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_events, coverage_orders, next_dates, next_dates_gap, next_dates_forward,
        next_dates_no_log, date_walk, missing_dates, source_addresses,
        feed_unwrap_parse, feed_flatten, daily_log, feed_rejects,
        joblist_append, joblist_replace, joblist_clear, joblist_slice, joblist_slice_from_end,
        joblist_count, job_numbers, job_messages, sublist_messages,
        url_companies, url_companies_split, url_companies_copies, url_companies_single, url_no_companies, url_unmatched,
        url_redirected, redirect_hops, redirect_rejects, listed_filter, article_main, article_main_layouts,
        text_blocks, article_content, selector_extract, selector_places, selector_blocks, selector_links,
        messages_encoded, messages_decoded, legacy_normalised,
        routed, route_counts, keywords, log_dates, rejects, required_gate,
        store_roundtrip, collection_exists, item_export,
        stream_drain, stream_two_queues, stream_collection_exists, stream_empty, stream_rejects, stream_next_dates, stream_backlog,
        collection_rows, store_joined, stream_stop_rule, latest_result_folded, coverage_intervals, missing_dates_folded, next_dates_folded,
        latest_result, next_dates_answer, daily_news, daily_news_redirected, daily_news_rejects,
    )
}
