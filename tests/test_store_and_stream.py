import datetime as dt
import json
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkfold.operators import coverage, extract, messages as M, routing as R, store
from inkfold.plans import daily
from inkfold.session import shared_dir
from inkfold.sources import derived
from inkfold.sources.tables import table
from inkfold.streaming import drain as D
from tests.helpers import plan, rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sent(spark, tmp_path_factory):
    """The messages of the daily job over the small tables, and some broken ones."""
    path = str(tmp_path_factory.mktemp("sent") / "messages")
    good = daily.collected_messages(derived.feeds(spark, DATA), table(spark, DATA, "pages"))
    bad = derived.result_message_texts(spark, DATA)
    good.unionByName(bad).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def batch_result(sent):
    return R.route(M.decode_messages(sent))


def paths(tmp_path):
    return [str(tmp_path / n) for n in ("queue", "store", "checkpoint")]


def same(spark, sent, root):
    routed = batch_result(sent)
    for found, expected in (
        (D.drained_articles(spark, root), R.accepted_articles(routed)),
        (D.drained_log(spark, root), R.accepted_logs(routed)),
        (D.drained_rejects(spark, root), R.message_rejects(routed)),
    ):
        assert found.select(*expected.columns).exceptAll(expected).isEmpty()
        assert found.count() == expected.count()


def test_stream_equals_batch_in_many_batches_and_after_a_restart(spark, sent, tmp_path):
    queue, root, checkpoint = paths(tmp_path)
    D.enqueue(sent, queue)
    n = sent.count()
    assert D.backlog(spark, queue, root).collect()[0].messages == n
    D.drain(spark, queue, root, checkpoint, max_bytes=60_000)
    assert D.drained_articles(spark, root).select("batch_id").distinct().count() > 1
    same(spark, sent, root)
    assert tuple(D.backlog(spark, queue, root).collect()[0]) == (0, 0)
    # More messages arrive; the restarted drain takes only these.
    D.enqueue(sent.limit(5), queue)
    assert D.backlog(spark, queue, root).collect()[0].messages == 5
    D.drain(spark, queue, root, checkpoint)
    stored = sum(f(spark, root).count() for f in (D.drained_articles, D.drained_log, D.drained_rejects))
    assert stored == n + 5


def test_a_retried_batch_is_stored_once(spark, sent, tmp_path):
    _, root, _ = paths(tmp_path)
    batch = sent.withColumn("file", F.lit("f"))
    D.store_batch(batch, 0, root, "r")
    D.store_batch(batch, 0, root, "r")
    same(spark, sent, root)
    assert D.drained_files(spark, root).agg(F.sum("messages")).collect()[0][0] == sent.count()


def test_another_queue_or_checkpoint_keeps_what_is_stored(spark, sent, tmp_path):
    queue, root, checkpoint = paths(tmp_path)
    D.enqueue(sent, queue)
    D.drain(spark, queue, root, checkpoint)
    n = D.drained_articles(spark, root).count()
    other = str(tmp_path / "other")
    D.enqueue(sent, other)
    D.drain(spark, other, root, checkpoint + "2")
    assert D.drained_articles(spark, root).count() == 2 * n
    assert D.backlog(spark, other, root).first().messages == 0
    # A lost checkpoint: everything on the queue comes again, and nothing is deleted.
    D.drain(spark, queue, root, checkpoint + "3")
    assert D.drained_articles(spark, root).count() == 3 * n
    assert D.drained_articles(spark, root).select("run").distinct().count() == 3
    assert store.collection_exists(spark, root, "multiCompaniesTogether")
    assert not store.collection_exists(spark, root, "nobody")


def test_first_day(spark, tmp_path):
    queue, root, checkpoint = paths(tmp_path)
    assert tuple(D.backlog(spark, queue, root).first()) == (0, 0)
    assert not store.collection_exists(spark, root)
    for read in (D.drained_articles, D.drained_log, D.drained_rejects):
        assert read(spark, root).count() == 0
    D.drain(spark, queue, root, checkpoint)
    assert tuple(D.backlog(spark, queue, root).first()) == (0, 0)
    assert D.drained_articles(spark, root).count() == 0


def test_a_store_that_cannot_be_read_is_no_first_day(spark, tmp_path):
    root = tmp_path / "store"
    (root / "stored" / "run=x" / "batch_id=0" / "branch=article" / "bucket=0").mkdir(parents=True)
    (root / "stored" / "run=x" / "batch_id=0" / "branch=article" / "bucket=0" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        store.stored(spark, str(root)).count()


def test_stop_when_the_producer_has_ended(spark, sent, tmp_path):
    queue, root, checkpoint = paths(tmp_path)
    D.enqueue(sent, queue)
    query = D.start_drain(spark, queue, root, checkpoint, until_empty=False)
    try:
        assert D.stop_when_idle(query, 1.0, 10_000, producer_ended=lambda: True) is False
    finally:
        query.stop()
    same(spark, sent, root)
    assert D.backlog(spark, queue, root).first().messages == 0


def test_stop_when_idle(spark, sent, tmp_path):
    queue, root, checkpoint = paths(tmp_path)
    D.enqueue(sent, queue)
    query = D.start_drain(spark, queue, root, checkpoint, until_empty=False)
    try:
        with pytest.raises(ValueError):
            D.stop_when_idle(query, 0, 5)
        assert D.stop_when_idle(query, 1.0, 6) is False
    finally:
        query.stop()
    same(spark, sent, root)
    ended = D.start_drain(spark, queue, root, checkpoint)
    ended.awaitTermination()
    assert D.stop_when_idle(ended, 0.1, 5) is True


def test_append_articles_and_exists(spark, sent, tmp_path):
    path = str(tmp_path / "articles")
    assert not store.collection_exists(spark, path)
    articles = R.accepted_articles(batch_result(sent))
    store.append_articles(articles, path)
    store.append_articles(articles, path)
    table_ = store.stored(spark, path)
    assert table_.count() == 2 * articles.count()
    assert store.collection_exists(spark, path)
    assert store.collection_exists(spark, path, "multiCompaniesTogether")
    assert not store.collection_exists(spark, path, "nobody")
    names = spark.createDataFrame([("nobody",), ("multiCompaniesTogether",)], "collection string")
    assert rows(store.mark_existing(names, table_)) == [("multiCompaniesTogether", True), ("nobody", False)]


def footer_ranges(path):
    """Of each file the bucket and the first and last collection in it."""
    out = []
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                meta = pq.ParquetFile(os.path.join(folder, name)).metadata
                column = meta.schema.names.index("collection")
                stats = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
                out.append((folder, min(x.min for x in stats), max(x.max for x in stats)))
    return out


def test_files_hold_ranges_that_do_not_overlap_and_a_large_collection_is_cut(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows_ = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("c%04d", F.col("id") % 400)).alias("collection"),
        F.sha2(F.col("id").cast("string"), 512).alias("content"),
    )
    key, old = "spark.sql.adaptive.coalescePartitions.enabled", None
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        store.append_articles(rows_, path, buckets=2)
    finally:
        spark.conf.set(key, old)
    ranges = footer_ranges(path)
    stored = store.stored(spark, path)
    assert stored.count() == 60_000
    assert store.read_collection(stored, "hot", 2).count() == 20_000
    assert sum(a <= "hot" <= b for _, a, b in ranges) > 1  # several tasks wrote it
    for name in ("c0000", "c0123", "c0399"):
        folders = {f for f, a, b in ranges if a <= name <= b and f"bucket={bucket(spark, name)}" in f}
        files = [1 for f, a, b in ranges if f in folders and a <= name <= b]
        assert 1 <= len(files) <= 2  # at most one border inside a small collection


def bucket(spark, name):
    return spark.range(1).select(store.bucket_of(F.lit(name), 2)).first()[0]


def test_reading_a_collection_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "articles")
    store.append_articles(spark.createDataFrame([("a",), ("b",)], "collection string"), path)
    text = plan(store.read_collection(store.stored(spark, path), "a"))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", text)
    assert "EqualTo(collection,a)" in text


def test_companies_with_odd_names_round_trip(spark, tmp_path):
    path = str(tmp_path / "articles")
    names = ["A/B", "a=b", "x y", "\\d股", "100%", "a:b", "007"]
    store.append_articles(spark.createDataFrame([(n, "t") for n in names], "collection string, title string"), path)
    assert sorted(r.collection for r in store.stored(spark, path).collect()) == sorted(names)


def test_export_items(spark, tmp_path):
    path = str(tmp_path / "items")
    items = spark.createDataFrame([("l", "t é", None)], "link string, title string, content string")
    store.export_items(items, path)
    lines = [line for f in os.listdir(path) if f.endswith(".json") for line in open(os.path.join(path, f), encoding="utf-8")]
    assert [json.loads(line) for line in lines] == [{"link": "l", "title": "t é", "content": None}]


def test_stored_log_leads_to_the_next_addresses(spark, tmp_path):
    queue, root, checkpoint = paths(tmp_path)
    logs = spark.createDataFrame([("2024-01-01", 3), ("2024-1-2", 0)], "log_date string, total long")
    D.enqueue(M.log_messages(logs), queue)
    D.drain(spark, queue, root, checkpoint)
    found = daily.addresses_to_fetch(D.drained_log(spark, root), dt.date(2024, 1, 4), dt.date(2024, 1, 1))
    assert [r.address[-13:] for r in found.orderBy("date").collect()] == ["2024-01-03.js", "2024-01-04.js"]
    assert coverage.coverage(D.drained_log(spark, root)).collect()[0].has_gap is False


def test_direct_plan_equals_the_way_over_messages(spark):
    feeds, pages = derived.feeds(spark, DATA), table(spark, DATA, "pages")
    direct = R.accepted_articles(daily.collect_news(feeds, pages).routed)
    over = R.accepted_articles(batch_result(daily.collected_messages(feeds, pages)))
    assert rows(direct) == rows(over) and direct.count() > 0


def test_shared_dir_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path.startswith(base) if base else os.path.isdir(os.path.dirname(path))
    assert extract.BlockRules().words == 16
