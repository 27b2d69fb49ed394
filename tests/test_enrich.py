import json

from pyspark.sql import functions as F

from inkfold.operators import enrich as E, joblists as L
from tests.helpers import plan, rows


def jobs(spark, *specs):
    texts = [
        (json.dumps({"index": i, "logInfo": {"Date": "2024-01-01", "Total": len(urls)}, "preInfo": pre, "urlList": urls}),)
        for i, (urls, pre) in enumerate(specs)
    ]
    return L.parse_jobs(spark.createDataFrame(texts, "message string"))


def pages(spark, *urls):
    return spark.createDataFrame([(u, u + "!") for u in urls], "url string, title string")


def found(spark, entries, *urls):
    got = E.attach_companies(entries, pages(spark, *urls)).collect()
    return sorted((r["index"], r.pos, r.url, r.pre_info, r.title) for r in got)


def test_pairing_last_wins_and_duplicates_stay(spark):
    entries = E.list_entries(jobs(spark, (["a", "b", "a"], [["A"], ["B"], ["A2", "A3"]]), (["a"], [["Z"]])))
    assert found(spark, entries, "a", "b", "c") == [
        (0, 0, "a", ["A2", "A3"], "a!"), (0, 1, "b", ["B"], "b!"), (0, 2, "a", ["A2", "A3"], "a!"),
        (1, 0, "a", ["Z"], "a!"),
    ]
    assert rows(E.unlisted_pages(entries, pages(spark, "a", "b", "c"))) == [
        ("enrich", "page url not in any list", "c")
    ]


def test_copies_of_a_page_do_not_multiply_and_nothing_is_lost(spark):
    entries = E.list_entries(jobs(spark, (["a", "b", "a", "gone", "a", "a"], [["A"]] * 6)))
    copies = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "b")], "url string, day int, title string")
    got = E.attach_companies(entries, copies, newest="day").collect()
    assert sorted((r.pos, r.title) for r in got) == [(0, "new"), (1, "b"), (2, "new"), (4, "new"), (5, "new")]
    assert rows(E.unfetched_entries(entries, copies)) == [("enrich", "listed url has no page", "gone")]


def test_only_listed_pages_go_on_and_pages_are_not_shuffled(spark):
    entries = E.list_entries(jobs(spark, (["u1", "u5"], [["A"]] * 2)))
    many = spark.range(3000).select(F.concat(F.lit("u"), F.col("id")).alias("url"), F.lit("<p>x</p>").alias("html"))
    kept = E.maybe_listed(entries, many)
    found_urls = {r.url for r in kept.collect()}
    assert {"u1", "u5"} <= found_urls and len(found_urls) < 30
    scan = plan(kept).split("Subqueries")[0]
    assert "Exchange" not in scan and "Join" not in scan


def test_single_company_list_is_for_all_and_else_none(spark):
    entries = E.list_entries(jobs(spark, (["a", "b"], [["S"]]), (["a", "b", "c"], [["X"], ["Y"]]), (["a", "b"], [])))
    assert [(i, u, p) for i, _, u, p, _ in found(spark, entries, "a", "b")] == [
        (0, "a", ["S"]), (0, "b", ["S"]), (1, "a", None), (1, "b", None), (2, "a", None), (2, "b", None),
    ]


def test_listed_but_not_fetched_and_empty_jobs_give_nothing(spark):
    entries = E.list_entries(jobs(spark, (["gone"], [["G"]]), ([], [])))
    assert found(spark, entries, "a") == []


def test_a_url_with_a_third_of_all_entries_is_split(spark):
    """The hot key's entries stay whole and are spread over several tasks."""
    n = 60_000
    hot = F.col("id") % 3 == 0
    entries = spark.range(0, n, 1, 8).select(
        F.lit(0).cast("bigint").alias("index"),
        F.col("id").alias("pos"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("url"),
        F.array(F.concat(F.lit("company "), F.col("id"))).alias("pre_info"),
        F.lit("paired").alias("pairing"),
    )
    articles = entries.select("url").distinct().withColumn("title", F.repeat(F.col("url"), 3))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = E.attach_companies(entries, articles).select("pos", "url", "pre_info", "title")
        got = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.pos for r in got) == list(range(n))
        assert {tuple(r.pre_info) for r in got if r.url == "hot"} == {(f"company {n - 3}",)}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unlisted_pages_reads_only_urls(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("a", "<p>")], "url string, html string").write.parquet(path)
    entries = E.list_entries(jobs(spark, (["b"], [["B"]])))
    text = plan(E.unlisted_pages(entries, spark.read.parquet(path)))
    assert "ReadSchema: struct<url:string>" in text


def test_the_filter_grows_with_the_lists(spark):
    """A million listed URLs against pages of another million: few pass, none is lost."""
    n = 1_000_000
    entries = spark.range(n).select(F.concat(F.lit("http://a/"), "id").alias("url"))
    others = spark.range(n).select(F.concat(F.lit("http://b/"), "id").alias("url"))
    passed = E.maybe_listed(entries, others).count()
    assert 0 < passed < 0.01 * n
    assert E.maybe_listed(entries, entries).count() == n
    fixed = E.filter_size(10_000)
    assert E.maybe_listed(entries, others, size=fixed).count() > 20 * passed  # what a table of fixed size lets through


def test_a_filter_of_several_values(spark):
    entries = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id") * 2).alias("url"))
    pages = spark.range(40_000).select(F.concat(F.lit("u"), "id").alias("url")).unionByName(spark.createDataFrame([(None,)], "url string"))
    size = E.filter_size(20_000, shard_bits=16)
    assert size.shards == 8
    kept = {r.url for r in E.maybe_listed(entries, pages, size=size).collect()}
    assert {r.url for r in entries.collect()} <= kept and len(kept) < 20_400 and None not in kept
    assert E.filter_size(10**12) == E.FilterSize(E.MAX_SHARDS, 1 << E.SHARD_BITS - 6)
    assert E.maybe_listed(entries.limit(0), pages).count() == 0


def test_only_newest_copies_go_on(spark):
    pages = spark.range(3000).select(F.concat(F.lit("u"), F.col("id") % 1000).alias("url"), F.col("id").alias("day"), F.lit("<p>").alias("html"))
    kept = E.maybe_newest(pages, "day").collect()
    assert {(r.url, r.day) for r in kept} >= {(f"u{i}", i + 2000) for i in range(1000)} and len(kept) < 1030
