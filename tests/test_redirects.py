import random

from pyspark.sql import functions as F

from inkfold.operators import enrich as E, redirects as R
from inkfold.plans import daily
from tests.helpers import rows


def plain(edges):
    target = {}
    for asked, to in edges:
        if asked is not None and to is not None:
            target[asked] = max(target.get(asked, to), to)
    ends, loops = [], []
    for url in target:
        at, hops, seen = url, 0, set()
        while at in target and at not in seen:
            seen.add(at)
            at, hops = target[at], hops + 1
        (loops.append(url) if at in target else ends.append((url, at, hops)))
    return sorted(ends), sorted(loops)


def followed(spark, edges, newest=None, schema="asked string, target string"):
    found = R.follow_redirects(spark.createDataFrame(edges, schema), newest)
    return rows(found.resolved), sorted(r.payload for r in found.rejects.collect())


def test_chains_loops_and_two_targets(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("in", "x"), ("self", "self"), ("a", "0"), ("n", None), (None, "n")]
    assert followed(spark, edges) == plain(edges) == ([("a", "d", 3), ("b", "d", 2), ("c", "d", 1)], ["in", "self", "x", "y"])
    assert followed(spark, [("a", "b"), ("a", "b"), ("b", None)]) == ([("a", "b", 1)], [])
    assert followed(spark, []) == ([], [])


def test_long_chains_and_random_graphs(spark):
    r = random.Random(3)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(1500)]
    graph = [(f"g{i}", f"g{r.randrange(400)}") for i in range(300)]
    hot = [(f"h{i}", "c0000") for i in range(500)]
    ring = [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)]
    assert followed(spark, chain + graph + hot + ring) == plain(chain + graph + hot + ring)


def test_the_newest_target_counts(spark):
    edges = [("a", "z", 1), ("a", "b", 2), ("b", "c", 1)]
    assert followed(spark, edges, "seq", "asked string, target string, seq int")[0] == [("a", "c", 2), ("b", "c", 1)]


def test_a_page_takes_the_companies_of_the_address_asked_for(spark):
    entries = spark.createDataFrame([(0, 0, "a", ["A"]), (0, 1, "b", ["B"]), (0, 2, "a", ["C"]), (0, 3, "gone", ["D"])], "index int, pos int, url string, pre_info array<string>")
    pages = spark.createDataFrame([("final", 7), ("b", 8)], "url string, page_id int")
    resolved = R.follow_redirects(spark.createDataFrame([("a", "m"), ("m", "final")], "asked string, target string")).resolved
    found = E.attach_companies(entries, pages, redirects=resolved).select("pos", "asked", "url", "page_id", F.array_join("pre_info", ","))
    assert rows(found) == [(0, "a", "final", 7, "C"), (1, "b", "b", 8, "B"), (2, "a", "final", 7, "C")]


def test_the_daily_job_follows_redirects(spark):
    from tests.helpers import framed

    body = framed('{"newsinfo":[[{"infourl":"a","stockname":"A"}],[{"infourl":"loop","stockname":"B"}]]}')
    feeds = spark.createDataFrame([("2024-01-01", 0, body)], "date string, part int, body binary").withColumn("date", F.to_date("date"))
    pages = spark.createDataFrame([("final", "<title>new</title>", 2), ("final", "<title>old</title>", 1)], "url string, html string, seq int")
    moved = spark.createDataFrame([("a", "final"), ("loop", "loop")], "asked string, target string")
    news = daily.collect_news(feeds, pages, newest="seq", redirects=moved)
    assert [(r.collection, r.link, r.title) for r in news.routed.collect()] == [("A", "final", "new")]
    assert sorted((r.reason, r.payload) for r in news.rejects.collect()) == [("listed url has no page", "loop"), ("redirect loop", "loop")]
    assert news.rejects.count() == 2
