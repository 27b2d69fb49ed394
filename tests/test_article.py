from pyspark.sql import functions as F

from inkfold.operators import article as A
from inkfold.sources import derived

LONG = "This sentence has well over sixteen words so that the classifier of blocks takes it for a part of the text itself, number {}."


def articles(spark, *bodies):
    df = spark.createDataFrame([(i, f"<html><title>A title of the page - The Paper</title><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, html string")
    return [r.content.split("\n") if r.content else [] for r in A.main_articles(df).orderBy("page_id").collect()]


def p(*numbers):
    return "".join(f"<p>{LONG.format(n)}</p>" for n in numbers)


def texts(*numbers):
    return [LONG.format(n) for n in numbers]


def test_heading_footer_and_what_follows_the_text_fall_away(spark):
    found = articles(
        spark,
        "<h1>A title of the page</h1>" + p(1, 2) + "<footer>Copyright 2020 by somebody, all of it</footer>",
        "<h1>A TITLE of the page - The Paper</h1>" + p(1, 2) + "<p>Comments (3)</p>" + p(3, 4, 5, 6),
        p(1, 2) + "<p>相关阅读</p>" + p(3),
        "<footer>&copy; a page</footer>" + p(1),
    )
    assert found == [texts(1, 2), texts(1, 2), texts(1, 2), texts(1)]


def test_neighbours_are_joined_and_the_heaviest_group_wins(spark):
    twice = " ".join(texts(7, 8, 9))
    long = f"<p>{twice}</p>"
    links = "<ul>" + "<li><a href='/'>Some link to follow</a></li>" * 4 + "</ul>"
    found = articles(
        spark,
        p(1, 2) + "<p><a href='/'>One link between</a></p>" + long + p(3),
        p(1, 2) + "<p><a href='/'>One link</a></p><p><a href='/'>and one more</a></p>" + long,
        p(1) + links + p(2, 3, 4) + links + p(5),
        p(1, 2, 3) + "<h2>The Paper</h2>" + p(4, 5),
        p(1) + links + p(2),
    )
    assert found == [[*texts(1, 2), twice, *texts(3)], [twice], texts(2, 3, 4), texts(1, 2, 3), texts(1)]


def test_an_end_mark_counts_only_behind_text(spark):
    found = articles(spark, "<p>Tags: one two</p>" + p(1, 2) + "<p>Read more</p>" + p(3), "<p>Share this</p>", "", "no tags")
    assert found == [texts(1, 2), [], [], []]


def test_null_pages_and_many_blocks(spark):
    many = "".join(f"<p>{LONG.format(i)}</p>" for i in range(20_000))
    df = spark.createDataFrame([(1, None), (2, many), (2, many)], "page_id long, html string")
    got = {r.page_id: r.content for r in A.main_articles(df).collect()}
    assert not got[1] and len(got[2].split("\n")) == 20_000


def test_given_pages_lose_heading_and_footer(spark):
    folder = "/root/testdata/sf0.001"
    pages = derived.framed_pages(spark, folder)
    rows = A.main_articles(pages).collect()
    assert len(rows) == pages.count() and sum(bool(r.content) for r in rows) > 0.9 * len(rows)
    for r in rows:
        lines = r.content.split("\n")
        assert r.title not in lines
        marks = [i for i, line in enumerate(lines) if line.startswith(("©", "Comments", "One reader", "Related"))]
        # Only a page with less text than an end mark asks for goes on behind it.
        assert not marks or len(" ".join(lines[: marks[0]]).split()) < 20


def test_one_row_from_scan_to_result(spark):
    from tests.helpers import plan

    df = spark.range(3).select("id", F.lit("<p>x</p>").alias("html"))
    assert "Exchange" not in plan(A.main_articles(df))
