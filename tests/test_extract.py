import html as pyhtml
import os
import random

import pytest
from pyspark.sql import functions as F

from inkfold.functions import html_text as H
from inkfold.operators import extract as X
from tests.helpers import plan

DATA = "/root/testdata/sf0.001/pages.parquet"


def blocks(spark, text):
    df = spark.createDataFrame([(0, text)], "page_id int, html string")
    return [(r.text, r.words, r.link_words) for r in sorted(X.text_blocks(df).collect(), key=lambda r: r.pos)]


def article(spark, text):
    df = spark.createDataFrame([(text,)], "html string")
    row = X.extract_articles(df).collect()[0]
    return row.title, row.content


def test_blocks_and_inline_tags(spark):
    page = "<body><p>one <b>two</b>three<p>four<br>five <SPAN class='x'>six</SPAN><section>seven</section></body>"
    assert blocks(spark, page) == [
        ("one twothree", 2, 0), ("four", 1, 0), ("five six", 2, 0), ("seven", 1, 0),
    ]


def test_scripts_styles_comments_are_not_text(spark):
    page = '<script>var t="</p>";</script>a<style>p{}</style><!-- <p>no</p> -->b<script>left open <p>x'
    assert blocks(spark, page) == [("ab", 1, 0)]


def test_title_is_no_block_and_is_cleaned(spark):
    assert article(spark, "<title> A &amp;\n B </title><p>x")[0] == "A & B"
    assert blocks(spark, "<html><head><title>T t</title></head><p>x") == [("x", 1, 0)]
    assert article(spark, "<p>no title")[0] == ""


def test_links_count_in_every_block_they_span(spark):
    page = "<a href='x'>in <div>deep er</div> out</a> plain<p>free <a>l1 l2</a> end</p></a>"
    assert blocks(spark, page) == [
        ("in", 1, 1), ("deep er", 2, 2), ("out plain", 2, 1), ("free l1 l2 end", 4, 2),
    ]


def test_less_than_sign_is_text(spark):
    assert blocks(spark, "<p>1 < 2 and a<3</p>") == [("1 < 2 and a<3", 5, 0)]


def test_unspaced_scripts_count_characters(spark):
    assert blocks(spark, "<p>平安银行 rose 3%</p><p><a>新闻</a>é</p>") == [("平安银行 rose 3%", 6, 0), ("新闻é", 3, 2)]


def test_entities_against_the_standard_library(spark):
    texts = [
        "a &amp;amp; b", "&lt;p&gt;", "x&nbsp;y", "&#39;&#x27;&#8217;&#x1F600;", "&eacute;&Eacute;", "&unknown; &amp",
        "&&&copy;&", "&#;", "&#xZZ;", "AT&T;", "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", H.decode_entities(F.col("t")).alias("d")).collect()}
    for i, text in enumerate(texts):
        expected = pyhtml.unescape(text)
        assert got[i] == expected, text
    odd = spark.createDataFrame([("&#55296;&#1;&#9999999;",)], "t string")
    assert odd.select(H.decode_entities(F.col("t"))).collect()[0][0] == "���"


def rules(blocks):
    """The classifier, written down once more over (words, link words)."""
    out = []
    for i, (words, links) in enumerate(blocks):
        before = blocks[i - 1] if i else (0, 0)
        after = blocks[i + 1][0] if i + 1 < len(blocks) else 0
        ld, ld_before = links / words, (before[1] / before[0] if before[0] else 0)
        if ld > 0.333333:
            out.append(False)
        elif ld_before <= 0.555556:
            out.append(words > 16 or after > 15 or before[0] > 4)
        else:
            out.append(words > 40 or after > 17)
    return out


def test_classifier_against_brute_force(spark):
    rng = random.Random(3)
    pages, expected = [], {}
    for page in range(60):
        sizes = [(rng.choice([1, 3, 5, 10, 16, 17, 30, 41]), rng.random()) for _ in range(rng.randint(1, 12))]
        sizes = [(n, int(n * f) if f > 0.5 else 0) for n, f in sizes]
        text = "".join(
            "<p>" + " ".join(["w"] * (n - k)) + (" <a href='#'>" + " ".join(["l"] * k) + "</a>" if k else "") + "</p>"
            for n, k in sizes
        )
        pages.append((page, text))
        expected[page] = (sizes, rules(sizes))
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = {}
    for r in sorted(X.text_blocks(df).collect(), key=lambda r: (r.page_id, r.pos)):
        got.setdefault(r.page_id, ([], []))
        got[r.page_id][0].append((r.words, r.link_words))
        got[r.page_id][1].append(r.is_content)
    assert got == expected


def test_content_is_one_line_per_block(spark):
    long = " ".join(["word"] * 20)
    assert article(spark, f"<ul><li><a>nav</a></ul><p>{long}</p><p>{long} b</p>")[1] == f"{long}\n{long} b"


def test_extraction_stays_in_one_stage_and_is_not_repeated(spark):
    df = X.extract_articles(spark.read.parquet(DATA).select("url", "html"))
    assert "Exchange" not in plan(df)
    filtered = plan(df.filter("content != '' and title != ''"), "simple")
    assert filtered.count("(?i:script)\\b") == 1


@pytest.mark.parametrize(
    "page, title, content",
    [
        (
            '<div class="titmain"><div>x</div><h1>A<b>B</b> &amp; C</h1></div><h1>no</h1>'
            '<div class="texttit_m1"><p>one<p>two<div>skip</div>'
            '<div class="texttit_m1"><p>three</p></div><p>four</div><p>no</p>'
            "<div id=z class='texttit_m1'><p>five</p></div>",
            ["A", "B", " & C"], ["one", "two", "three", "four", "five"],
        ),
        ('<div class="titmain x"><h1>no</h1></div>', [], []),
        ('<div class="texttit_m1"><div><p>a<br>b <i>c</i></p></div></div><p>d', [], ["a", "b ", "c"]),
        ('<div class="texttit_m1"><script>"</div><p>"</script><p>e<!-- x -->f</p></div>', [], ["e", "f"]),
        ("", [], []),
    ],
)
def test_selectors(spark, page, title, content):
    row = X.select_articles(spark.createDataFrame([(page,)], "html string")).collect()[0]
    assert (list(row.title), list(row.content)) == (title, content)


def test_selected_items(spark):
    df = spark.createDataFrame([("u", "<title>t</title>")], "url string, html string")
    assert [tuple(r) for r in X.page_items(X.extract_articles(df)).collect()] == [("u", "t", "")]
    assert os.path.exists(DATA)


@pytest.mark.parametrize("markup, text", [
    ("a &apos;b&apos; &notin; c", "a 'b' ∉ c"),
    ("&CounterClockwiseContourIntegral; &#128; &#x80; &#150;", "∳ € € –"),
    ("&copy 1 &ampx &notit; &unknown; & &#; &#0; &#99999999999;", "© 1 &x ¬it; &unknown; & &#; � �"),
    ("&lt;b&gt; &#65 &#x42;", "<b> A B"),
])
def test_references_of_html_5(spark, markup, text):
    df = spark.createDataFrame([(markup,)], "t string")
    assert df.select(H.decode_entities(F.col("t"))).first()[0] == text


@pytest.mark.parametrize("html, texts", [
    ('<div title="a > b">x</div>', ["x"]),
    ("<div title='a > b' class=\"c\">x</div>y", ["x", "y"]),
    ("<p title=\"never ends>x</p><p>y</p>", ["x", "y"]),
    ("<p>It's <b class=it's>so</b></p>'", ["It's so", "'"]),
    ("<select><option>no<option>no</select><noscript>no</noscript><p>yes", ["yes"]),
    ("<p " + 'a="1" ' * 20_000 + ">x", ["x"]),
])
def test_tags_and_what_is_no_text(spark, html, texts):
    df = spark.createDataFrame([(html,)], "html string")
    assert [r.text for r in X.text_blocks(df).orderBy("pos").collect()] == texts


def test_nested_inner_elements_keep_their_text(spark):
    html = "<article><div>a<div>b</div>c</div><span>s<span>t</span></span></article><div>out</div>"
    df = spark.createDataFrame([(html,)], "html string")
    got = df.select(X.select_texts(F.col("html"), "article", "div").alias("d"), X.select_texts(F.col("html"), "article", "span").alias("s")).first()
    assert got.d == ["a", "b", "c"] and got.s == ["s", "t"]


def test_very_many_nested_elements_take_linear_time(spark):
    import time

    n = 100_000
    page = "<div class='x'>" * n + "<p>inside</p>" + "</div>" * n + "<p>outside</p><div class='x'><p>more</p></div>"
    df = spark.createDataFrame([(page,)], "html string").select(X.select_texts(F.col("html"), "div", "p", "x").alias("t"))
    start = time.time()
    assert df.first().t == ["inside", "more"]
    assert time.time() - start < 10


def test_blocks_of_the_fold_give_what_one_fold_gives(spark, monkeypatch):
    r = random.Random(8)
    pages = ["".join(r.choice(["<div>", "<div class='k'>", "</div>", "<p>a</p>", "t", "<p>b"]) for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id int, html string")
    found = []
    for size in (1, 3, 10_000):
        monkeypatch.setattr(X, "FOLD_BLOCK", size)
        texts = df.select("page_id", X.select_texts(F.col("html"), "div", "p", "k").alias("t"))
        found.append({row.page_id: row.t for row in texts.collect()})
    assert found[0] == found[1] == found[2] and sum(bool(t) for t in found[0].values()) > 50
