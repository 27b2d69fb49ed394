import html
import re

import pyarrow.parquet as pq
import pytest

from inkfold.llm.main_text import extract, main_texts

SMALL = "/root/testdata/sf0.001/pages.parquet"
LONG = "one, two, three, and some more words that make a paragraph of it"


def plain(page: str) -> str:
    """Brute force for the given pages: the blocks of their one article."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
    return " ".join(b for b in blocks if b)


def test_given_pages():
    pages = pq.read_table(SMALL).column("html").to_pylist()
    assert [extract(p) for p in pages] == [plain(p) for p in pages]


@pytest.mark.parametrize("tag,attributes", [
    ("nav", ""), ("aside", ""), ("footer", ""), ("form", ""), ("header", ""), ("div", 'class="cookie-notice"'), ("div", "class=ad"),
    ("div", "id='comments'"), ("section", 'role="complementary"'), ("div", 'style="display: none"'), ("script", ""), ("noscript", ""),
])
def test_left_out(tag, attributes):
    page = f"<body><{tag} {attributes}><p>{LONG} no</p></{tag}><div class=post><p>{LONG} a</p><p>{LONG} b</p></div><{tag} {attributes}><p>{LONG} no</p></{tag}></body>"
    assert extract(page) == f"{LONG} a {LONG} b"


def test_marks_do_not_drop_what_wraps_the_article():
    assert extract(f'<body class="ad"><div class="with-sidebar"><article class="no-comments"><h1>T</h1><p>{LONG}</p></article></div>') == f"T {LONG}"


LAYOUTS = [
    # what holds the text is named like something else
    (f'<h1>T</h1><div class="layout has-sidebar"><p>{LONG} a</p><p>{LONG} b</p></div>', f"T {LONG} a {LONG} b"),
    (f'<div class="post-share-wrap"><p>{LONG} a</p><p>{LONG} b</p></div><p>Copyright 2020</p>', f"{LONG} a {LONG} b"),
    (f'<div id="promo"><p>{LONG} a</p><p>{LONG} b</p></div>', f"{LONG} a {LONG} b"),
    (f'<div class="legal"><div class="body"><p>{LONG} a</p><p>{LONG} b</p></div><div class="share">Share</div></div>', f"{LONG} a {LONG} b"),
    (f'<div class="no-comments with-menu"><p>{LONG} a</p><p>{LONG} b</p></div>', f"{LONG} a {LONG} b"),
    # inside an article a name that only begins like a marked one
    (f'<article><p>{LONG} a</p><div class="copyright-law-explained"><p>{LONG} {LONG} b</p></div></article>', f"{LONG} a {LONG} {LONG} b"),
    (f'<article><p>{LONG} a</p><div class="share-buttons"><p>Share it</p></div></article>', f"{LONG} a"),
    (f'<article><p>{LONG} a</p><div class="ad-slot-2"><p>{LONG} {LONG} no</p></div></article>', f"{LONG} a"),
    (f'<article><p>{LONG} a</p><div class="comment-thread"><p>{LONG} {LONG} no</p></div></article>', f"{LONG} a"),
    # parts of a text that stand side by side
    (f"<div><p>{LONG}, a</p><p>{LONG} b</p></div><div><p>Second part, short but text.</p></div>", f"{LONG}, a {LONG} b Second part, short but text."),
    (f'<div class=x><p>{LONG}, a</p></div><div><p>Another kind.</p></div><div class=x><p>All <a href=u>links</a>.</p></div>', f"{LONG}, a"),
    # comments and notices around a short text
    (f'<div class="post"><p>{LONG} a</p></div><div class="comments">' + f"<p>{LONG} no</p>" * 30 + "</div>", f"{LONG} a"),
    (f'<article><p>Short.</p></article><div class="newsletter"><p>{LONG} {LONG} no</p></div>', "Short."),
    (f'<div class="post"><p>{LONG} a</p></div><div class="cookie-notice"><p>{LONG} {LONG} no</p></div>', f"{LONG} a"),
]


@pytest.mark.parametrize("page,text", LAYOUTS)
def test_layouts(page, text):
    assert extract(f"<body>{page}</body>") == text


def test_marked_elements_in_each_other_take_linear_time():
    page = "<article>" + '<div class="copyright-law">' * 20_000 + f"<p>{LONG} {LONG}</p>"
    assert extract(page) == f"{LONG} {LONG}"
    assert extract(f"<body>{'<div class=ad>' * 20_000}<p>{LONG} {LONG}</p>") == f"{LONG} {LONG}"


def test_blocks_references_and_broken_markup():
    assert extract(f"<p>{LONG}&amp;co<br>x &nbsp; y<b>z</b>w<!-- no --><p title='a > b'>{LONG} <i>in</i>line") == f"{LONG}&co x yzw {LONG} inline"
    assert extract(f"<p>{LONG} 1 < 2</p><a href=\"x") == f"{LONG} 1 < 2"
    assert extract(f"<article><p>{LONG}</p><ul><li>a<li>b</ul></article>") == f"{LONG} a b"


@pytest.mark.parametrize("text", ["<é", "<Ä b", "<π", "<新闻>", "<3", "< p", "<", "<<", "<5>"])
def test_what_starts_no_tag_is_text(text):
    page = f"<article><p>{LONG} {text} and on</p><p>{LONG} behind</p></article>"
    assert extract(page) == f"{LONG} {text} and on {LONG} behind"


@pytest.mark.parametrize("comment", ["</3>", "</>", "</ p>", "</é x>", "</3 <b>"])
def test_an_end_tag_without_a_name_is_a_comment(comment):
    assert extract(f"<article><p>{LONG} a{comment}b</p><p>{LONG} behind</p></article>") == f"{LONG} ab {LONG} behind"


@pytest.mark.parametrize("tag", [
    '<p class="a"">', "<p title=it's>", "<p it's>", "<p title=a\"b>", "<p 'x>", "<p title = 'a > b' \">", "<p title=>", "<p data_hidden>",
    "<p title=it's/hidden>", "<p title='it' ' >", "<p/title=\"a>b\"/>", "<p =\">",
])
def test_quotes_count_only_where_a_value_starts(tag):
    page = f"<article>{tag}{LONG} it's a \"word\"</p><p class='b' title=\"c > d\">{LONG} behind</p></article>"
    assert extract(page) == f"{LONG} it's a \"word\" {LONG} behind"


def test_the_end_of_the_page_cuts_only_a_tag():
    assert extract(f"<p>{LONG} a <b and") == extract(f"<p>{LONG} a </b and") == f"{LONG} a"
    assert extract(f"<p>{LONG} a <é and") == f"{LONG} a <é and" and extract(f"<p>{LONG} a </") == f"{LONG} a </"
    assert extract("<p>" + "<é " * 30_000) == ("<é " * 30_000).strip() and extract('<a b="' * 30_001) == ""


def test_short_article_and_nothing():
    assert extract("<nav>menu</nav><article><h1>Hi</h1></article><p>x</p>") == "Hi"
    assert extract("") == extract("<nav>menu</nav>") == extract("<!-- x") == extract("   ") == ""


def test_deep_and_long_pages_end():
    deep = "<div>" * 50_000 + f"<p>{LONG}</p>"
    assert extract(deep) == LONG
    assert extract("<ul>" + f"<li>{LONG}" * 20_000) == " ".join([LONG] * 20_000)
    assert extract('<a "' * 30_000) == ""


def test_table(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "c"), (1, "u", f"<p>{LONG}</p>", "c"), (2, None, None, None), (None, "", "", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_texts(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("", 0), (LONG, len(LONG)), (LONG, len(LONG))]
    assert main_texts(df.limit(0)).count() == 0
