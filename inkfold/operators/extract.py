"""Article extraction: title and main text of whole web pages.

The block rules are those of the word-count classifier published as "Boilerplate
Detection using Shallow Text Features" (WSDM 2010).  One page is one row from the
scan to the result, so a corpus of any size is a single narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from inkfold.functions import html_text as H
from inkfold.functions.once import compute_once


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the classifier (fixed values of the published rules)."""

    max_link_density: float = 0.333333
    max_previous_link_density: float = 0.555556
    words: int = 16
    next_words: int = 15
    previous_words: int = 4
    words_after_links: int = 40
    next_words_after_links: int = 17


def is_content(blocks: Column, index: Column, rules: BlockRules) -> Column:
    """The rules over a block, the one before and the one after it."""
    zero = F.lit(0)
    before, here, after = (F.get(blocks, index + step) for step in (-1, 0, 1))

    def density(block: Column) -> Column:
        return F.coalesce(block["link_words"] / block["words"], F.lit(0.0))

    words = here["words"]
    next_words = F.coalesce(after["words"], zero)
    previous_words = F.coalesce(before["words"], zero)
    return (
        F.when(density(here) > rules.max_link_density, False)
        .when(
            density(before) <= rules.max_previous_link_density,
            (words > rules.words)
            | (next_words > rules.next_words)
            | (previous_words > rules.previous_words),
        )
        .otherwise((words > rules.words_after_links) | (next_words > rules.next_words_after_links))
    )


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the HTML column by ``title`` and ``blocks``.

    The steps are separate projections on purpose: each result is used more than
    once in the next step, and this way it is computed once per row.
    """
    marked = (
        pages.withColumn("_markup", H.visible_markup(F.col(html)))
        .drop(html)
        .withColumn("_title", H.title_text(F.col("_markup")))
        .withColumn("_text", H.marked_text(F.col("_markup")))
        .drop("_markup")
    )
    blocks = (
        marked.withColumn("title", F.trim(H.squeeze(H.decode_entities(F.col("_title")))))
        .withColumn("_text", H.close_links_per_block(H.squeeze(H.decode_entities(F.col("_text")))))
        .withColumn("_unspaced", H.has_unspaced(F.col("_text")))
        .withColumn("blocks", H.cut_blocks(F.col("_text"), F.col("_unspaced")))
        .drop("_title", "_text", "_unspaced")
    )
    return compute_once(blocks, "title", "blocks")


def extract_articles(
    pages: DataFrame, html: str = "html", rules: BlockRules = BlockRules()
) -> DataFrame:
    """Replace the HTML column by ``title`` and ``content`` (main text, one line per block)."""
    kept = F.filter("blocks", lambda block, i: is_content(F.col("blocks"), i, rules))
    text = F.array_join(F.transform(kept, lambda block: block["text"]), "\n")
    return page_blocks(pages, html).withColumn("content", text).drop("blocks")


def text_blocks(
    pages: DataFrame, html: str = "html", rules: BlockRules = BlockRules()
) -> DataFrame:
    """One row per text block: position, word counts and the verdict of the rules."""
    flagged = F.transform(
        F.col("blocks"),
        lambda block, i: F.struct(
            block["text"].alias("text"),
            block["words"].alias("words"),
            block["link_words"].alias("link_words"),
            is_content(F.col("blocks"), i, rules).alias("is_content"),
        ),
    )
    base = page_blocks(pages, html).withColumn("blocks", flagged)
    keep = [F.col(c) for c in base.columns if c not in ("blocks", "title")]
    # The outer form: the inner one makes the optimizer test the size of the array
    # with a second copy of the whole extraction.
    rows = base.select(*keep, F.posexplode_outer("blocks").alias("pos", "block"))
    return rows.filter("pos is not null").select(*keep, "pos", "block.*")


def page_items(articles: DataFrame, link: str = "url") -> DataFrame:
    """The exported item of a page: link, title and content."""
    return articles.select(F.col(link).alias("link"), "title", "content")


# ---------------------------------------------------------------- selectors

# Tags that end an open paragraph.
PARAGRAPH_END = (
    r"(?i)</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt"
    r"|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|p"
    r"|pre|search|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[ \t\r\n\f/][^>]*)?>"
)
# Tags whose next start or end ends them, so they do not nest.
SELF_ENDING = frozenset("p a h1 h2 h3 h4 h5 h6 option title".split())
_CUT = "\x05"
#: Pieces that a fold over a page's tags takes together.
FOLD_BLOCK = 256


def _tag(name: str) -> str:
    return rf"<(?i:{name})(?:[ \t\r\n\f/][^>]*)?>"


def _inside_containers(markup: Column, container: str, css_class: str | None) -> Column:
    """Inner markup of all matching containers, nesting respected.

    The markup is cut at the container's own tags only, and a fold over these
    pieces keeps the depth.  It goes by blocks of pieces: what a block keeps is put
    together on its own and appended once, so that a page with very many tags does
    not copy all it has kept at each of them.
    """
    own_tag = rf"(</?(?i:{container})(?:[ \t\r\n\f/][^>]*)?>)"
    pieces = F.split(F.regexp_replace(markup, own_tag, _CUT + "$1"), _CUT)

    def described(piece: Column, index: Column) -> Column:
        closes = piece.startswith("</")
        opening = F.substring_index(piece, ">", 1)
        if css_class is None:
            matches = F.lit(True)
        else:
            # The whole attribute must equal the class, as in @class="...".
            value = r"(?is)[ \t\r\n\f]class\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
            matches = F.lit(css_class).isin(
                F.regexp_extract(opening, value, 1), F.regexp_extract(opening, value, 2)
            )
        return F.struct(
            F.when(index == 0, 0).when(closes, -1).otherwise(1).alias("step"),
            ((index > 0) & ~closes & matches).alias("target"),
            F.when(index == 0, piece).otherwise(F.substr(piece, F.length(opening) + 2)).alias("rest"),
        )

    def begin(depth: Column, entered: Column) -> Column:
        return F.struct(depth.alias("depth"), entered.alias("entered"), F.array().cast("array<string>").alias("parts"))

    def walk(state: Column, piece: Column) -> Column:
        depth = F.greatest(state["depth"] + piece["step"], F.lit(0))
        entered = (
            F.when((state["entered"] == 0) & piece["target"], depth)
            .when(depth < state["entered"], F.lit(0))
            .otherwise(state["entered"])
        )
        parts = F.when(
            entered > 0, F.concat(state["parts"], F.array(piece["rest"]))
        ).otherwise(state["parts"])
        return F.struct(depth.alias("depth"), entered.alias("entered"), parts.alias("parts"))

    def walk_block(state: Column, block: Column) -> Column:
        after = F.aggregate(F.transform(block, lambda p: described(p["piece"], p["index"])), begin(state["depth"], state["entered"]), walk)
        # A container border ends any open paragraph, so a block tag takes its place.
        text = F.transform(F.array(after), lambda a: F.struct(
            a["depth"].alias("depth"), a["entered"].alias("entered"),
            F.concat(state["parts"], F.when(F.size(a["parts"]) > 0, F.array(F.array_join(a["parts"], "<div>"))).otherwise(F.array().cast("array<string>"))).alias("parts")))
        return F.get(text, F.lit(0))

    def cut(numbered: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(numbered) - 1) / FOLD_BLOCK).cast("int"))
        return F.transform(starts, lambda k: F.slice(numbered, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))

    numbered = F.transform(pieces, lambda piece, index: F.struct(piece.alias("piece"), index.alias("index")))
    # As the variable of a lambda the pieces are made once, not for each block.
    blocks = F.get(F.transform(F.array(numbered), cut), F.lit(0))
    folded = F.aggregate(blocks, begin(F.lit(0), F.lit(0)), walk_block)
    region = F.array_join(folded["parts"], "<div>")
    if css_class is None:
        return region
    return F.when(markup.contains(css_class), region).otherwise("")


def select_texts(
    markup: Column, container: str, inner: str, css_class: str | None = None
) -> Column:
    """All text nodes under ``inner`` elements inside the matching containers, in order."""
    region = _inside_containers(markup, container, css_class)
    if inner in SELF_ENDING:
        end = PARAGRAPH_END if inner == "p" else rf"</(?i:{inner})(?:[ \t\r\n\f/][^>]*)?>"
        pieces = F.split(region, _tag(inner))
        elements = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        nodes = F.flatten(
            F.transform(elements, lambda e: F.split(F.get(F.split(e, end, 2), F.lit(0)), H.ANY_TAG))
        )
    else:
        # Elements that may hold others of their kind: the depth decides where one ends.
        nodes = F.split(_inside_containers(region, inner, None), H.ANY_TAG)
    return F.transform(F.filter(nodes, lambda n: n != ""), H.decode_entities)


# Where the articles of the collected site are.
TITLE_PLACE = ("div", "titmain", "h1")
CONTENT_PLACE = ("div", "texttit_m1", "p")


def select_articles(
    pages: DataFrame,
    html: str = "html",
    title: tuple[str, str | None, str] = TITLE_PLACE,
    content: tuple[str, str | None, str] = CONTENT_PLACE,
) -> DataFrame:
    """Replace the HTML column by ``title`` and ``content`` as lists of text nodes.

    ``title`` and ``content`` are (container tag, its class or None, inner tag).
    """
    markup = F.replace(F.regexp_replace(html, H.INVISIBLE, "<!>"), F.lit(_CUT), F.lit(" "))
    found = (
        pages.withColumn("_markup", markup)
        .drop(html)
        .withColumn("title", select_texts(F.col("_markup"), title[0], title[2], title[1]))
        .withColumn("content", select_texts(F.col("_markup"), content[0], content[2], content[1]))
        .drop("_markup")
    )
    return compute_once(found, "title", "content")
