"""Text out of HTML with built-in column functions only.

Everything here works inside one row: a page is never exploded, shuffled and put
together again.  Where a plain replacement of characters does the work, it is used
instead of a pattern: it is several times cheaper.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column, functions as F

# Control characters that cannot occur in the cleaned text serve as markers.
BLOCK, LINK_OPEN, LINK_CLOSE = "\x02", "\x03", "\x04"

# Patterns of the markup.  A quoted attribute value may hold a ">"; a quote
# that never ends means nothing.  Possessive runs keep long tags from being tried again.
_ATTRIBUTES = r"""(?:[^>=]*+(?:=[ \t\r\n\f]*+(?:"[^"]*+"|'[^']*+'|(?!["']))[^>=]*+)*+>|[^>]*>)"""
INVISIBLE = (
    r"(?s)<(?:(?i:script)\b[^>]*>.*?(?:</(?i:script)[^>]*>|\z)"
    r"|(?i:style)\b[^>]*>.*?(?:</(?i:style)[^>]*>|\z)"
    r"|(?i:noscript)\b[^>]*>.*?(?:</(?i:noscript)[^>]*>|\z)"
    r"|(?i:option)\b[^>]*>[^<]*"
    r"|!--.*?(?:-->|\z))"
)
TITLE = r"(?is)<title\b[^>]*>([^<]*)"
ANY_TAG = r"<[/!?a-zA-Z]" + _ATTRIBUTES
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)"
# Names that count without a semicolon, the longest first.
UNENDED = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"

# Blanks besides the space itself.
BLANKS = ("\t", "\n", "\r", "\f", "\xa0")

# Elements that do not start a new block of text.
INLINE = (
    "abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
    "q s samp small span strike strong sub sup time tt u var wbr"
).split()

_NAME_END = r"(?=[ \t\r\n\f/>])"
INLINE_TAG = "(?i)</?(?:" + "|".join(INLINE) + ")" + _NAME_END + _ATTRIBUTES
LINK_START, LINK_END = "(?i)<a" + _NAME_END + _ATTRIBUTES, "(?i)</a" + _NAME_END + _ATTRIBUTES

# Scripts written without blanks, where each character counts as a word.
UNSPACED = "[぀-ヿ㐀-䶿一-鿿豈-﫿]"
# One range around them, which is quicker to look for.
MAYBE_UNSPACED = "[぀-﫿]"


def replace_each(text: Column, found: tuple[str, ...], by: str) -> Column:
    return reduce(lambda col, one: F.replace(col, F.lit(one), F.lit(by)), found, text)


def squeeze(text: Column) -> Column:
    """Runs of blanks to one space."""
    spaces = replace_each(text, BLANKS, " ")
    return F.when(spaces.contains("  "), F.regexp_replace(spaces, "  +", " ")).otherwise(spaces)


# ---------------------------------------------------------------- entities


def _windows(code: int) -> str:
    """What the numbers 128 to 159 are taken for."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _code_point(number: Column) -> Column:
    """The character of a code point; U+FFFD where there is none to show."""
    valid = (
        number.isin(9, 10, 13)
        | number.between(32, 0xD7FF)
        | number.between(0xE000, 0x10FFFF)
    )
    old = F.array(*[F.lit(_windows(c)) for c in range(128, 160)])
    as_bytes = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return (
        F.when(number.between(128, 159), F.get(old, (number - 128).cast("int")))
        .when(valid, F.decode(as_bytes, "UTF-32"))
        .otherwise(F.lit("\ufffd"))
    )


def _number(reference: Column) -> Column:
    """The code point of a numeric reference, 0 if it is out of range by its length."""
    body = F.rtrim(reference, F.lit(";"))
    hexadecimal = F.ltrim(F.substr(body, F.lit(3)), F.lit("0"))
    decimal = F.ltrim(F.substr(body, F.lit(2)), F.lit("0"))
    return F.coalesce(
        F.when(F.substring(body, 2, 1).isin("x", "X"), F.when(F.length(hexadecimal).between(1, 6), F.conv(hexadecimal, 16, 10).cast("bigint")))
        .otherwise(F.when(F.length(decimal).between(1, 7), decimal.cast("bigint"))),
        F.lit(0).cast("bigint"),
    )


def _names(ended: bool) -> Column:
    """One literal, folded into a map constant when the plan is optimized."""
    chosen = {n: c for n, c in html5.items() if n.endswith(";") == ended and not set(c) & {"\n", "\t"}}
    return F.str_to_map(F.lit("\n".join(f"{n}\t{c}" for n, c in chosen.items())), F.lit("\n"), F.lit("\t"))


def decode_entities(text: Column) -> Column:
    """Named (HTML 5) and numeric character references, each decoded once.

    ``text`` is read several times, so hand over a column, not a long expression.
    """
    names, unended = _names(True), _names(False)

    def with_name(part: Column) -> Column:
        return F.struct(part.alias("part"), F.regexp_extract(part, REFERENCE, 0).alias("ref"))

    def replaced(part: Column, ref: Column, char: Column) -> Column:
        return F.concat(char, F.substr(part, F.length(ref) + 1))

    def decoded(piece: Column, index: Column) -> Column:
        part, ref = piece["part"], piece["ref"]
        # The most frequent ones first: looking up a map constant is a linear search.
        char = (
            F.when(ref == "amp;", "&").when(ref == "nbsp;", "\xa0").when(ref == "quot;", '"')
            .when(ref == "lt;", "<").when(ref == "gt;", ">")
            .when(ref.startswith("#"), _code_point(_number(ref)))
            .when(ref != "", F.try_element_at(names, ref))
        )
        short = F.regexp_extract(part, UNENDED, 0)
        return F.when(index == 0, part).otherwise(
            F.coalesce(
                replaced(part, ref, char),
                F.when(short != "", replaced(part, short, F.try_element_at(unended, short))),
                F.concat(F.lit("&"), part),
            )
        )

    pieces = F.transform(F.split(text, "&"), with_name)
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


# ---------------------------------------------------------------- a page, step by step


def visible_markup(html: Column) -> Column:
    """The page without scripts, styles and comments, and without the marker characters."""
    return replace_each(
        F.regexp_replace(html, INVISIBLE, ""), (BLOCK, LINK_OPEN, LINK_CLOSE), " "
    )


def title_text(markup: Column) -> Column:
    return F.regexp_extract(markup, TITLE, 1)


def marked_text(markup: Column) -> Column:
    """Text with markers for links and block borders in the place of tags.

    One pattern for each kind of tag over the whole page: no function is called for each tag.
    """
    text = F.regexp_replace(markup, TITLE, BLOCK)
    for pattern, mark in ((INLINE_TAG, ""), (LINK_START, LINK_OPEN), (LINK_END, LINK_CLOSE), (ANY_TAG, BLOCK)):
        text = F.regexp_replace(text, pattern, mark)
    return text


def close_links_per_block(text: Column) -> Column:
    """Make a link around several blocks a link in each of them.

    After this every block holds its own open and close markers.
    """

    def segment(part: Column, index: Column) -> Column:
        inside = F.substring_index(part, LINK_CLOSE, 1)
        again = F.replace(inside, F.lit(BLOCK), F.lit(LINK_CLOSE + BLOCK + LINK_OPEN))
        return F.when((index == 0) | ~inside.contains(BLOCK), part).otherwise(
            F.concat(again, F.substr(part, F.length(inside) + 1))
        )

    return F.array_join(F.transform(F.split(text, LINK_OPEN), segment), LINK_OPEN)


def has_unspaced(text: Column) -> Column:
    """May the text hold a script written without blanks?  Asked once per page, so
    that other pages are counted without a pattern."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(MAYBE_UNSPACED)


def count_words(text: Column, unspaced: Column) -> Column:
    """Words of a trimmed text with single spaces."""

    def count(words: Column) -> Column:
        without = F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
        return F.when(words == "", 0).otherwise(F.octet_length(words) - without + 1)

    apart = F.trim(F.regexp_replace(F.regexp_replace(text, UNSPACED, " $0 "), "  +", " "))
    counted_apart = F.get(F.transform(F.array(apart), count), F.lit(0))
    return F.when(unspaced, counted_apart).otherwise(count(text))


def _link_text(raw: Column) -> Column:
    """The texts of all links of a block, with a space between them."""
    parts = F.split(raw, LINK_OPEN)
    inside = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.trim(F.substring_index(p, LINK_CLOSE, 1)),
    )
    return F.array_join(F.filter(inside, lambda t: t != ""), " ")


def cut_blocks(text: Column, unspaced: Column) -> Column:
    """``ARRAY<STRUCT<text, words, link_words>>`` of the non-empty blocks, in order.

    ``unspaced`` is the column :func:`has_unspaced` of the page.
    """

    def cleaned(raw: Column) -> Column:
        plain = F.trim(replace_each(raw, (LINK_OPEN, LINK_CLOSE), ""))
        links = F.when(raw.contains(LINK_OPEN), _link_text(raw)).otherwise("")
        return F.struct(plain.alias("text"), links.alias("links"))

    def counted(block: Column) -> Column:
        return F.struct(
            block["text"].alias("text"),
            count_words(block["text"], unspaced).alias("words"),
            F.when(block["links"] == "", 0)
            .otherwise(count_words(block["links"], unspaced))
            .alias("link_words"),
        )

    blocks = F.transform(F.split(text, BLOCK), cleaned)
    return F.transform(F.filter(blocks, lambda b: b["text"] != ""), counted)
