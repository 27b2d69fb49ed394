"""The main text of a web page by scoring its tree.

Paragraphs pass points for length and commas to their ancestors, less with each level up;
a container's points are discounted by the share of its text that stands in links.  The
best container is kept, and those of its siblings that score well or read like text.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments
are left out by their elements and by the words of their class, id and role.  Words decide
less than text: inside an article a name that only begins like a marked one loses nothing
but short blocks, and an element that holds nearly all unlinked text of a page stays,
whatever its name, unless it holds reader comments.

A text is the blocks in page order, joined by one blank; white space inside a block is one
blank.  Inline elements do not separate words, a line break does.

Defined cases: a page that is null, empty or without text has an empty text; missing end
tags, cut-off pages and unknown elements are read as browsers do in the usual cases; pages
of any depth and length are read in one pass without recursion; repeated rows get the same
text; other columns stay unless they have the name of a result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame

from inkfold.llm.mapping import map_texts

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend option tbody td tfoot th thead tr".split())
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input map math menu nav noscript object option search"
    " script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of a class or id that mark what is no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs captcha comment comments consent"
    " cookie cookies copyright disclaimer discussion disqus feedback foot footer form gdpr header hidden legal login masthead"
    " menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription toolbar widget widgets".split()
)
# Marks of reader comments, words that say what a page has or lacks, and words that name no content of their own.
COMMENTS = frozenset("comment comments discussion disqus feedback replies reply respond".split())
SAYS = frozenset("has have is no not with without".split())
NEUTRAL = frozenset("area bar block body box column container content group inner item items list outer panel row section slot text unit wrap wrapper".split())
#: Open elements that a new one ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}

# An attribute: a quote means something only where a value starts, right after "=".
_SPACE = r"\t\n\f\r "
_VALUE = rf"[{_SPACE}]*+=[{_SPACE}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{_SPACE}\"'>][^{_SPACE}>]*+|(?=>))"
_TAG = re.compile(rf"</?([a-zA-Z][^\s/>]*+)((?:[{_SPACE}/]++|[^{_SPACE}/>][^{_SPACE}/>=]*+(?:{_VALUE}|(?![{_SPACE}]*+=)))*+)>")
_LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(rf"([^{_SPACE}/>][^{_SPACE}/>=]*+)(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^{_SPACE}\"'>][^{_SPACE}>]*+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_FROM_BODY = frozenset(("html", "body", "article", "main"))


class Node:
    __slots__ = (
        "tag", "parent", "children", "name", "left_out", "marked", "loosely", "remarks", "reads", "wraps", "points", "size",
        "linked", "unended", "enter", "leave")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        self.name = ""
        self.left_out = self.marked = self.loosely = self.remarks = self.reads = self.wraps = False
        self.points, self.size, self.linked, self.unended = 0.0, 0, 0, 0
        self.enter = self.leave = 0


def _mark(node: Node, names: str) -> None:
    """What the names of a class or id say; loosely: no name ends in a marked word."""
    for name in names.split():
        words = _WORD.findall(name)
        if not words or words[0] in SAYS or MARKS.isdisjoint(words):
            continue
        while len(words) > 1 and (words[-1] in NEUTRAL or words[-1].isdigit()):
            words.pop()
        exact = words[-1] in MARKS
        node.loosely = not exact and (node.loosely or not node.marked)
        node.marked = True
        node.remarks |= not COMMENTS.isdisjoint(words)


def _describe(node: Node, attributes: str) -> None:
    """Whether the element is left out, surely or by the words of its attributes."""
    tag = node.tag
    node.left_out = tag in LEFT_OUT
    if not attributes or tag in _FROM_BODY:
        return
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            _mark(node, value)
            if name == "class":
                node.name = " ".join(value.split())
        elif name == "role":
            node.left_out |= value.strip() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            node.left_out = True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            node.left_out = True


def parse(html: str) -> Node:
    """The element tree; texts are strings among the children."""
    root = Node("#root", None)
    stack, open_count, at, end = [root], {}, 0, len(html)
    pattern = _TAG

    def pop() -> None:
        open_count[stack.pop().tag] -= 1

    def close(tags: set[str], until: set[str] | frozenset[str]) -> None:
        """End the open elements from the last of `tags` on, if none of `until` is inside it."""
        if not any(open_count.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in until:
                return

    while at < end:
        place = html.find("<", at)
        if place < 0:
            place = end
        if place > at:
            stack[-1].children.append(html[at:place])
        if place == end:
            break
        if html.startswith("<!--", place):
            stop = html.find("-->", place + 4)
            at = end if stop < 0 else stop + 3
            continue
        starts_tag = _TAG_START.match(html, place)
        if html.startswith(("<!", "<?"), place) or not starts_tag and html.startswith("</", place) and place + 2 < end:
            stop = html.find(">", place)
            at = end if stop < 0 else stop + 1
            continue
        if not starts_tag:
            stack[-1].children.append("<")
            at = place + 1
            continue
        found = pattern.match(html, place)
        if not found and pattern is _TAG and (loose := _LOOSE_TAG.match(html, place)):
            pattern, found = _LOOSE_TAG, loose  # a quote without end: quotes mean nothing from here on
        if not found:
            break  # a tag that the end of the page cuts off: no ">" follows
        tag, at = found[1].lower(), found.end()
        if html[place + 1] == "/":
            if open_count.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag == "br":
                stack[-1].children.append(Node("br", stack[-1]))
            continue
        if tag in CLOSES_P and open_count.get("p"):
            close({"p"}, frozenset(("table", "button", "td", "th")))
        if tag in ENDS:
            while any(open_count.get(t) for t in ENDS[tag][0]) and stack[-1].tag not in ENDS[tag][1]:
                before = len(stack)
                close(*ENDS[tag])
                if len(stack) == before:
                    break
        node = Node(tag, stack[-1])
        _describe(node, found[2])
        stack[-1].children.append(node)
        if tag in RAW:
            stop = _RAW_END[tag].search(html, at)
            stop_at = stop.start() if stop else end
            if tag == "textarea" or tag == "title":
                node.children.append(html[at:stop_at])
            at = stop_at
            if stop:
                close_at = html.find(">", stop_at)
                at = end if close_at < 0 else close_at + 1
        elif tag not in VOID:
            stack.append(node)
            open_count[tag] = open_count.get(tag, 0) + 1
    return root


def _walk(root: Node) -> list[Node]:
    """Elements in page order with their range of places."""
    order, todo = [], [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            node.leave = len(order)
            continue
        node.enter = len(order)
        order.append(node)
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        if node.parent and (node.wraps or node.tag in ("article", "main")):
            node.parent.wraps = True
    return order


def _settle_loose(order: list[Node]) -> None:
    """Marks that a name only begins with do not hold for elements with a paragraph in them."""
    own = {}
    for node in reversed(order):
        if node.left_out or node.tag == "a":
            continue
        size = own.get(node.enter, 0) + sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.loosely and not node.remarks and size >= PARAGRAPH:
            node.reads = True
        if node.parent:
            own[node.parent.enter] = own.get(node.parent.enter, 0) + size


def _blocks(root: Node, use_marks: bool) -> list[tuple[Node, str, int]]:
    """Block element, text and length in links of each block that is not left out."""
    out: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    state = {"linked": 0}

    def flush(block: Node) -> None:
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            out.append((block, text, min(state["linked"], len(text))))
        pieces.clear()
        state["linked"] = 0

    # (element, its block, inside a link, inside an article) or a text or a block's end
    todo: list[tuple] = [(root, root, False, False)]
    while todo:
        item, block, link, article = todo.pop()
        if item is None:
            flush(block)
            continue
        if isinstance(item, str):
            pieces.append(item)
            if link:
                state["linked"] += len(item.strip())
            continue
        if item.tag == "br" or item.tag == "hr":
            pieces.append(" ")
            continue
        out_by_mark = use_marks and item.marked and not item.wraps and not (article and item.tag in ("p", "b", "i", "em", "strong", "span", "a"))
        out_by_mark &= not (article and item.reads)
        header = item.tag == "header" and not article and not item.wraps
        if item.left_out or out_by_mark or header:
            if item.tag in BLOCK:
                flush(block)
            continue
        article = article or item.tag == "article"
        inner = block
        if item.tag in BLOCK:
            flush(block)
            inner = item
            todo.append((None, item, False, False))
        link = link or item.tag == "a"
        for child in reversed(item.children):
            todo.append((child, inner, link, article))
    return out


#: Code points of a paragraph that reads like an article's; shortest block that scores; how
#: many times what is left an element must hold to stay in spite of its name.
PARAGRAPH, SCORED, OUTWEIGHS = 80, 25, 8
_ENDS_SENTENCE = (".", "!", "?", "\u3002", "\uff01", "\uff1f")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre td li dd blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
_PRIOR = {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0, "body": 0.0, "ul": -5.0, "ol": -3.0, "table": -3.0, "li": -3.0}


def _score(order: list[Node], blocks: list[tuple[Node, str, int]]) -> list[Node]:
    """Containers that got points; all elements get the sizes of their text and links."""
    containers: dict[int, Node] = {}
    for block, text, linked in blocks:
        block.size += len(text)
        block.linked += linked
        block.unended += block.tag not in _PARAGRAPHS or not text.endswith(_ENDS_SENTENCE)
    for node in reversed(order):
        if node.parent:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.unended += node.unended
    for block, text, linked in blocks:
        if len(text) < SCORED:
            continue
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / len(text))
        up: Node | None
        up, level = (block.parent if block.tag in _PARAGRAPHS else block), 1.0
        while up is not None and level <= 9:
            if id(up) not in containers:
                containers[id(up)] = up
                up.points += _PRIOR.get(up.tag, 0.0)
            up.points += points / level
            up, level = up.parent, {1.0: 2.0, 2.0: 6.0}.get(level, level + 3)
    return list(containers.values())


def _final(node: Node) -> float:
    return node.points * (1 - node.linked / max(1, node.size))


def _unlinked(blocks: list[tuple[Node, str, int]]) -> int:
    return sum(len(text) - linked for block, text, linked in blocks if len(text) >= SCORED and block.tag not in _HEADINGS)


def _unmark(order: list[Node], whole: list[tuple[Node, str, int]], left: int) -> bool:
    """Forget the marks of elements that hold nearly all unlinked text of the page."""
    held: dict[int, int] = {}
    for block, text, linked in whole:
        if len(text) >= SCORED and block.tag not in _HEADINGS:
            held[block.enter] = held.get(block.enter, 0) + len(text) - linked
    for node in reversed(order):
        if node.parent and node.enter in held:
            held[node.parent.enter] = held.get(node.parent.enter, 0) + held[node.enter]
    total, found = held.get(0, 0), False
    for node in order:
        mine = held.get(node.enter, 0)
        if node.marked and not node.remarks and 2 * mine > total and mine >= max(OUTWEIGHS * left, PARAGRAPH):
            node.marked, found = False, True
    return found


def _alike(best: Node, other: Node) -> bool:
    """Whether a sibling is of the best container's kind and holds paragraphs of sentences only."""
    return other.tag == best.tag and other.name == best.name and not other.linked and not other.unended


def extract(html: str) -> str:
    """The main text of one page."""
    root = parse(html)
    order = _walk(root)
    if any(n.loosely for n in order):
        _settle_loose(order)
    blocks = _blocks(root, use_marks=True)
    if any(n.marked for n in order) and not any(n.tag in ("article", "main") for n in order):
        whole = _blocks(root, use_marks=False)
        if _unmark(order, whole, _unlinked(blocks)):
            blocks = _blocks(root, use_marks=True)
    blocks = blocks or _blocks(root, use_marks=False)
    if not blocks:
        return ""
    containers = _score(order, blocks)
    if not containers:  # only short blocks: an article or main element, else all there is
        named = [n for n in order if n.tag in ("article", "main") and n.size]
        containers = [max(named, key=lambda n: n.size)] if named else [root]
    best = max(containers, key=lambda n: (_final(n), -n.enter))
    kept = [(best.enter, best.leave)]
    least = max(10.0, 0.2 * _final(best))
    for sibling in best.parent.children if best.parent else []:
        if not isinstance(sibling, Node) or sibling is best or not sibling.size:
            continue
        density = sibling.linked / sibling.size
        reads = sibling.tag in _PARAGRAPHS and density < 0.25 and (sibling.size > 80 or sibling.tag in ("h1", "h2"))
        if reads or sibling.points and _final(sibling) >= least or _alike(best, sibling):
            kept.append((sibling.enter, sibling.leave))
    kept.sort()  # siblings, so the ranges are apart
    starts = [a for a, _ in kept]

    def inside(place: int) -> bool:
        i = bisect_right(starts, place) - 1
        return i >= 0 and place < kept[i][1]

    return " ".join(text for block, text, _ in blocks if inside(block.enter))


EXTRACTED = "text string, n_chars long"


def main_texts(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default all), the main text of each page and its code points."""

    def make():
        def call(pages: list[bytes]) -> dict:
            texts = [extract(p.decode("utf-8", "replace")) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return call

    return map_texts(df, make, EXTRACTED, html, keep)
