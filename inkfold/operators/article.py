"""The article of a page as a whole: one run of blocks, without heading and footer.

The block classifier of :mod:`inkfold.operators.extract` judges each block by its
neighbours.  Here one ordered fold over a page's blocks makes the article of what it found:

1. A short block that starts like the end of a text (copyright, comments, related pages)
   ends the article once enough words stand before it; what follows is left.
2. A block that repeats the title, or a part of it, is the heading: it is no text, and
   what stands before it and after it are different groups.
3. Content blocks with at most ``gap`` other blocks between them are neighbours, one group.
   The group with most unlinked words is the article; of equal ones the first.

The fold keeps numbers only, so a page costs what its blocks cost, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from inkfold.functions.once import compute_once
from inkfold.operators.extract import BlockRules, is_content, page_blocks

# How blocks begin that stand after the text.
END_MARKS = (
    r"(?i)^(?:©|\(c\) |copyright |all rights reserved|comments?$|comments?[ (:]|leave a (?:comment|reply)"
    r"|related (?:articles|posts|stories|news)|read (?:more|next)|share (?:this|on)|more from |tags?:"
    r"|责任编辑|相关阅读|相关新闻|版权所有|免责声明|网友评论)"
)
# What stands between the parts of a title.
TITLE_BORDER = r" [-|»·–—:] |_"


@dataclass(frozen=True)
class ArticleRules:
    end_words: int = 20  # of a block that can be an end mark, at most
    words_before_end: int = 20  # of content that stand before an end mark, at least
    gap: int = 1  # other blocks between neighbours, at most


BODY, HEADING, END, OTHER = "body", "heading", "end", "other"
_NEVER = -(1 << 30)


def _kinds(rules: ArticleRules, block_rules: BlockRules) -> Column:
    """The page's blocks as ``(text, weight, kind)``."""
    title = F.lower("title")
    parts = F.transform(F.split(title, TITLE_BORDER), F.trim)

    def described(block: Column, index: Column) -> Column:
        text = F.lower(block["text"])
        kind = (
            F.when((text == title) | F.array_contains(parts, text), HEADING)
            .when((block["words"] <= rules.end_words) & block["text"].rlike(END_MARKS), END)
            .when(is_content(F.col("blocks"), index, block_rules), BODY)
            .otherwise(OTHER)
        )
        return F.struct(block["text"].alias("text"), (block["words"] - block["link_words"]).alias("weight"), kind.alias("kind"))

    return F.transform("blocks", described)


def _best_group(described: Column, rules: ArticleRules) -> Column:
    """First and last place of the heaviest group, in one fold."""
    number = lambda value: F.lit(value).cast("int")
    start = F.struct(
        number(-1).alias("place"), number(0).alias("words"), F.lit(False).alias("closed"),
        number(0).alias("first"), number(_NEVER).alias("last"), number(0).alias("weight"),
        F.struct(number(0).alias("weight"), number(0).alias("first"), number(-1).alias("last")).alias("best"),
    )

    def step(state: Column, block: Column) -> Column:
        place = state["place"] + 1
        closed = state["closed"] | ((block["kind"] == END) & (state["words"] >= rules.words_before_end))
        body = (block["kind"] == BODY) & ~closed
        near = place - state["last"] <= rules.gap + 1
        first = F.when(body & ~near, place).otherwise(state["first"])
        weight = F.when(~body, state["weight"]).when(near, state["weight"] + block["weight"]).otherwise(block["weight"])
        last = F.when(body, place).when(block["kind"] == HEADING, _NEVER).otherwise(state["last"])
        here = F.struct(weight.alias("weight"), first.alias("first"), place.alias("last"))
        return F.struct(
            place.alias("place"), (state["words"] + F.when(body, block["weight"]).otherwise(0)).alias("words"), closed.alias("closed"),
            first.alias("first"), last.alias("last"), weight.alias("weight"),
            F.when(body & (weight > state["best"]["weight"]), here).otherwise(state["best"]).alias("best"),
        )

    return F.aggregate(described, start, step, lambda state: state["best"])


def main_articles(
    pages: DataFrame, html: str = "html", rules: ArticleRules = ArticleRules(), block_rules: BlockRules = BlockRules()
) -> DataFrame:
    """Replace the HTML column by ``title`` and ``content``: the article, one line per block.

    A page without content has the content ''.  One page is one row from the scan to the result.
    """
    described = page_blocks(pages, html).withColumn("blocks", _kinds(rules, block_rules))
    # Settled between the steps: each is used more than once in the next one.
    described = compute_once(described, "title", "blocks")
    chosen = compute_once(described.withColumn("best", _best_group(F.col("blocks"), rules)), "best")
    inside = F.slice("blocks", F.col("best.first") + 1, F.col("best.last") - F.col("best.first") + 1)
    kept = F.filter(inside, lambda b: b["kind"] == BODY)
    return chosen.withColumn("content", F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).drop("blocks", "best")
