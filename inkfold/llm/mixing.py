"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power `alpha`, normalised: 1 keeps the
shares, 0 makes sources equal.  The exponent is bisected until the weights have the
target entropy, or until no source is repeated more often than the limit allows.

The weights are realised as block permutations under a budget of tokens.  For each pass over
a source its documents are dealt to blocks anew, by a hash of the seed, the pass and the id;
the blocks stand in the order of their numbers, the documents of a block in the order of the
hash.  A source with the budget of 2.3 of its tokens gives two whole passes and the first
0.3 of a third.  Without a given budget it is the smallest at which every source is used once
in whole, so no document is lost and small sources are repeated.

A row's block and its position in the pass are given as columns, or the rows are sorted: all
sources advance together, each a block at a time, so that a long stretch holds them in the
mixture's weights.

Sources are counted by an aggregate (a row each on the driver), blocks by another.  A hot
source is spread over its blocks: rows are ranked within a block, and the blocks' row counts
are added up, so no window holds the rows of a source.

Defined cases: a null source is a source of its own; null and empty texts have no tokens,
are in every whole pass and, in a part of a pass, if they stand before the cut; if no
source has tokens every document is given once; repeated rows are dealt like others; an
empty table gives an empty table; rows of one id stand in one block; other columns stay unless
they have the name of a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Mixture:
    """Give `entropy` (nats) or `repetition` (most passes over a source), not both."""

    repetition: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None  # tokens; None: every source once in whole at least
    block: int = 2048  # documents of a block, about
    seed: int = 11


def words(text: Column) -> Column:
    """The measure of a text unless another is given: its words."""
    return F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")), " +")).cast("long") - F.when(
        F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")) == "", 1).otherwise(0)


def weights(shares: list[float], alpha: float) -> list[float]:
    powers = [s**alpha if s > 0 else 0.0 for s in shares]
    total = sum(powers)
    return [p / total for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def passes(tokens: list[int], w: list[float], budget: int | None) -> list[float]:
    """How often each source is gone through; without a budget, the least often exactly once."""
    ratio = [x / t if t else 0.0 for x, t in zip(w, tokens, strict=True)]
    scale = budget if budget is not None else 1 / min(r for r in ratio if r > 0)
    return [r * scale for r in ratio]


def exponent(tokens: list[int], how: Mixture) -> float:
    """The exponent from 0 to 1 that meets the target; the end of the range if none does."""
    shares = [t / sum(tokens) for t in tokens]

    def flat_enough(alpha: float) -> bool:
        w = weights(shares, alpha)
        if how.entropy is not None:
            return entropy(w) >= how.entropy
        return max(passes(tokens, w, how.budget)) > (how.repetition or math.inf)

    low, high = 0.0, 1.0  # flat enough at low, not at high
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return low if how.entropy is not None else high


@dataclass(frozen=True)
class Plan:
    """Of each source its tokens, documents, weight and passes."""

    alpha: float
    sources: list[tuple[str | None, int, int, float, float]]


def plan(df: DataFrame, how: Mixture, source: str = "source", tokens: Column | None = None) -> Plan:
    measure = words(F.col("text")) if tokens is None else tokens
    counts = df.select(F.col(f"`{source}`").alias("s"), measure.alias("t")).groupBy("s").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = sorted(((r["s"], r["t"] or 0, r["n"]) for r in counts.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    sizes = [r[1] for r in rows]
    if not sum(sizes):
        return Plan(1.0, [(s, t, n, 1 / max(1, len(rows)), 1.0) for s, t, n in rows])
    alpha = exponent(sizes, how)
    w = weights([t / sum(sizes) for t in sizes], alpha)
    times = passes(sizes, w, how.budget)
    # A source without tokens takes no budget: one pass.
    return Plan(alpha, [(s, t, n, x, p if t else 1.0) for (s, t, n), x, p in zip(rows, w, times, strict=True)])


def mix(
    df: DataFrame,
    how: Mixture = Mixture(),
    source: str = "source",
    id_col: str = "doc_id",
    tokens: Column | None = None,
    places: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """The rows of `df` as often as the mixture takes them, with `pass_number` (from 0); with
    `places` also `block` and `position`, the place in the pass over the source (from 0); if
    `ordered`, sorted as they follow each other in the mixture."""
    spark = df.sparkSession
    made = plan(df, how, source, tokens)
    measure = words(F.col("text")) if tokens is None else tokens
    fields = "mix_number int, mix_source string, whole int, rest long, blocks int, mix_times double"
    rows = []
    for i, (s, t, n, _, p) in enumerate(made.sources):
        # Rounding must not turn one whole pass into a pass less a document.
        whole = int(math.floor(p + 1e-9))
        rows.append((i, None if s is None else str(s), whole, max(0, int(round((p - whole) * t))), max(1, math.ceil(n / how.block)), p))
    by_source = F.broadcast(spark.createDataFrame(rows, fields))  # a row for each source
    results = ["pass_number", *(["block", "position"] if places else [])]
    kept = [c for c in df.columns if c.lower() not in results]
    base = df.select(*kept, measure.alias("mix_tokens")).join(by_source, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("mix_source")))

    def deal(rows: DataFrame, pass_number: Column) -> DataFrame:
        order = F.xxhash64(F.lit(how.seed), "mix_pass", F.col(f"`{id_col}`").cast("string"))  # another for each pass
        rows = rows.withColumn("mix_pass", pass_number).withColumn("mix_order", order)
        return rows.withColumn("mix_block", F.pmod(F.xxhash64(F.lit(how.seed + 1), "mix_order"), F.col("blocks")))

    last = F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)
    dealt = deal(base, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    # The pass that the budget cuts: blocks before the cut, and of the cut block the first rows.
    sizes = deal(base.filter(F.col("rest") > 0), F.col("whole")).groupBy("mix_number", "mix_block", "rest").agg(F.sum("mix_tokens").alias("size"))
    before = F.sum("size").over(Window.partitionBy("mix_number").orderBy("mix_block")) - F.col("size")
    sizes = sizes.withColumn("before", before).filter(F.col("before") < F.col("rest"))
    cut = F.struct(F.col("mix_block").alias("block"), "before", (F.col("before") + F.col("size") > F.col("rest")).alias("inside"))
    cuts = F.broadcast(sizes.groupBy(F.col("mix_number").alias("mix_at_number")).agg(F.max(cut).alias("mix_at")))  # a row for each source
    taken = dealt.join(cuts, F.col("mix_number") == F.col("mix_at_number"), "left")
    whole_pass = F.col("mix_pass") < F.col("whole")
    taken = taken.filter(whole_pass | (F.col("mix_block") <= F.col("mix_at.block")))
    taken = taken.withColumn("mix_cut", F.coalesce(~whole_pass & (F.col("mix_block") == F.col("mix_at.block")) & F.col("mix_at.inside"), F.lit(False)))
    key = ["mix_number", "mix_pass", "mix_block"]
    in_block = Window.partitionBy(*key).orderBy("mix_order", F.col(f"`{id_col}`"))
    upto = F.col("mix_at.before") + F.sum("mix_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if places:
        out = taken.withColumn("mix_upto", upto).withColumn("mix_rank", F.row_number().over(in_block)).filter(~F.col("mix_cut") | (F.col("mix_upto") <= F.col("rest")))
        counts = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        first = F.sum("n").over(Window.partitionBy("mix_number", "mix_pass").orderBy("mix_block")) - F.col("n")
        out = out.join(counts.select(*key, first.alias("mix_first")), key)
    else:  # only the cut blocks are looked at row by row
        inside = taken.filter("mix_cut").withColumn("mix_upto", upto).filter(F.col("mix_upto") <= F.col("rest")).drop("mix_upto")
        out = taken.filter(~F.col("mix_cut")).unionByName(inside)
    if ordered:
        # How much of its source's share lies before the block.
        turn = (F.col("mix_pass") + F.col("mix_block") / F.col("blocks")) / F.col("mix_times")
        out = out.orderBy(turn, F.xxhash64(F.lit(how.seed + 2), *key), "mix_order", F.col(f"`{id_col}`"))
    numbers = [F.col("mix_pass").alias("pass_number")]
    if places:
        numbers += [F.col("mix_block").alias("block"), (F.col("mix_first") + F.col("mix_rank") - 1).alias("position")]
    return out.select(*kept, *numbers)
