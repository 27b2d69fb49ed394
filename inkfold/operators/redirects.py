"""Which page an address ends at, when pages answer under other addresses than the asked ones.

Redirects are rows ``(asked, target)``; an address may lead on over any number of them.
They are followed by pointer jumping: each round joins the table with itself and doubles
how far every address has been followed, so a chain of a million hops takes 20 rounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from inkfold.session import drop_landed, land


class Followed(NamedTuple):
    resolved: DataFrame  #: (url, final, hops)
    rejects: DataFrame  #: (stage, reason, payload) of addresses that lead into a loop


def one_target(redirects: DataFrame, newest: str | None = None) -> DataFrame:
    """One target an address: that with the largest ``newest``, of equal ones the largest.

    Rows without an address or a target are no redirects.
    """
    rows = redirects.filter(F.col("asked").isNotNull() & F.col("target").isNotNull())
    order: list[Column] = [F.col(newest)] if newest else []
    best = F.max(F.struct(*order, F.col("target").alias("target"))).alias("best")
    return rows.groupBy(F.col("asked").alias("url")).agg(best).select("url", F.col("best.target").alias("final"))


def follow_redirects(redirects: DataFrame, newest: str | None = None) -> Followed:
    """Where each redirected address ends, and in how many hops.

    An address that leads into a loop never ends: it goes to the rejects.  While an address
    with an end is open, every round brings some to theirs (those next to the resolved part
    of its chain), so a round that resolves none has only loops left.

    Each round is written to the shared folder, and a target of very many addresses is the
    many side of a join with one row a key, which Spark can split.
    """
    state = land(one_target(redirects, newest).select("url", "final", F.lit(1).cast("bigint").alias("hops"), F.lit(True).alias("open")), "redirects")
    waiting = None
    while True:
        ahead = state.select(F.col("url").alias("final"), F.col("final").alias("further"), F.col("hops").alias("more"))
        moved = state.join(ahead, "final", "left").select(
            "url",
            F.coalesce("further", "final").alias("final"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("further").isNotNull().alias("open"),
        )
        after = land(moved, "redirects")
        drop_landed(state)
        state = after
        open_now = state.filter("open").count()
        if open_now in (0, waiting):
            break
        waiting = open_now
    loops = state.filter("open").select(F.lit("enrich").alias("stage"), F.lit("redirect loop").alias("reason"), F.col("url").alias("payload"))
    return Followed(state.filter("not open").select("url", "final", "hops"), loops)


def at_final_address(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries under the address where their page answers; ``asked`` keeps the listed one."""
    found = entries.join(resolved.select("url", "final"), "url", "left")
    others = [c for c in entries.columns if c != "url"]
    return found.select(*others, F.col("url").alias("asked"), F.coalesce("final", "url").alias("url"))
