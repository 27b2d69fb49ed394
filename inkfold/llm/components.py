"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkfold.llm.landing import Landing


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down, and none down to a node that has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    of_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    other = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))
    return not of_node.agg(F.max(other)).first()[0]


def connected_components(links: DataFrame, landing: Landing) -> DataFrame:
    """(id, component) of every node that has a link in (u, v); component is the smallest id.

    Links go from larger to smaller ids, so that once they are stars, the smallest id of each
    component is its centre.  Aggregates are combined before the shuffle, and the joins have
    one row a node on one side, so that Spark can split a node with very many links.  Each
    round is written to the shared folder; the one before is deleted.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = landing.land(ordered.filter(F.col("u") != F.col("v")).distinct())
    while not _stars(edges):
        large = landing.land(_large(edges))
        small = landing.land(_small(large))
        landing.drop(edges, large)
        edges = small
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
