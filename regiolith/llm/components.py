"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import checkpointed

MOST_ROUNDS = 40
#: Edges up to which a graph stays in one partition; more are dealt by their nodes.
FEW_EDGES = 10_000


def large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.coalesce(1) if few else both
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.coalesce(1) if few else out
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Each round halves the depth at least; it ends when the stars no longer change, which two sums tell. Stars never outnumber
    the edges and their nodes, so a graph of few edges, which are counted, goes through all rounds in one partition: a round is
    one task then, and not a handful of shuffles of nearly empty partitions with their files."""
    stars = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    few = stars.count() <= FEW_EDGES
    stars = stars.coalesce(1) if few else stars
    before = None
    for _ in range(MOST_ROUNDS):
        stars = checkpointed(small_star(large_star(stars, few), few))
        now = stars.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = stars.coalesce(1) if few else stars
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)
