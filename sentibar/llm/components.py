"""Connected components of an edge table by alternating star contraction.

Each round replaces edges by edges to the smallest known neighbour (large
star, then small star) until every component is a star around its smallest
node.  A round is two pre-aggregated minimums and two joins; rounds grow with
the logarithm of the component size.  Each round is checkpointed in the
shared folder, so the lineage stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, component)`` with the
    smallest id of each component, for every node of an edge that joins two
    different ids.  An empty edge table gives an empty result."""
    now = saved(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        now = saved(small_star(large_star(now)), "edges")
    return (now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
            .unionByName(now.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("component")))
            .distinct())
