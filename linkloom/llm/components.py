"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node reachable, for every node of edges (a, b).

    Each round points a node's larger neighbours, then its smaller ones, at
    the least of its neighbourhood.  Both are an aggregate that combines before
    its shuffle and a join that adaptive execution splits at crowded nodes, so
    no neighbourhood is gathered in one place."""
    state = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.col("k")).alias("m"))
        if large:  # neighbours above a node
            pairs = e.join(least, e["a"] == least["k"]).select(F.col("m").alias("a"), "b")
        else:  # neighbours below it, and itself
            down = e.select(F.col("b").alias("k"), F.col("a").alias("x"))
            low = down.groupBy("k").agg(F.min("x").alias("m"))
            pairs = down.join(low, "k").select(F.col("m").alias("a"), F.col("x").alias("b")).union(low.select(F.col("m"), F.col("k")))
        return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = sign(state)
    while True:  # every round but the last joins nodes to lesser ones
        after = cut(star(star(state, True), False), "cc")
        now = sign(after)
        if now == before:
            drop(state)
            # stars: every node points at the least of its component
            out = after.select(F.col("b").alias("node"), F.col("a").alias("comp"))
            return out.union(after.select(F.col("a"), F.col("a")).distinct())
        drop(state)
        state, before = after, now
