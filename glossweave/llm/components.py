"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.scratch import discard, materialise


def _star(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _stars(e: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or one on each side."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long, in any order).  Returns node, component (the smallest id reachable) of all nodes but those smallest ones.

    Each round points every larger neighbour at the smallest one (large star), then every smaller
    neighbour and the node itself (small star); the number of rounds grows with the logarithm of
    the longest chain.  Minima are partial aggregates, so a node with very many links is no hot spot.
    The rounds end when every node has one smaller neighbour and none points at it: all are stars then.
    """
    e = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_star(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
            .select("x.*")
            .where("a <> b")
            .distinct()
        )
        before_e, e = e, materialise(small, "cc")
        discard(before_e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
