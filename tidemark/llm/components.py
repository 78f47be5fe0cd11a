"""Connected components by alternating star contraction, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); ``root`` is the least node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least of
    them.  A round moves one row per edge; minima are combined before they are moved and
    written before they are joined, so that Spark can split the join of a node with very many
    neighbours.  Each round ends in a written table, so a lost executor costs one round at most.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = shared.materialise(pairs, "edges")
    for _ in range(most_rounds):
        # done when no node hangs on another and is hung on itself: then each edge leads to its component's least node
        if pairs.select(F.col("b").alias("a")).join(pairs.select("a"), "a", "left_semi").isEmpty() and _hang_once(pairs):
            break
        # large star: every larger neighbour of a node hangs on the least of its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = shared.materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = shared.materialise(large.distinct(), "large-stars")
        # small star: every smaller neighbour, and the node itself, hang on the least
        least = shared.materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = shared.materialise(small.where("a <> b").distinct(), "edges")
        for table in (pairs, first, large, least):
            shared.drop_table(table)
        pairs = new
    else:
        raise RuntimeError("components did not converge")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _hang_once(pairs: DataFrame) -> bool:
    return pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
