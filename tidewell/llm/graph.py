"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the edges (long columns a and b).

    Alternating large-star and small-star steps; every one joins each neighbour with the least of
    a node's neighbourhood, found by a partial aggregate, so a hub's edges never meet in one group.
    Each round is cut in the shared folder. Rounds go on until one changes nothing: every edge then
    leads to its component's least id. Their number grows with the logarithm of the nodes."""
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: the smaller neighbours of u, and u, hang on the least of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        old, e = e, cut(small.unionAll(down.select(F.col("m").alias("a"), "b")).where("a <> b").distinct())
        drop(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    # Every edge now leads to its component's least id.
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
