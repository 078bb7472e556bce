"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch


def components(edges: DataFrame, scratch: Scratch, at_most: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.
    Rounds go on until none changes an edge; their number grows with the
    logarithm of the nodes.

    ``edges`` has u and v (long), in any direction. Each round is two
    aggregations with partial aggregation and two joins; hot nodes are joined,
    never collected. The tables of finished rounds are dropped. ``at_most``: a
    bound of the number of edges, if known."""
    def canon(e):
        return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = scratch.table(canon(edges), rows=at_most)
    seen, size = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = canon(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = scratch.table(canon(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))), rows=2 * size)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == seen:
            break
        seen, size = mark, mark[0]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return scratch.table(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), rows=2 * size)
