"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any comparable type -> (node, root), root the smallest node that is reachable.

    Each round points every node's larger neighbours at its smallest neighbour, then every node at the smallest
    of its smaller neighbours, until nothing changes. Minima are pre-aggregated, joins are splittable, every round
    is a written table, and so are the minima before they are joined, so that a node of very many links is split.
    Isolated nodes do not appear; empty input gives no rows; loops and repeats are ignored.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(edges.where(F.col("u") != F.col("v")).select(high, low).distinct(), "links")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = written(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        nearest = written(large.groupBy("u").agg(F.min("v").alias("m")), "nearest")
        small = (large.join(nearest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(nearest.select("u", F.col("m").alias("v"))).distinct())
        now = written(small, "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
