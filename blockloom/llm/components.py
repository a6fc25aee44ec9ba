"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is one aggregation, with map-side partial sums, and one join in which vertices of very many edges don't leave
their tasks (common.spread_join), so no vertex holds up a step. Both steps' edges are written to the shared checkpoint
folder, and those before them deleted; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, spread_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node reachable, for every node that has an edge to another one. Nulls have no edges."""
    x, y = F.col(a), F.col(b)
    e = durable(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while total := e.count():
        # large star: each neighbour w above u goes to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        above = e.select(F.col("v").alias("u"), F.col("u").alias("w"))
        big = durable(spread_join(above, least, ["u"], total).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its neighbours below go to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        below = spread_join(big, low, ["u"], big.count()).where("v != m")
        old, e = e, durable(below.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old, big)
        # at rest every node has one edge, to a node that has none of its own downwards
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
