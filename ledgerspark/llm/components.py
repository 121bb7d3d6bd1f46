"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so neither a hub with very many neighbours nor a large
component is ever gathered in one task. Tables between steps are written to the shared folder. The steps end when one
changes nothing, after about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame, least) -> DataFrame:
    """(k, m) for each a. The key is no longer what the sums were grouped by, so a join deals both sides anew and can split a hub."""
    return edges.groupBy("a").agg(least.alias("m")).select((F.col("a") + 0).alias("k"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, F.least(F.min("b"), F.first("a")))
    return both.join(least, F.col("a") == F.col("k")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of each node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, F.min("b"))
    moved = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.toDF("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): (node, component), component the smallest node reachable; nodes without edges aren't in it."""
    edges, before = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges"), None
    while True:
        edges = stored(_small_star(_large_star(edges).distinct()).filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
