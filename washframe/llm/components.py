"""Connected components of an edge table, by large-star / small-star rounds.

Every round is two grouped aggregations over the edges; each vertex moves to
the least vertex near it. Rounds end when every vertex is either a centre or has
one edge, to a centre (only the number of other vertices reaches the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import forget, store


def _unsettled(edges: DataFrame) -> int:
    """How many vertices of distinct edges (u, v), u > v, have several lesser neighbours, or
    a lesser and a larger one. Without any, the edges are stars around the least vertices."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where(
        "down > 1 OR down > 0 AND up > 0").count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are linked to its least neighbour (or itself): a
    row for every edge at most, which may repeat."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex's smaller neighbours (and itself) are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges (u, v)``; the component is
    its least vertex. Self-loops, repeated edges and nulls are allowed; a vertex
    with no edge to another does not appear."""
    edges = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u <> v").distinct(), "edges")
    while _unsettled(edges):
        nxt = store(_small_star(_large_star(edges)), "edges")
        forget(edges)
        edges = nxt
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()
