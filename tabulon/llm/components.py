"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours about the smallest node it knows."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(id, component): for every node of an edge, the smallest id it is connected with.

    Alternating large and small stars: each round at least about halves the distance to the smallest
    node, and neighbours are only ever aggregated or joined, never gathered. Each round is written to
    the shared folder; the loop ends when a round changes nothing. Edges with a null end and loops
    are left out.
    """
    pairs = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b"))
    current, mark = stored(pairs.where("a <> b").distinct(), "edges"), None
    while True:
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        current = stored(_small_star(_large_star(current).distinct()).distinct(), "edges")
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
