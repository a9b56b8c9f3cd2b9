"""Connected components by alternating stars: every node ends with a link to the smallest node it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingflow.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of a node link to its smallest neighbour or itself. Small star: the others and itself do."""
    seen = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        moved = seen.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge other than to itself.

    ``edges`` has long columns a and b. Each round is two groupings and two joins on a node; links of a node with very many
    neighbours are reduced to one minimum per node before they meet them. It ends when a round changes nothing.
    """
    edges = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while before[0]:
        edges = cut_lineage(_star(_star(edges, True), False))
        now = _signature(edges)
        if now == before:
            break
        before = now
    # At the fixpoint every edge is (node, smallest node of its component).
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
