"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import discard, stored


def _least(edges: DataFrame) -> DataFrame:
    """Every node that has neighbours, with the least of itself and them."""
    return edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Do all edges (larger node, smaller node) form stars, each under its least node?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(edges.select("b", F.lit(0)))
    held = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("held"))
    return not held.agg(F.max((F.col("below") > 0) & (F.col("held") > 1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge to another node; edges are (a, b), the label is the component's least node.

    Alternating large-star and small-star steps: every step hangs neighbours
    under the least node they see, by one aggregate that combines on the map side
    and one join without hint, so a node of any degree is no task of its own. Every
    round is a written table. Ends when all edges form stars, which no further round would change.
    """
    # Always the larger node first.
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    while not _stars(edges):
        # Large star: each neighbour above a node goes under the least one that node sees. One row for each edge, so repeats can wait.
        around = _both_ways(edges)
        large = stored(around.join(_least(around), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")), "edges")
        # Small star: a node and what is below it go under the least of them.
        down = large.join(_least(large), "a")
        small = down.select(F.col("b").alias("a"), F.col("least").alias("b")).union(down.select("a", F.col("least").alias("b")))
        after = stored(small.where("a <> b").distinct(), "edges")
        discard(edges, large)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
