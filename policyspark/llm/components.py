"""Connected components of an edge table by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyspark.llm.spread import joined_spread
from policyspark.llm.words import written


def _met(edges: DataFrame, least: DataFrame, spread: bool) -> DataFrame:
    return joined_spread(edges, "a", least, "b") if spread else edges.join(least, "a")


def _large_star(edges: DataFrame, spread: bool = False) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _met(both.where("b > a"), least, spread).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, spread: bool = False) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = _met(edges, least, spread).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least).toDF("a", "b").distinct()


def components(edges: DataFrame, spread: bool = False) -> DataFrame:
    """(node, root) for every node with an edge: root is the smallest node of its component.

    :param edges: two columns a and b of a type with an order; loops and repeats do no harm. The
        nodes of a component hang off its root in the end, and a root may hold
        any share of them: minima are combined before the shuffle, and the
        joins are plain equi joins, which adaptive execution splits; with
        ``spread`` the edges of a node are dealt into parts first. Every
        round is written to the checkpoint folder; there are O(log n) of them
        in practice.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "edges")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if seen == state or seen[0] == 0:
            return edges.toDF("node", "root")
        state = seen
        edges = written(_small_star(_large_star(edges, spread), spread), "edges")
