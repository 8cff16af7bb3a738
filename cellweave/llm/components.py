"""Distributed connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One round. Every step first takes a minimum per node (combined map-side), then joins one row per node to the edges."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    # now a > b in every edge
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (columns a, b): the smallest node it reaches. Nulls and loops are no edges.

    Each round is written to shared storage; the number of rounds grows with the logarithm of the longest path.
    """
    kind = edges.schema["a"].dataType
    edges = stored(edges.select("a", F.col("b").cast(kind).alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _state(edges)
    while now[0] and now != before:
        edges = stored(_stars(edges), rows=2 * int(now[0]))  # each edge gives two at most
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
