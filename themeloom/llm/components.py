"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import stage


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges."""
    whole = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root")))
    return tuple(whole.head())


def components(links: DataFrame) -> DataFrame:
    """For every node of ``links`` (a, b) the smallest node it reaches: node, root.

    Each round hangs larger neighbours on a node's smallest neighbour (large star), then smaller ones
    (small star). Minima come from map-side aggregates, so a hub is one row per task; rounds grow with
    the logarithm of the longest path. Each round is written to shared storage, which cuts the
    lineage. Nulls, self links and repeated links are ignored.
    """
    edges = stage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct()
    )
    state = _state(edges)
    while True:
        both = edges.select("node", "root").union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.filter(F.col("root") > F.col("node")).join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        large = stage(large)
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        joined = large.join(least, "node")
        small = joined.filter(F.col("root") != F.col("low")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges = stage(small.union(least.select("node", F.col("low").alias("root"))).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    # The roots themselves are nodes of their components too.
    return edges.union(edges.select("root", "root").distinct())
