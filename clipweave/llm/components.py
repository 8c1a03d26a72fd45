"""Connected components of an edge table by alternating star contractions, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of ``edges`` (a, b); roots
    too. Hubs only meet sums and minima that combine before the shuffle, and joins that may be split."""
    e = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        e = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # small star: a node's smaller neighbours and the node itself are tied to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        tied = e.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = kept(tied.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
