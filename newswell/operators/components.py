"""Connected components of an edge table, as joins and aggregations over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.storage import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node of an edge; ``component`` is the least node that its edges reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step
    points nodes at the least of their neighbours, found by an aggregation that Spark
    combines before the shuffle, so a hub with many neighbours is no single group.
    Each round is stored. It ends when the edges are stars: each node points at one
    other, and none that is pointed at points on; edges that are stars need no round.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = stored(edges, "cc")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(edges, "cc")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two greater or lesser ends to follow."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 OR (out = 1 AND into = 1)").limit(1).count() == 0
