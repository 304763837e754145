"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.sources.scratch import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Large-star and small-star steps in turn: nodes are linked to the smallest node around them,
    until only stars are left. The number of rows never exceeds that of the links, and rounds
    grow with the logarithm of their number. Each round is stored.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = store(links.where("a <> b").select(*ends).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(edges.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return store(stars.unionByName(centres.join(stars, "node", "left_anti")))
