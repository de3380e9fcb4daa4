"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwarden.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that occurs in a link; label is the smallest node of its component.

    Each round is two grouped minima and two joins on a node; Spark can split a join at a hot node. The number of
    rounds grows with the logarithm of the component size. Links of a node with itself and repeated links are allowed.
    """
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or to u)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, is linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = cut_lineage(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                            .union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
