"""Connected components by alternating large-star and small-star, on edges as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_least(edges: DataFrame) -> DataFrame:
    """Of edges (u, v): each with the least of u and all its v. Sums per u first, so a hot u is a split join only."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").withColumn("m", F.least("u", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's greater neighbours to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _to_least(down).select("u", "v", "m")
    return least.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(links: DataFrame, name: str = "edges", most: int = 60) -> DataFrame:
    """links(u, v) -> (node, component): each linked node with the least node it reaches. Nulls link nothing."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
    edges = cut(links.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = state(edges)
    for _ in range(most):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges)).distinct(), name)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
