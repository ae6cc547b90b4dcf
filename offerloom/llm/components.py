"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, small

#: One row per node is broadcast up to so many nodes; beyond, nodes of a higher degree than HUB go by broadcast and the others by shuffle.
NODES_BROADCAST, HUB = 1_000_000, 100_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with the column m of least (a, degree, m). A star's edges never meet in one task for it."""
    if small(least, NODES_BROADCAST):
        return edges.join(F.broadcast(least.drop("degree")), "a")
    hubs = broadcast_if(least.where(F.col("degree") > HUB).drop("degree"), NODES_BROADCAST)
    return edges.join(hubs, "a").unionByName(edges.join(hubs, "a", "left_anti").join(least.drop("degree"), "a"))


def _step(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the node's smallest one. Small star: so are the smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = F.count(F.lit(1)).alias("degree")
    least = scratch.save(both.groupBy("a").agg(count, F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-least")
    large = _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = scratch.save(large.groupBy("a").agg(count, F.min("b").alias("m")), f"{label}-down")
    near = _with_least(large, down).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("root").alias("root")).where("up > 1 OR (up = 1 AND root > 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """links: a, b. Returns node, component (the smallest node reachable) for every node that has a link. Links may repeat."""
    edges, step = links.select("a", "b").where("a <> b"), 0
    while True:
        edges = scratch.save(_step(edges, scratch, f"{label}-{step}"), f"{label}-{step}")
        if _is_forest_of_stars(edges):
            break
        step += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
