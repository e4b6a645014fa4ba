"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its least neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them; links go from the larger to the smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(keep: Scratch, links: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, component): the least node of each linked node's component; links (a, b) in either direction.

    Each round is two groupings with map-side combination; rounds grow with the
    logarithm of the longest path.  Every round is a written table, so lineage
    stays short, and no link reaches the driver: it gets a count and a sum.
    """
    e = keep.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0")
    was = None
    for i in range(1, most):
        e = keep.table(_small(_large(e)), f"{name}_{i}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if i > 1:
            keep.drop(f"{name}_{i - 1}")
        if now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was = now
    raise RuntimeError(f"components did not settle in {most} rounds")
