"""Connected components of a table of links, by alternating star contractions.

Large-star hangs every larger neighbour of a node on the node's least neighbour,
small-star does so for the smaller ones; both keep connectivity and bring every
component to one star in logarithmically many rounds. Only links are shuffled, each
round is written to the shared folder, and no component is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` has rows (u, v) with u > v, each link once."""
    if small:  # the neighbours of u that are smaller
        towards = edges
    else:  # all neighbours
        towards = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = towards.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = towards.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links ``(u, v)``; root is the component's least node."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # A star forest: no node has two parents, and no parent has one.
        fault = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionByName(now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u"))
        if fault.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = cut(_star(_star(now, small=False), small=True), "links")
    raise RuntimeError("the links did not contract")
