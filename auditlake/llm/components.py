"""Connected components by alternating large and small stars, all in joins and combined aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver


def _are_stars(edges: DataFrame) -> bool:
    """True when every node has one edge up, or only edges down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, over: HandOver, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of the component.

    A large star hangs each node's larger neighbours on its smallest one, a small
    star the smaller neighbours; repeated until all components are stars, each node points at
    its root.  Minima are combined before they move; the joins are plain shuffles
    that adaptive execution splits at a hub.
    """
    edges = over.settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-0")
    turn = 0
    while not _are_stars(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = over.settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large{turn}")
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = over.settle(large, f"{name}-stars{turn}")
        lowest = over.settle(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small{turn}")
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = over.settle(small.filter("u != v").distinct(), f"{name}-{turn + 1}")
        for old in (f"{name}-{turn}", f"{name}-large{turn}", f"{name}-stars{turn}", f"{name}-small{turn}"):
            over.drop(old)
        edges, turn = after, turn + 1
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
