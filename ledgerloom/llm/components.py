"""Connected components of a large graph, by alternating large and small stars.

Each round links every node to the smallest node that it or its neighbours know, first along edges to
larger nodes and then to smaller ones; after O(log² n) rounds, in practice a handful, the edges are
stars around the smallest node of each component. Every round is one aggregation and one join over a
table in the shared folder. Hubs are aggregated before the shuffle and their joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (u, v) with u > v."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ends.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    moved = ends.join(least, F.col("u") == F.col("c"))
    if large:  # larger neighbours of the centre move to the least node; the centre keeps its own edge to it
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge, root being the least node reachable.

    ``edges`` has two bigint columns u and v. Loops, repeated and reversed edges do no harm; an empty
    table gives an empty result.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = stage(ordered, "edges"), None
    for _ in range(rounds):
        now = stage(_star(_star(now, large=True), large=False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components not stable after {rounds} rounds")
