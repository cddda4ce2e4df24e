"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges (u > v) are stars: no node has two nodes below it, and none lies between two."""
    lower = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    upper = edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    nodes = lower.unionByName(upper).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.filter("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame, max_steps: int = 100) -> DataFrame:
    """edges (u, v: long or string) -> one row (node, root) for each node of an edge; root is the smallest node that
    can be reached. Edges with a null end or u = v are ignored; repeated edges are harmless; no edges give no rows.

    Each step is two minimum aggregations and two joins on the node, so a hub is pre-aggregated before the shuffle and
    its join partition can be split; neighbour lists are never collected. The edges of each step are written as a table, so small
    ones are read in few tasks, and the steps end as soon as all edges are stars."""
    e = scratch(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_steps):
        if _settled(e):
            break
        # Large star: what is above a node moves to the smallest node below it, if there is one.
        low = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = e.join(low, F.col("v") == F.col("node"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: u and its lower neighbours meet at the lowest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("p"))
        e = scratch(pairs.select(F.col("p.u").alias("u"), F.col("p.m").alias("v")).filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
