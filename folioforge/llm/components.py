"""Connected components of an edge table, in alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core


def connected(edges: DataFrame, limit: int = 60) -> DataFrame:
    """edges (u, v) -> (node, component): the least node reachable, for all nodes with an edge.

    Large-star links every greater neighbour of a node to the node's least neighbour, small-star
    the lesser ones; both are joins on keys, with partial aggregation, and no
    neighbourhood is gathered.  The number of rounds grows as the logarithm of the diameter.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = core.materialise(e)
    mark, at = None, len(core.made())
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        e = core.materialise(small)
        core.release(at - 1, at)  # the table of the round before has been read for the last time
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label (as of connected) with further edges: only what they join is followed, between components."""
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    rows = edges.join(name("u"), "u", "left").join(name("v"), "v", "left").select("u", "v", F.coalesce("u_of", "u").alias("a"), F.coalesce("v_of", "v").alias("b"))
    rows = core.materialise(rows)
    up = connected(rows.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
    met = rows.select(F.col("u").alias("node"), F.col("a").alias("component")).unionByName(rows.select(F.col("v").alias("node"), F.col("b").alias("component"))).distinct()
    nodes = label.unionByName(met.join(label.select("node"), "node", "left_anti"))
    return core.materialise(nodes.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
