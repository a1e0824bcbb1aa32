"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join; a
node with very many neighbours is split by the adaptive skew join. Each round
is written to the shared folder, so that no lineage grows. Nothing is gathered
on the driver but three numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: larger neighbours point to the least neighbour; small: so do the smaller ones and the node."""
    if large:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.toDF("u", "v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has an edge. edges: columns a, b; loops and repeats are allowed.

    Nodes of any ordered type. Null nodes are dropped: they name no node.
    """
    now = table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("x"), F.max("a").alias("m")).first()
        if state.n == 0 or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = state
        after = table(_star(_star(now, True), False), "edges")
        drop_table(now)
        now = after
