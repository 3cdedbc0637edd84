"""Connected components by alternating large-star and small-star steps; every step is one shuffle of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that isn't itself the smallest of its component; edges hold longs.

    A node's smallest neighbour is an aggregate that is joined back (the edges of a star's centre stream past it, and adaptive
    execution may split them), so a centre's edges are never one task's group to hold. Rounds grow
    with the logarithm of the nodes; if the edges still change after `rounds`, that is an error."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        seen = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (seen["n"], seen["h"]) == state or not seen["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (seen["n"], seen["h"])
        # Large star: larger neighbours go to the smallest of a node's neighbourhood. A node that is its neighbourhood's smallest keeps its own.
        lower = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = e.join(lower, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components: not settled after {rounds} rounds")
