"""Key-value states held in tables: writes and scans, and verdicts on the history of a run over several nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(writes: DataFrame, order: str) -> DataFrame:
    """(node, key, value) after all writes (node, key, value, `order`): the last write of a key on a node counts, null values too."""
    return writes.groupBy("node", "key").agg(F.max_by(F.struct("value"), order).alias("_v")).select("node", "key", "_v.value")


def read_key(states: DataFrame, node: object, key: object) -> DataFrame:
    """(value) of one key on one node; no row where it was never written."""
    return states.filter((F.col("node") == F.lit(node)) & (F.col("key") == F.lit(key))).select("value")


def scan(states: DataFrame, node: object) -> DataFrame:
    """(key, value) of a node."""
    return states.filter(F.col("node") == F.lit(node)).select("key", "value")


def agreement(states: DataFrame) -> DataFrame:
    """(a, b, same) for each pair of nodes: whether both hold the same keys with the same values; two nulls are the same value.

    Nodes are few; a node that holds nothing isn't seen; keys aren't null. The join on the key meets one row of each node, so no key is hot.
    """
    sizes = states.groupBy("node").agg(F.count("*").alias("n"))
    a, b = states.select(F.col("node").alias("a"), "key", F.col("value").alias("_x")), states.select(F.col("node").alias("b"), "key", F.col("value").alias("_y"))
    met = a.join(b, "key").filter((F.col("a") < F.col("b")) & F.col("_x").eqNullSafe(F.col("_y"))).groupBy("a", "b").agg(F.count("*").alias("met"))
    left, right = sizes.select(F.col("node").alias("a"), F.col("n").alias("_n")), sizes.select(F.col("node").alias("b"), F.col("n").alias("_m"))
    met = left.join(right, F.col("a") < F.col("b")).join(met, ["a", "b"], "left")  # pairs of nodes, not of rows
    return met.select("a", "b", ((F.col("_n") == F.col("_m")) & (F.coalesce("met", F.lit(0)) == F.col("_n"))).alias("same"))


def all_hold(condition: Column) -> Column:
    """Aggregate: no row breaks the condition; true without rows, a null condition breaks it."""
    return F.coalesce(F.every(F.coalesce(condition, F.lit(False))), F.lit(True))


def verdicts(reads: DataFrame, states: DataFrame, partitions: DataFrame) -> DataFrame:
    """(verdict, holds): available (no read of the history gave null), consistent (all nodes agree), tolerant (every partition of the history has
    disconnected, reconnected and success_during)."""
    available = reads.agg(all_hold(F.col("value").isNotNull()).alias("holds")).select(F.lit("available").alias("verdict"), "holds")
    consistent = agreement(states).agg(all_hold(F.col("same")).alias("holds")).select(F.lit("consistent").alias("verdict"), "holds")
    clean = F.col("disconnected") & F.col("reconnected") & F.col("success_during")
    return available.unionAll(consistent).unionAll(partitions.agg(all_hold(clean).alias("holds")).select(F.lit("tolerant").alias("verdict"), "holds"))
