"""Cluster micro-benchmarks: memory, processor, disk and network, each as the query that it times, and a weighted score."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Figures that count as a score of 1.
NORMAL = {"cpu": 0.06, "mem": 5.0, "disk": 6.0, "network": 0.05}


def wide_range(spark: SparkSession, rows: int) -> DataFrame:
    padded = [F.lpad(F.col("id").cast("string"), n, "0").alias(name) for name, n in (("payload", 20), ("payload2", 15))]
    return spark.range(0, rows, numPartitions=8).select("id", (F.col("id") % 100).cast("int").alias("group_id"), *padded)


def memory(spark: SparkSession, rows: int = 1_000_000) -> DataFrame:
    """(action, n): rows, rows of the upper half of groups, groups, and rows after a repartition by group, all from one cached table."""
    held = wide_range(spark, rows).persist(StorageLevel.MEMORY_ONLY)
    try:
        figures = [
            ("rows", held.count()),
            ("filtered", held.filter("group_id >= 50").count()),
            ("groups", held.groupBy("group_id").agg(F.count("*").alias("cnt")).count()),
            ("repartitioned", held.repartition(16, "group_id").count()),
        ]
    finally:
        held.unpersist()
    return spark.createDataFrame(figures, "action string, n long")


def cpu(spark: SparkSession, rows: int = 500_000) -> DataFrame:
    base = spark.range(0, rows, numPartitions=8).select(F.col("id").cast("double").alias("x"), F.rand(42).alias("y"), (F.col("id") % 1000).cast("double").alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    first = F.sqrt(x + 1) * F.sin(y * 100) * F.cos(z / 50) + F.sin(x / 10) * F.cos(y * 5) + F.sqrt(y + 2) * F.sin(z / 20)
    second = F.cos(x / 25) * F.sqrt(y + 1) + F.sin(z * 3) * F.cos(x * 0.1)
    out = base.select(first.alias("a"), second.alias("b")).agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.avg("a").alias("avg_a"), F.avg("b").alias("avg_b"))
    return out.withColumn("score", F.abs(F.col("sum_a") + F.col("sum_b")) / (2 * rows))


def disk(spark: SparkSession, rows: int = 500_000) -> DataFrame:
    payload = F.concat_ws("-", *(F.lpad((F.col("id") * k).cast("string"), 30, "0") for k in range(1, 6)))
    base = spark.range(0, rows, numPartitions=8).select("id", (F.col("id") % 100).alias("group_key"), payload.alias("payload"), F.rand(42).alias("value"))
    out = base.repartition(50, "group_key").groupBy("group_key").agg(F.sum(F.length("payload")).alias("total_len"), F.sum("value").alias("total_value"), F.count("*").alias("row_count"))
    return out.orderBy(F.col("total_len").desc(), "group_key")


def network(spark: SparkSession, rows: int = 500_000) -> DataFrame:
    base = spark.range(0, rows, numPartitions=8).select("id", (F.col("id") % 10).alias("key1"), (F.col("id") % 50).alias("key2"), F.lpad(F.col("id").cast("string"), 12, "0").alias("f"))
    other = base.select((F.col("id") + 100).alias("id"), "key2", F.col("f").alias("g"))
    return base.select("id", "key1", "f").join(other, "id").groupBy("key1", "key2").agg(F.sum(F.length("f")).alias("len1"), F.sum(F.length("g")).alias("len2"), F.count("*").alias("n"))


def data_size(df: DataFrame, share: float = 0.01, seed: int = 42) -> float:
    """Estimated bytes of the rows as text: mean width of a sample times rows."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return (df.sample(False, share, seed).agg(F.avg(width)).first()[0] or 0.0) * df.count()


def timed(f: Callable[[SparkSession], DataFrame], spark: SparkSession, repeats: int = 5) -> float:
    """Mean seconds of a run to a sink that keeps nothing."""
    total = 0.0
    for _ in range(repeats):
        began = time.perf_counter()
        f(spark).write.format("noop").mode("overwrite").save()
        total += time.perf_counter() - began
    return total / repeats


def score(figures: dict[str, float]) -> float:
    return sum(figures[k] / NORMAL[k] for k in NORMAL) / len(NORMAL)
