"""Deterministic samples: the order is md5 of the key and seed, so results don't depend on partitions or engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import wasserstein


def shuffled(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    return df.orderBy(shuffled(keys, seed), *keys).limit(n)


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, share: float, seed: int) -> DataFrame:
    """part 'test' for floor(share * rows) of each label. Ranks come from 4096 sub-buckets of the order with offsets, so a
    label's rows are never sorted in one task."""
    base = df.withColumn("_o", shuffled(keys, seed)).withColumn("_b", F.substring("_o", 1, 3))
    counts = base.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(w))
    out = base.join(counts.drop("_n"), [label, "_b"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_o", *keys))
    return out.withColumn("part", F.when(rank <= F.floor(F.col("_all") * share), "test").otherwise("train")).drop("_o", "_b", "_before", "_all")


def most_representative(df: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int, trials: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sample of the lowest mean distance over columns scaled by the whole table's spread, and (trial, distance)."""
    spread = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    table = None
    for t in range(trials):
        d = wasserstein(df, sample_rows(df, keys, n, seed + t), columns)
        scale = F.coalesce(*(F.when((F.col("col") == c) & F.lit((spread[c] or 0) > 0), F.col("distance") / F.lit(float(spread[c] or 1))) for c in columns), F.lit(0.0))
        row = d.agg(F.avg(scale).alias("distance")).select(F.lit(t).alias("trial"), "distance")
        table = row if table is None else table.unionAll(row)
    best = table.orderBy("distance", "trial").first()["trial"]
    return sample_rows(df, keys, n, seed + best), table
