"""Seeded synthetic tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mixture(spark: SparkSession, parts: Sequence[tuple[int, float, float]], seed: int = 42, partitions: int = 8) -> DataFrame:
    """(id, part, x): for each (rows, mean, standard deviation), that many normal values. The values depend on seed and partitions alone."""
    ends = list(accumulate(n for n, _, _ in parts))
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("part") + 1)
    part = sum(((F.col("id") >= end).cast("int") for end in ends[:-1]), F.lit(0))
    rows = spark.range(0, ends[-1], 1, partitions).withColumn("part", part).withColumn("_z", F.randn(seed))
    return rows.select("id", "part", (pick([float(m) for _, m, _ in parts]) + pick([float(s) for _, _, s in parts]) * F.col("_z")).alias("x"))
