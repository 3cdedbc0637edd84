"""Structured Streaming over event files (an extension: the surveyed projects have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, ts: str = "ts") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, ts: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """start, keys, n, total of tumbling windows; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
