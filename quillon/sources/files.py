"""Files: declared CSV, yearly CSV sets, Parquet tables, cached samples, write-once sinks, run logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def yearly_csv(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Files named by year, with that year as a column."""
    return csv(spark, paths, schema).withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).cast("int"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written once."""
    if not exists(spark, path):
        make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def write_once(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.mode("ignore").format(format).option("header", "true").save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)
