"""The trip view that route, delay and series queries share: one row for each order line between two nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trips(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    # Dimension tables: the planner broadcasts them where their size allows.
    src = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("src"))
    dst = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("dst"))
    out = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(src, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(dst, F.col("o_custkey") == F.col("c_custkey"), "left")
    late = F.datediff("l_shipdate", "o_orderdate").cast("double")
    return out.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "src", "dst", F.col("o_orderpriority").alias("carrier"), F.col("l_quantity").alias("distance"),
        F.col("o_orderdate").cast("date").alias("day"), late.alias("dep"), (late - 10 * F.col("l_linenumber")).alias("arr"), F.nullif("l_returnflag", F.lit("N")).alias("reason"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)).alias("diverted"), F.when(late > 0, late).alias("delay"),
    )


TRIPS = """trips AS (SELECT l_orderkey * 10 + l_linenumber AS id, a.n_name AS src, b.n_name AS dst, o_orderpriority AS carrier, l_quantity AS distance,
  CAST(o_orderdate AS DATE) AS day, CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS dep,
  CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) - 10 * l_linenumber AS arr, nullif(l_returnflag, 'N') AS reason,
  l_linestatus = 'F' AND l_linenumber = 7 AS diverted,
  CASE WHEN date_diff('day', o_orderdate, l_shipdate) > 0 THEN CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) END AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON s_nationkey = a.n_nationkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey)"""


def _edges(x: DataFrame) -> DataFrame:
    return x.groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg("distance").alias("cost"), F.avg("delay").alias("late"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The route graph of all trips."""
    return _edges(trips(spark, d))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Long routes only: the graph for questions about missing links and detours, as nearly all nations are joined by some trip."""
    return _edges(trips(spark, d).filter("distance >= 49"))


_EDGES = "AS (SELECT src, dst, count(*) AS n, avg(distance) AS cost, avg(delay) AS late FROM trips"
EDGES = f"{TRIPS}, edges {_EDGES} GROUP BY src, dst)"
SPARSE = f"{TRIPS}, edges {_EDGES} WHERE distance >= 49 GROUP BY src, dst)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("t")).agg(F.sum("o_totalprice").alias("x"))


DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS x FROM orders GROUP BY 1)"
