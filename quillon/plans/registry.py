"""Queries over the test tables and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import models as M
from ..operators import pairwise as P
from ..operators import sampling as SA
from ..operators import schema as S
from ..operators import states as KV
from ..operators import stats as ST
from ..operators import windows as W
from ..sources.synthetic import mixture
from . import bench
from .trips import DAILY, EDGES, SPARSE, TRIPS, daily, edges, sparse, t, trips

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# --- routes, joins, upserts


@query(f"WITH {TRIPS} SELECT src, dst, count(*) AS n, round(sum(coalesce(delay, 0)), 4) AS total, round(avg(coalesce(delay, 0)), 6) AS mean, round(avg(distance), 6) AS distance FROM trips GROUP BY src, dst")
def route_agg(spark, d):
    return G.routes(trips(spark, d)).select("src", "dst", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("distance", 6).alias("distance"))


@query(f"WITH {TRIPS}, r AS (SELECT src, dst, count(*) AS n, round(avg(coalesce(delay, 0)), 2) AS mean FROM trips GROUP BY src, dst) SELECT * FROM r WHERE n >= 10 ORDER BY mean DESC, src, dst LIMIT 20")
def top_routes_delay(spark, d):
    r = G.routes(trips(spark, d)).filter("n >= 10").select("src", "dst", "n", F.round("mean", 2).alias("mean"))
    return r.orderBy(F.col("mean").desc(), "src", "dst").limit(20)


@query(f"WITH {TRIPS}, r AS (SELECT src, dst, count(*) AS n FROM trips GROUP BY src, dst) SELECT n, count(*) AS routes FROM r GROUP BY n")
def routes_per_count(spark, d):
    return trips(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("routes"))


@query(f"WITH {TRIPS} SELECT src, dst, count(*) AS n, sum(coalesce(delay, 0)) AS total, arg_max(day, id * 100 + distance) AS last_row_day, max(day) AS last_day, arg_min(distance, id * 100 + distance) AS distance FROM trips GROUP BY src, dst")
def upsert_routes(spark, d):
    return G.upsert_routes(trips(spark, d).withColumn("row", F.col("id") * 100 + F.col("distance")), "row")


@query("SELECT 'customer without order' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order without line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def key_gaps(spark, d):
    o = t(spark, d, "orders")
    a = t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.lit("customer without order").alias("side"), F.count("*").alias("n"))
    return a.unionAll(o.join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.lit("order without line").alias("side"), F.count("*").alias("n")))


@query("SELECT n_name AS k FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 1")
def set_ops(spark, d):
    n = t(spark, d, "nation")
    return n.join(t(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_name").alias("k")).exceptAll(n.filter("n_regionkey = 1").select("n_name")).distinct()


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def distinct_union(spark, d):
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(t(spark, d, "customer").select("c_nationkey")).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedupe_keep_first(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY n_name")
def optional_match(spark, d):
    o = t(spark, d, "orders").filter("o_totalprice > 200000")
    return t(spark, d, "nation").join(t(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("n_name").agg(F.count("o_orderkey").alias("n"))


@query("SELECT 'nation' AS k, count(*) = count(DISTINCT n_nationkey) AS is_unique FROM nation UNION ALL SELECT 'line', count(*) = count(DISTINCT l_orderkey) FROM lineitem")
def unique_keys(spark, d):
    one = lambda name, k, c: t(spark, d, name).agg(F.lit(k).alias("k"), (F.count("*") == F.count_distinct(c)).alias("is_unique"))
    return one("nation", "nation", "n_nationkey").unionAll(one("lineitem", "line", "l_orderkey"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS id FROM orders")
def surrogate_ids(spark, d):
    return S.surrogate_id(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("id").cast("long").alias("id"))


# --- casts, cleaning, scalar functions


@query("SELECT upper(trim(p_brand)) AS brand, trim(p_name) AS name, TRY_CAST(replace(p_type, 'x', '') AS DOUBLE) AS type_number, CAST(p_size AS DOUBLE) AS size, p_size % 2 <> 0 AS odd FROM part")
def schema_clean(spark, d):
    spec = {"brand": S.ColumnSpec("code"), "name": S.ColumnSpec("string"), "type_number": S.ColumnSpec("numeric", lambda c: c * 1), "size": S.ColumnSpec("numeric"), "odd": S.ColumnSpec("boolean"), "absent": S.ColumnSpec("code")}
    return S.apply_schema(t(spark, d, "part").select(F.lower(F.concat(F.lit(" "), "p_brand")).alias("brand"), F.concat("p_name", F.lit("  ")).alias("name"), F.replace("p_type", F.lit("x"), F.lit("")).alias("type_number"), F.col("p_size").cast("string").alias("size"), (F.col("p_size") % 2).alias("odd")), spec)


@query("""WITH x AS (SELECT DISTINCT l_partkey % 2500 AS v FROM lineitem), y AS (SELECT v, CASE WHEN v = 2400 THEN 0 ELSE v END AS n FROM x)
SELECT v, CASE WHEN n <= 2359 AND n % 100 <= 59 THEN lpad(CAST(n // 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END AS clock FROM y""")
def hhmm_parse(spark, d):
    return t(spark, d, "lineitem").select((F.col("l_partkey") % 2500).alias("v")).distinct().select("v", C.hhmm(F.col("v")).alias("clock"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 31 + 1 <= day(last_day(make_date(2015, CAST(o_orderkey % 12 + 1 AS INT), 1))) THEN make_date(2015, CAST(o_orderkey % 12 + 1 AS INT), CAST(o_orderkey % 31 + 1 AS INT)) END AS day FROM orders")
def date_parts(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", C.date_of(F.lit(2015), (k % 12 + 1).cast("int"), (k % 31 + 1).cast("int")).alias("day"))


@query("""SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), [CAST(CAST('0x' || substr(sha256(c_name), 8 * k + 1, 8) AS UBIGINT) AS HUGEINT) for k in range(8)]),
lambda a, x: (a * 4294967296 + x) % 9223372036854775807) AS BIGINT) AS h FROM customer""")
def sha_int64(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.sha_int64(F.col("c_name")).alias("h"))


@query(f"""WITH {TRIPS}, x AS (SELECT id, CASE WHEN reason IS NULL THEN (greatest(coalesce(arr, 0), 0) + greatest(coalesce(dep, 0), 0)) / 2 END AS v, reason, diverted FROM trips)
SELECT id, CASE WHEN reason IS NOT NULL OR diverted THEN (SELECT max(v) FROM x) ELSE v END AS total_delay FROM x""")
def delay_policy_mean(spark, d):
    x = trips(spark, d).withColumn("v", F.when(F.col("reason").isNull(), (C.positive(F.col("arr")) + C.positive(F.col("dep"))) / 2))
    return x.crossJoin(F.broadcast(x.agg(F.max("v").alias("m")))).select("id", F.when(F.col("reason").isNotNull() | F.col("diverted"), F.col("m")).otherwise(F.col("v")).alias("total_delay"))


@query(f"""WITH {TRIPS}, x AS (SELECT id, year(day) AS y, reason, (CASE WHEN arr < 0 THEN 0 ELSE arr END) + (CASE WHEN dep < 0 THEN 0 ELSE dep END) AS v FROM trips), m AS (SELECT y, max(v) AS m FROM x GROUP BY y)
SELECT id, CASE WHEN reason IS NOT NULL THEN m ELSE v END AS total_delay FROM x JOIN m USING (y)""")
def delay_policy_sum(spark, d):
    x = trips(spark, d).select("id", F.year("day").alias("y"), "reason", (C.clip_low(F.col("arr")) + C.clip_low(F.col("dep"))).alias("v"))
    m = x.groupBy("y").agg(F.max("v").alias("m"))
    return x.join(F.broadcast(m), "y").select("id", F.when(F.col("reason").isNotNull(), F.col("m")).otherwise(F.col("v")).alias("total_delay"))  # years are few


@query(f"""WITH {TRIPS}, b AS (SELECT CASE WHEN dep < 0 THEN NULL WHEN dep < 4 THEN 'none' WHEN dep < 60 THEN 'short' WHEN dep < 400 THEN 'medium' ELSE 'long' END AS bin FROM trips)
SELECT bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bin""")
def bins_fixed(spark, d):
    b = trips(spark, d).groupBy(C.binned(F.col("dep"), [0, 4, 60, 400, float("inf")], ["none", "short", "medium", "long"]).alias("bin")).agg(F.count("*").alias("n"))
    return b.select("bin", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("""WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(least(greatest(ceil((p_retailprice - lo) / ((hi - lo) / 5)) - 1, 0), 4) AS INT) AS bin, count(*) AS n FROM part, m GROUP BY 1""")
def bins_width(spark, d):
    p = t(spark, d, "part")
    m = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    k = F.least(F.greatest(F.ceil((F.col("p_retailprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 5)) - 1, F.lit(0)), F.lit(4)).cast("int")
    return p.crossJoin(F.broadcast(m)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM part) SELECT CAST(CASE WHEN p_retailprice <= e[2] THEN 0 WHEN p_retailprice <= e[3] THEN 1 WHEN p_retailprice <= e[4] THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS n FROM part, q GROUP BY 1""")
def bins_quantile(spark, d):
    p = t(spark, d, "part")
    q = p.agg(F.percentile("p_retailprice", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("e"))
    return p.crossJoin(F.broadcast(q)).groupBy(C.right_bins(F.col("p_retailprice"), [F.col("e")[k] for k in range(5)]).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CAST(CASE WHEN p_size >= 1 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 25 THEN 1 WHEN p_size > 25 AND p_size <= 45 THEN 2 END AS INT) AS bin, count(*) AS n FROM part GROUP BY 1")
def bins_domain(spark, d):
    return t(spark, d, "part").groupBy(C.right_bins(F.col("p_size"), [1, 10, 25, 45]).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS flag, nullif(l_returnflag, 'N') AS reason FROM lineitem")
def value_map(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.mapped(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}).alias("flag"), F.nullif("l_returnflag", F.lit("N")).alias("reason"))


@query(r"SELECT count(*) FILTER (WHERE regexp_full_match(p_brand, '[A-Za-z]+#?\d+')) AS hits, sum(length(p_name)) AS chars, min(lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS first, count(DISTINCT p_name || ' > ' || p_brand) AS names FROM part")
def strings(spark, d):
    return t(spark, d, "part").agg(F.count_if(F.col("p_brand").rlike(r"^[A-Za-z]+#?\d+$")).alias("hits"), F.sum(F.length("p_name")).alias("chars"), F.min(F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("first"), F.count_distinct(F.concat("p_name", F.lit(" > "), "p_brand")).alias("names"))


@query("SELECT p_partkey, round(sqrt(p_size), 6) AS a, round(sin(p_size) + cos(p_size), 6) AS b, round(ln(p_retailprice), 6) AS c, round(log2(p_size), 6) AS e, round(exp(p_size / 50.0), 6) AS f, abs(p_size - 25) AS g, p_partkey % 100 AS h FROM part")
def maths(spark, d):
    s = F.col("p_size")
    return rounded(t(spark, d, "part").select("p_partkey", F.sqrt(s.cast("double")).alias("a"), (F.sin(s) + F.cos(s)).alias("b"), F.ln("p_retailprice").alias("c"), F.log2(s.cast("double")).alias("e"), F.exp(s / 50.0).alias("f"), F.abs(s - 25).alias("g"), (F.col("p_partkey") % 100).alias("h")))


@query("SELECT event_id, CAST(ts AS DATE) AS day, epoch_us(ts) AS micros, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def dates_and_json(spark, d):
    return t(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# --- aggregates and statistics


@query(f"""WITH {TRIPS}, l AS (SELECT 'dep' AS col, dep AS x FROM trips UNION ALL SELECT 'delay', delay FROM trips UNION ALL SELECT 'distance', distance FROM trips)
SELECT col, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max FROM l WHERE x IS NOT NULL GROUP BY col""")
def describe(spark, d):
    return rounded(ST.describe(trips(spark, d), ["dep", "delay", "distance"]))


@query(f"""WITH {TRIPS}, c AS (SELECT carrier, count(*) AS n FROM trips GROUP BY 1) SELECT round(-sum(n / t * log2(n / t)) / log2(max(k)), 6) AS entropy FROM c, (SELECT sum(n) AS t, count(*) AS k FROM c)""")
def entropy_carrier(spark, d):
    return rounded(ST.entropy(trips(spark, d), "carrier"))


@query("SELECT min(p_type) AS mode FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 QUALIFY n = max(n) OVER ())")
def mode_smallest(spark, d):
    return t(spark, d, "part").agg(F.mode("p_type", True).alias("mode"))


@query("SELECT CAST(make_timestamp(CAST(quantile_cont(epoch_us(o_orderdate), 0.5) AS BIGINT)) AS DATE) AS median, round((quantile_cont(epoch_us(o_orderdate), 0.75) - quantile_cont(epoch_us(o_orderdate), 0.25)) / 86400000000, 6) AS iqr_days FROM orders")
def date_quantiles(spark, d):
    u = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    q = t(spark, d, "orders").agg(F.percentile(u, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(F.timestamp_micros(F.col("q")[1].cast("long")).cast("date").alias("median"), F.round((F.col("q")[2] - F.col("q")[0]) / 86400000000, 6).alias("iqr_days"))


@query(f"WITH {TRIPS} SELECT 'reason' AS col, count(*) - count(reason) AS missing FROM trips UNION ALL SELECT 'delay', count(*) - count(delay) FROM trips UNION ALL SELECT 'src', count(*) - count(src) FROM trips")
def null_report(spark, d):
    return ST.null_report(trips(spark, d), ["reason", "delay", "src"])


@query(f"WITH {TRIPS} SELECT 'src' AS col, count(DISTINCT src) AS n FROM trips UNION ALL SELECT 'carrier', count(DISTINCT carrier) FROM trips UNION ALL SELECT 'reason', count(DISTINCT reason) FROM trips")
def distinct_counts(spark, d):
    row = trips(spark, d).agg(*(F.count_distinct(c).alias(c) for c in ("src", "carrier", "reason")))
    return row.unpivot([], ["src", "carrier", "reason"], "col", "n")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def cross_tab(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("WITH x AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem) SELECT a, b, round(r, 6) AS r FROM x")
def pearson(spark, d):
    return rounded(ST.pearson(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(a, b), 6) AS r FROM r""")
def spearman(spark, d):
    return rounded(ST.spearman(t(spark, d, "part"), ["p_size", "p_retailprice"]))


@query("""WITH v AS (SELECT l_quantity AS x, count(*) FILTER (WHERE l_returnflag = 'A') AS p, count(*) FILTER (WHERE l_returnflag = 'R') AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
c AS (SELECT x, sum(p) OVER w / sum(p) OVER () AS fp, sum(q) OVER w / sum(q) OVER () AS fq, lead(x) OVER (ORDER BY x) - x AS dx FROM v WINDOW w AS (ORDER BY x))
SELECT 'l_quantity' AS col, round(sum(abs(fp - fq) * dx), 6) AS distance FROM c""")
def wasserstein_cols(spark, d):
    x = t(spark, d, "lineitem")
    return rounded(ST.wasserstein(x.filter("l_returnflag = 'A'"), x.filter("l_returnflag = 'R'"), ["l_quantity"]))


@query("SELECT CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY 1")
def hist(spark, d):
    return ST.histogram(t(spark, d, "part"), "p_retailprice", 30)


@query("""WITH s AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal) - 1 AS i, count(*) OVER () AS n FROM supplier), c AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer), k AS (SELECT CAST(unnest(range(50)) AS INT) AS k)
SELECT k, s.x AS a, c.x AS b FROM k JOIN s ON s.i = round_even(k / 49.0 * (s.n - 1), 0) JOIN c ON c.i = round_even(k / 49.0 * (c.n - 1), 0)""")
def qq_pairs(spark, d):
    return ST.qq_pairs(t(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), t(spark, d, "customer").select(F.col("c_acctbal").alias("v")), "v", 50)


@query("SELECT p_partkey, round((p_size - m) / s, 6) AS p_size, round((p_retailprice - m2) / s2, 6) AS p_retailprice FROM part, (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part)")
def standard_scaling(spark, d):
    return rounded(ST.scaled(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("SELECT p_partkey, round((p_size - m) / q, 6) AS p_size FROM part, (SELECT median(p_size) AS m, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS q FROM part)")
def robust_scaling(spark, d):
    return rounded(ST.scaled(t(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], "robust"))


# --- encoding, sampling


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS p_type FROM part")
def encode_codes(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type")
    return S.encode(p, "p_type", S.dictionary(p, "p_type")).select("p_partkey", F.col("p_type").cast("int").alias("p_type"))


@query("SELECT p_partkey, p_type FROM part")
def encode_rollback(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type")
    codes = S.dictionary(p, "p_type")
    return S.decode(S.encode(p, "p_type", codes).withColumn("p_type", F.col("p_type") + 0.2), "p_type", codes)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dummies_rollback(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return S.undo_dummies(S.dummies(x, "l_returnflag", ["A", "N", "R"]), "l_returnflag", ["A", "N", "R"])


@query("SELECT CASE WHEN m > 1e17 THEN 'ns' WHEN m > 1e14 THEN 'us' WHEN m > 1e11 THEN 'ms' ELSE 's' END AS unit FROM (SELECT median(abs(epoch_us(ts))) AS m FROM events)")
def epoch_unit(spark, d):
    return t(spark, d, "events").agg(S.epoch_unit(F.unix_micros(F.col("ts").cast("timestamp"))).alias("unit"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|667'), o_orderkey LIMIT 100")
def n_sample(spark, d):
    return SA.sample_rows(t(spark, d, "orders"), ["o_orderkey"], 100, 667).select("o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|667'), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, d):
    return SA.stratified_split(t(spark, d, "orders"), ["o_orderkey"], "o_orderstatus", 0.2, 667).select("o_orderkey", "o_orderstatus", "part")


@query()
def representative_sample(spark, d):
    return SA.most_representative(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], ["o_totalprice"], 200, 3, 667)[0]


# --- windows and series


@query(f"WITH {DAILY} SELECT t, round(avg(x) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS m FROM daily")
def rolling_centered(spark, d):
    return daily(spark, d).select("t", F.round(W.rolling_mean("x", "t", 7, True, 1), 4).alias("m"))


@query(f"WITH {DAILY} SELECT t, round(CASE WHEN count(x) OVER w = 365 THEN avg(x) OVER w END, 4) AS m FROM daily WINDOW w AS (ORDER BY t ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)")
def rolling_trailing(spark, d):
    return daily(spark, d).select("t", F.round(W.rolling_mean("x", "t", 365), 4).alias("m"))


@query(f"WITH {DAILY}, i AS (SELECT t, x, row_number() OVER (ORDER BY t) - count(*) OVER () AS k FROM daily) SELECT t, round(sum(x * power(2, k / 365.0)) OVER w / sum(power(2, k / 365.0)) OVER w, 4) AS ewm FROM i WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)")
def ewm(spark, d):
    return W.ewm_mean(daily(spark, d), "x", "t", 365.0).select("t", F.round("ewm", 4).alias("ewm"))


@query(f"WITH {DAILY}, g AS (SELECT t, CASE WHEN day(t) % 7 <> 0 AND t > DATE '1995-01-03' THEN x END AS x FROM daily) SELECT t, coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM g")
def ffill_bfill(spark, d):
    g = daily(spark, d).withColumn("x", F.when((F.dayofmonth("t") % 7 != 0) & (F.col("t") > F.lit("1995-01-03").cast("date")), F.col("x")))
    return g.select("t", W.fill_both(F.col("x"), "t").alias("x"))


@query(f"WITH {DAILY} SELECT t, lag(x, 45) OVER (ORDER BY t) AS before FROM daily")
def lag_shift(spark, d):
    return daily(spark, d).select("t", F.lag("x", 45).over(W.over("t")).alias("before"))


@query(f"""WITH {DAILY}, g AS (SELECT t, CASE WHEN day(t) % 7 <> 0 THEN x END AS x, row_number() OVER (ORDER BY t) - count(*) OVER () AS k FROM daily),
r AS (SELECT t, x, CASE WHEN count(x) OVER w7 >= 20 THEN avg(x) OVER w7 END AS roll, sum(x * power(2, k / 30.0)) OVER w / sum(CASE WHEN x IS NOT NULL THEN power(2, k / 30.0) END) OVER w AS ewm FROM g WINDOW w7 AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
c AS (SELECT t, coalesce(x, lag(roll, 45) OVER (ORDER BY t), ewm) AS x FROM r)
SELECT t, round(coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS x FROM c""")
def fill_cascade(spark, d):
    g = daily(spark, d).withColumn("x", F.when(F.dayofmonth("t") % 7 != 0, F.col("x")))
    return W.fill_cascade(g, "x", "t", 20, 45, 30.0).select("t", F.round("x", 4).alias("x"))


@query(f"""WITH {DAILY}, a AS (SELECT t, x, row_number() OVER (ORDER BY t) - 1 AS i, CASE WHEN count(*) OVER w = 365 THEN avg(x) OVER w END AS trend FROM daily WINDOW w AS (ORDER BY t ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
s AS (SELECT i % 365 AS p, avg(x - trend) AS s FROM a GROUP BY 1) SELECT t, round(trend, 3) AS trend, round(s - (SELECT avg(s) FROM s), 3) AS seasonal, round(x - trend - (s - (SELECT avg(s) FROM s)), 3) AS resid FROM a JOIN s ON i % 365 = p""")
def decompose(spark, d):
    return rounded(W.decompose(daily(spark, d), "x", "t", 365).select("t", "trend", "seasonal", "resid"), 3)


@query(f"WITH {DAILY}, i AS (SELECT t, x, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM daily) SELECT t, CASE WHEN i < floor((n - 360) * 0.8) + 180 THEN 'train' ELSE 'test' END AS part FROM i WHERE i >= 180 AND i < n - 180")
def series_split(spark, d):
    return W.split_series(daily(spark, d), "t", 180).select("t", "part")


@query(f"""WITH {DAILY}, s AS (SELECT row_number() OVER (ORDER BY t) AS i, x - (SELECT avg(x) FROM daily) AS d FROM daily), h AS (SELECT unnest(range(901)) AS lag)
SELECT CAST(lag AS INT) AS lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM s), 6) AS r FROM h JOIN s a ON true JOIN s b ON b.i = a.i - lag GROUP BY lag""")
def acf(spark, d):
    return rounded(W.acf(daily(spark, d), "x", "t", 900))


@query(f"""WITH {DAILY}, s AS (SELECT row_number() OVER (ORDER BY t) AS i, x - (SELECT avg(x) FROM daily) AS d FROM daily), h AS (SELECT unnest(range(1, 11)) AS lag), n AS (SELECT count(*) AS n FROM daily),
r AS (SELECT lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM s) AS r FROM h JOIN s a ON true JOIN s b ON b.i = a.i - lag GROUP BY lag) SELECT CAST(lag AS INT) AS lag, round(n * (n + 2) * sum(r * r / (n - lag)) OVER (ORDER BY lag), 4) AS q FROM r, n""")
def ljung_box_q(spark, d):
    return W.ljung_box(daily(spark, d), "x", "t", 10).select("lag", F.round("q", 4).alias("q"))


@query()
def ljung_box(spark, d):
    return rounded(W.ljung_box_test(daily(spark, d), "x", "t", 10))


@query()
def pacf(spark, d):
    r = [x["r"] for x in W.acf(daily(spark, d), "x", "t", 50).orderBy("lag").collect()]  # 51 rows
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(M.pacf(r))], "lag int, r double"))


TRAILING = f"""{DAILY}, a AS (SELECT t, x, row_number() OVER (ORDER BY t) - 1 AS i, CASE WHEN count(*) OVER w = 365 THEN avg(x) OVER w END AS trend FROM daily WINDOW w AS (ORDER BY t ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)),
s AS (SELECT i % 365 AS p, avg(x - trend) AS s FROM a GROUP BY 1), n AS (SELECT t, x, trend, s - (SELECT avg(s) FROM s) AS seasonal FROM a JOIN s ON i % 365 = p)"""


@query(f"WITH {TRAILING} SELECT t, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(x - trend - seasonal, 3) AS resid FROM n")
def decompose_trailing(spark, d):
    return rounded(W.decompose(daily(spark, d), "x", "t", 365, False).select("t", "trend", "seasonal", "resid"), 3)


@query(f"WITH {TRAILING} SELECT t, round(seasonal, 3) AS noise, round(x - seasonal, 3) AS denoised FROM n")
def denoised(spark, d):
    return rounded(W.denoised(daily(spark, d), "x", "t", 365).select("t", "noise", "denoised"), 3)


@query(f"WITH {DAILY}, i AS (SELECT t, ln(x) AS l, row_number() OVER (ORDER BY t) - count(*) OVER () AS k FROM daily) SELECT t, round(l, 6) AS l, round(CASE WHEN count(*) OVER w = 30 THEN avg(l) OVER w END, 6) AS roll, round(sum(l * power(2, k / 30.0)) OVER u / sum(power(2, k / 30.0)) OVER u, 6) AS ewm FROM i WINDOW w AS (ORDER BY t ROWS 29 PRECEDING), u AS (ORDER BY t ROWS UNBOUNDED PRECEDING)")
def log_smoothed(spark, d):
    x = daily(spark, d).select("t", F.ln("x").alias("l"))
    return rounded(W.ewm_mean(x.withColumn("roll", W.rolling_mean("l", "t", 30)), "l", "t", 30.0))


@query()
def adf(spark, d):
    return M.adf(daily(spark, d), "x", "t")


@query()
def ar_order(spark, d):
    return M.ar_order(daily(spark, d), "x", "t", 22, 365)


@query()
def ar_forecast(spark, d):
    return M.ar_forecast(daily(spark, d), "x", "t", 365, 30)


# --- graph


@query(f"WITH {EDGES}, v AS (SELECT n_name AS id FROM nation) SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, CAST((SELECT coalesce(sum(n), 0) FROM edges WHERE src = id) AS BIGINT) AS weighted FROM v")
def degrees(spark, d):
    return G.degrees(t(spark, d, "nation").select(F.col("n_name").alias("id")), edges(spark, d))


#: Cheapest paths between all pairs by hops, edges that lie on one, all of them counted, and the share of each pair's paths that passes a vertex.
BETWEEN = """walk AS (SELECT s, s AS v, 0::BIGINT AS c, 0 AS hops FROM (SELECT DISTINCT src AS s FROM edges) UNION SELECT * FROM (SELECT s, dst AS v, min(c + n)::BIGINT AS c, max(hops) + 1 AS hops FROM walk JOIN edges ON src = v WHERE hops < 6 GROUP BY s, dst)),
far AS (SELECT s, v, min(c) AS c FROM walk GROUP BY 1, 2), tight AS (SELECT a.s, e.src AS u, e.dst AS v FROM far a JOIN edges e ON a.v = e.src JOIN far b ON b.s = a.s AND b.v = e.dst AND b.c = a.c + e.n),
trail AS (SELECT s, s AS v FROM (SELECT DISTINCT s FROM far) UNION ALL SELECT trail.s, tight.v FROM trail JOIN tight ON tight.s = trail.s AND tight.u = trail.v),
ways AS (SELECT s, v, count(*) AS k FROM trail GROUP BY 1, 2), between AS (SELECT m.v AS id, sum(a.k * b.k / w.k) AS score FROM far m JOIN far e ON e.s = m.v JOIN far f ON f.s = m.s AND f.v = e.v AND f.c = m.c + e.c
JOIN ways a ON a.s = m.s AND a.v = m.v JOIN ways b ON b.s = e.s AND b.v = e.v JOIN ways w ON w.s = f.s AND w.v = f.v WHERE m.s <> m.v AND e.s <> e.v AND m.s <> e.v GROUP BY 1)"""
SCORES = f"""{EDGES}, {BETWEEN}, v AS (SELECT n_name AS id, n_regionkey AS community, coalesce((SELECT sum(n) FROM edges WHERE src = n_name), 0)::DOUBLE AS weighted,
coalesce((SELECT score FROM between WHERE id = n_name), 0) AS betweenness, coalesce((SELECT avg(delay) FROM trips WHERE src = n_name), 0) AS late FROM nation),
f AS (SELECT *, ((betweenness - min(betweenness) OVER ()) / nullif(max(betweenness) OVER () - min(betweenness) OVER (), 0) + (weighted - min(weighted) OVER ()) / (max(weighted) OVER () - min(weighted) OVER ()) + (late - min(late) OVER ()) / (max(late) OVER () - min(late) OVER ())) / 3 AS fragility FROM v)"""


def _scores(spark, d, communities=None):
    """Centrality of nations; communities are their regions unless they are given, by a function of the routes. Trips are read once."""
    e = G.checkpointed(trips(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("delay").alias("total"), F.count("delay").alias("seen")))
    given = t(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("community")) if communities is None else communities(e)
    late = e.groupBy(F.col("src").alias("id")).agg((F.sum("total") / F.nullif(F.sum("seen"), F.lit(0))).alias("late"))
    return G.centrality(given, e, G.betweenness(e, "n"), late, None if communities is None else 0.0)  # the SQL has no mean over a constant column


@query(f"WITH RECURSIVE {SCORES} SELECT id, community, weighted, round(betweenness, 6) AS betweenness, round(late, 6) AS late, round(fragility, 6) AS fragility FROM f")
def centrality_table(spark, d):
    return rounded(_scores(spark, d))


@query()
def centrality_louvain(spark, d):
    return rounded(_scores(spark, d, lambda e: G.louvain(e, "n")))


@query(f"WITH RECURSIVE {SCORES} SELECT id, round(fragility, 6) AS fragility, CAST(dense_rank() OVER (ORDER BY round(fragility, 6) DESC) AS INT) AS rank FROM f")
def fragility(spark, d):
    return _scores(spark, d).select("id", F.round("fragility", 6).alias("fragility")).withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("fragility").desc())))


TOP2 = SCORES + ", g AS (SELECT community, id, fragility, row_number() OVER (PARTITION BY community ORDER BY fragility DESC, id) AS rank FROM f), k AS (SELECT * FROM g WHERE rank <= 2 AND community IN (SELECT community FROM g GROUP BY 1 HAVING count(*) > 4))"


def _top2(spark, d):
    return G.top_per_group(_scores(spark, d), "community", "fragility", "id", 2, 4)


@query(f"WITH RECURSIVE {TOP2} SELECT community, id, CAST(rank AS INT) AS rank FROM k")
def top2_per_group(spark, d):
    return _top2(spark, d).select("community", "id", "rank")


@query(f"WITH RECURSIVE {TOP2} SELECT src, dst, a.community AS src_community, b.community AS dst_community, count(*) AS n, round(sum(delay), 4) AS total FROM trips JOIN k a ON src = a.id JOIN k b ON dst = b.id WHERE src <> dst GROUP BY ALL")
def critical_routes(spark, d):
    k = _top2(spark, d).select("id", "community")
    x = trips(spark, d).join(k.select(F.col("id").alias("src"), F.col("community").alias("src_community")), "src").join(k.select(F.col("id").alias("dst"), F.col("community").alias("dst_community")), "dst")
    return x.filter("src <> dst").groupBy("src", "dst", "src_community", "dst_community").agg(F.count("*").alias("n"), F.round(F.sum("delay"), 4).alias("total"))


@query(f"WITH {SPARSE} SELECT n_name AS id FROM nation WHERE n_name <> 'FRANCE' AND NOT EXISTS (SELECT 1 FROM edges WHERE src = 'FRANCE' AND dst = n_name)")
def not_connected(spark, d):
    e = sparse(spark, d).filter("src = 'FRANCE'").select(F.col("dst").alias("id"))
    return t(spark, d, "nation").select(F.col("n_name").alias("id")).filter("id <> 'FRANCE'").join(e, "id", "left_anti")


def _first(spark, d):
    return t(spark, d, "nation").agg(F.min("n_name")).first()[0]


PATHS = "best AS (SELECT node, cost FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost) = 1)"


@query(f"""WITH RECURSIVE {SPARSE}, walk AS (SELECT (SELECT min(n_name) FROM nation) AS node, 0.0::DOUBLE AS cost, 0 AS hops UNION SELECT * FROM (SELECT dst AS node, min(walk.cost + edges.cost) AS cost, max(hops) + 1 AS hops FROM walk JOIN edges ON src = node WHERE hops < 6 GROUP BY dst)), {PATHS} SELECT node AS id, round(cost, 6) AS cost FROM best""")
def shortest_path(spark, d):
    return G.shortest_paths(sparse(spark, d), _first(spark, d), "cost").select("id", F.round("cost", 6).alias("cost"))


@query(f"""WITH RECURSIVE {SPARSE}, few AS (SELECT * FROM edges WHERE NOT (src = (SELECT min(n_name) FROM nation) AND n >= 3)), walk AS (SELECT (SELECT min(n_name) FROM nation) AS node, 0.0::DOUBLE AS cost, 0 AS hops UNION SELECT * FROM (SELECT dst AS node, min(walk.cost + few.cost) AS cost, max(hops) + 1 AS hops FROM walk JOIN few ON src = node WHERE hops < 8 GROUP BY dst)), {PATHS} SELECT node AS id, round(cost, 6) AS cost FROM best""")
def path_after_removal(spark, d):
    e, first = sparse(spark, d), _first(spark, d)
    return G.shortest_paths(G.without_edges(e, e.filter((F.col("src") == first) & (F.col("n") >= 3))), first, "cost").select("id", F.round("cost", 6).alias("cost"))


@query(f"WITH {SPARSE} SELECT src AS id, count(*) AS degree FROM edges WHERE src IN (SELECT n_name FROM nation) GROUP BY 1 HAVING count(*) < 25 ORDER BY degree, id LIMIT 1")
def low_degree_source(spark, d):
    return G.low_degree_source(t(spark, d, "nation").select(F.col("n_name").alias("id")), sparse(spark, d), 25)


REROUTE = """walk AS (SELECT 0 AS g, (SELECT min(n_name) FROM nation) AS node, 0.0::DOUBLE AS cost, 0 AS hops UNION ALL SELECT 1, (SELECT min(n_name) FROM nation), 0.0, 0
UNION SELECT * FROM (SELECT g, dst AS node, min(walk.cost + edges.cost) AS cost, max(hops) + 1 AS hops FROM walk JOIN edges ON src = node WHERE hops < 8 AND NOT (g = 1 AND src = (SELECT min(n_name) FROM nation) AND n >= 3) GROUP BY g, dst)),
best AS (SELECT g, node, min(cost) AS cost FROM walk GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {SPARSE}, {REROUTE} SELECT a.node AS id, round(a.cost, 6) AS before, round(b.cost, 6) AS after, b.cost IS NULL OR round(b.cost, 6) > round(a.cost, 6) AS longer FROM best a LEFT JOIN best b ON a.node = b.node AND b.g = 1 WHERE a.g = 0")
def rerouted(spark, d):
    e, first = sparse(spark, d), _first(spark, d)
    out = rounded(G.rerouted(e, e.filter((F.col("src") == first) & (F.col("n") >= 3)), first, "cost"))
    return out.withColumn("longer", F.col("after").isNull() | (F.col("after") > F.col("before")))


@query(f"WITH RECURSIVE {EDGES}, {BETWEEN} SELECT n_name AS id, round(coalesce(score, 0), 6) AS score FROM nation LEFT JOIN between ON id = n_name")
def betweenness(spark, d):
    nations = t(spark, d, "nation").select(F.col("n_name").alias("id"))
    return rounded(nations.join(G.betweenness(edges(spark, d), "n"), "id", "left").fillna(0.0, ["score"]))


@query()
def louvain(spark, d):
    return G.louvain(edges(spark, d), "n")


@query(f"""WITH RECURSIVE {SPARSE}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), deg AS (SELECT src, count(*) AS k FROM edges GROUP BY 1), m AS (SELECT count(*) AS n FROM ids),
r AS (SELECT 0 AS i, id, 1.0::DOUBLE / n AS rank FROM ids, m UNION ALL SELECT * FROM (SELECT any_value(i) + 1 AS i, id, any_value(0.15 / n + 0.85 * lost / n) + 0.85 * sum(got) AS rank FROM (
  SELECT r.i, e.dst AS id, r.rank / k AS got FROM r JOIN deg ON deg.src = r.id JOIN edges e ON e.src = r.id UNION ALL SELECT r.i, ids.id, 0.0 FROM (SELECT DISTINCT i FROM r) r, ids)
  , m, (SELECT coalesce(sum(CASE WHEN k IS NULL THEN rank END), 0) AS lost FROM r LEFT JOIN deg ON deg.src = r.id) WHERE i < 150 GROUP BY id))
SELECT id, round(rank, 6) AS rank FROM r WHERE i = 150""")
def pagerank(spark, d):
    return rounded(G.pagerank(sparse(spark, d)))


@query(f"""WITH RECURSIVE {SPARSE}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), w AS (SELECT id AS x, id AS y FROM ids UNION SELECT w.x, dst FROM w JOIN edges ON src = y)
SELECT a.x AS id, min(a.y) AS component FROM w a JOIN w b ON a.x = b.y AND a.y = b.x GROUP BY 1""")
def strong_components(spark, d):
    return G.strong_components(sparse(spark, d))


@query(f"WITH RECURSIVE {EDGES}, b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT DISTINCT x, x AS y FROM b UNION SELECT w.x, b.y FROM w JOIN b ON w.y = b.x) SELECT x AS id, min(y) AS component FROM w GROUP BY 1")
def weak_components(spark, d):
    return G.weak_components(edges(spark, d))


# --- outliers, distances, imputation, models


@query("SELECT s_suppkey, abs(s_acctbal - m) / s > 1.5 AS outlier FROM supplier, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier)")
def outlier_z(spark, d):
    return P.zscore_flags(t(spark, d, "supplier"), ["s_acctbal"], 1.5).select("s_suppkey", "outlier")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice < a - 0.8 * (b - a) OR l_extendedprice > b + 0.8 * (b - a) AS outlier FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)")
def outlier_iqr(spark, d):
    return P.iqr_flags(t(spark, d, "lineitem"), ["l_extendedprice"], 0.8).select("l_orderkey", "l_linenumber", "outlier")


@query("WITH h AS (SELECT p_partkey, CAST(p_size NOT BETWEEN 5 AND 45 AS INT) + CAST(p_retailprice NOT BETWEEN 950 AND 1800 AS INT) AS h FROM part) SELECT p_partkey, (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) AS score FROM h")
def limit_score(spark, d):
    return P.limit_score(t(spark, d, "part"), {"p_size": (5, 45), "p_retailprice": (950, 1800)}).select("p_partkey", F.col("score").cast("double").alias("score"))


@query("WITH q AS (SELECT quantile_cont(p_size, 0.1) AS a, quantile_cont(p_size, 0.9) AS b, quantile_cont(p_retailprice, 0.1) AS c, quantile_cont(p_retailprice, 0.9) AS e FROM part), h AS (SELECT p_partkey, CAST(p_size NOT BETWEEN a AND b AS INT) + CAST(p_retailprice NOT BETWEEN c AND e AS INT) AS h FROM part, q) SELECT p_partkey, (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) AS score FROM h")
def limit_score_percentile(spark, d):
    return P.limit_score(t(spark, d, "part"), {"p_size": (0.1, 0.9), "p_retailprice": (0.1, 0.9)}, "percentile").select("p_partkey", F.col("score").cast("double").alias("score"))


@query()
def limit_score_sinkhorn(spark, d):
    return rounded(P.limit_score(t(spark, d, "part"), {"p_size": (5, 45), "p_retailprice": (950, 1800)}, "sinkhorn").select("p_partkey", "score"))


@query("SELECT s_suppkey, abs(s_acctbal - m) / s > 1.5 AS outlier FROM supplier, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier)")
def outliers_zscore(spark, d):
    return P.outliers(t(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], "zscore", 1.5)


def _vectors(spark, d):
    return t(spark, d, "embeddings"), F.col("embedding").cast("array<double>")


PAIRS = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.v, b.v)]) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


@query(f"WITH {PAIRS} SELECT i AS vec_id, round(ln(sum(exp(-d2 / 2)) + 1), 6) AS log_density FROM p GROUP BY 1")
def outlier_kde(spark, d):
    df, v = _vectors(spark, d)
    return rounded(P.kde_scores(df, "vec_id", v))


@query(f"WITH {PAIRS}, near AS (SELECT i, j FROM p WHERE d2 <= 1.15 * 1.15), core AS (SELECT i FROM near GROUP BY 1 HAVING count(*) + 1 >= 10) SELECT vec_id, vec_id NOT IN (SELECT i FROM core UNION SELECT i FROM near WHERE j IN (SELECT i FROM core)) AS noise FROM e")
def dbscan_noise(spark, d):
    df, v = _vectors(spark, d)
    return P.dbscan_noise(df, "vec_id", v, 1.15, 10)


@query(f"WITH {PAIRS}, s AS (SELECT i AS vec_id, round(ln(sum(exp(-d2 / 2)) + 1), 6) AS l FROM p GROUP BY 1) SELECT vec_id, l <= (SELECT quantile_cont(l, 0.02) FROM s) AS outlier FROM s")
def outliers_kde(spark, d):
    df, v = _vectors(spark, d)
    return P.share_flags(rounded(P.kde_scores(df, "vec_id", v)), "log_density", 0.02, False).select("vec_id", "outlier")


@query(f"""WITH {PAIRS}, nn AS (SELECT i, j, sqrt(d2) AS d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= 20), kd AS (SELECT i AS j, max(d) AS kd FROM nn GROUP BY 1),
lrd AS (SELECT i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd USING (j) GROUP BY 1) SELECT nn.i AS vec_id, round(avg(b.lrd / a.lrd), 5) AS lof FROM nn JOIN lrd a ON nn.i = a.i JOIN lrd b ON nn.j = b.i GROUP BY 1""")
def lof(spark, d):
    df, v = _vectors(spark, d)
    return rounded(P.lof(df, "vec_id", v), 5)


TWO = "WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, stddev_pop(p_size) AS s, stddev_pop(p_retailprice) AS u, corr(p_size, p_retailprice) AS r FROM part), z AS (SELECT p_partkey, p_size, p_retailprice, (p_size - a) / s AS x, (p_retailprice - b) / u AS y, r FROM part, m)"


@query(f"{TWO}, q AS (SELECT p_partkey, p_size, p_retailprice, (x * x - 2 * r * x * y + y * y) / (1 - r * r) AS d2 FROM z) SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice, round(d2, 6) AS d2, d2 > -2 * ln(0.05) AS outlier FROM q")
def mahalanobis(spark, d):
    return rounded(M.mahalanobis(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query()
def mahalanobis_robust(spark, d):
    return rounded(M.mahalanobis(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], robust=True))


@query("""WITH x AS (SELECT n_nationkey AS k, n_regionkey AS r, n_nationkey % 3 = 0 AS f, n_nationkey % 4 = 0 AS g, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS v FROM nation)
SELECT a.k AS i, b.k AS j, round((CAST(a.r <> b.r AS INT) + CAST(a.f <> b.f AS INT) + CASE WHEN a.g OR b.g THEN CAST(a.g <> b.g AS INT) ELSE 0 END + coalesce(abs(a.v - b.v), 0)) / (2 + CAST(a.g OR b.g AS INT) + CAST(a.v IS NOT NULL AND b.v IS NOT NULL AS INT)), 6) AS d FROM x a JOIN x b ON a.k < b.k""")
def mixed_dissimilarity(spark, d):
    k = F.col("n_nationkey")
    x = t(spark, d, "nation").select(k.alias("k"), F.col("n_regionkey").alias("r"), (k % 3 == 0).alias("f"), (k % 4 == 0).alias("g"), F.when(k % 5 != 0, k.cast("double")).alias("v"))
    return rounded(P.dissimilarity(x, "k", {"r": "NO", "f": "SB", "g": "AB", "v": "NU"}))


@query(r"""WITH tf AS (SELECT i, t, count(*) AS tf FROM (SELECT item_id AS i, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT i, t, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*) OVER (PARTITION BY t))) + 1) AS w FROM tf), v AS (SELECT i, t, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS w FROM w)
SELECT a.i, b.i AS j, round(1 - sum(a.w * b.w), 6) AS d FROM v a JOIN v b USING (t) WHERE a.i < b.i GROUP BY ALL""")
def tfidf_cosine(spark, d):
    return rounded(P.tfidf_cosine(t(spark, d, "benchmark"), "item_id", "text"))


@query("""WITH s AS (SELECT s_suppkey AS k, CAST(s_nationkey AS DOUBLE) AS a, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey / 10.0 END AS b, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS y FROM supplier),
p AS (SELECT m.k AS i, o.k AS j, o.y, ((m.a - o.a) * (m.a - o.a) + CASE WHEN m.b IS NOT NULL AND o.b IS NOT NULL THEN (m.b - o.b) * (m.b - o.b) ELSE 0 END) * 2 / (1 + CAST(m.b IS NOT NULL AND o.b IS NOT NULL AS INT)) AS d FROM s m JOIN s o ON m.y IS NULL AND o.y IS NOT NULL),
f AS (SELECT i, avg(y) AS y FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5) GROUP BY 1) SELECT k, round(coalesce(s.y, f.y), 6) AS y FROM s LEFT JOIN f ON k = i""")
def knn_impute(spark, d):
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").cast("double").alias("a"), F.when(k % 4 != 0, k / 10.0).alias("b"), F.when(k % 7 != 0, F.col("s_acctbal")).alias("y"))
    return rounded(P.knn_impute(s, "k", ["a", "b"], "y"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal ELSE (SELECT avg(s_acctbal) FILTER (s_suppkey % 7 <> 0) FROM supplier) END AS s_acctbal FROM supplier".replace("FILTER (s", "FILTER (WHERE s"))
def merge_imputed(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    filled = s.select("s_suppkey").crossJoin(F.broadcast(s.agg(F.avg("s_acctbal").alias("s_acctbal"))))
    return P.merge_imputed(s, filled, "s_suppkey", ["s_acctbal"])


@query()
def mice(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).cast("double").alias("p_size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"), (F.col("p_partkey") % 10).cast("double").alias("z"))
    return rounded(M.iterative_impute(p, "p_partkey", ["p_size", "p_retailprice", "z"], 3), 4)


@query(f"{TWO}, r AS (SELECT abs(any_value(r)) AS r FROM z) SELECT CAST(1 AS INT) AS component, round(1 + r, 6) AS eigenvalue, round((1 + r) / 2, 6) AS share, round((1 + r) / 2, 6) AS cumulative, round((1 - r) / 2, 6) AS mse FROM r UNION ALL SELECT 2, round(1 - r, 6), round((1 - r) / 2, 6), 1.0, 0.0 FROM r")
def pca_two(spark, d):
    return rounded(M.pca(t(spark, d, "part"), ["p_size", "p_retailprice"]))


@query(f"{TWO} SELECT p_partkey, round((x + sign(r) * y) / sqrt(2), 6) AS pc1, round((x - sign(r) * y) / sqrt(2), 6) AS pc2 FROM z")
def pca_plane(spark, d):
    return rounded(M.pca_scores(t(spark, d, "part"), ["p_size", "p_retailprice"]).select("p_partkey", "pc1", "pc2"))


@query()
def pca(spark, d):
    return rounded(M.pca(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linreg(spark, d):
    beta, _, _ = M.least_squares(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(beta[1]), 4), round(float(beta[0]), 3))], "slope double, intercept double")


@query("WITH f AS (SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p FROM lineitem) SELECT round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2 FROM f, (SELECT avg(y) AS m FROM f)")
def reg_metrics(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500.0 * F.col("l_quantity")).alias("p"))
    return M.regression_metrics(x, "y", "p").select(F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query()
def logreg(spark, d):
    x = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_orderkey") % 3).cast("double").alias("label"))
    return M.class_report(M.logistic(x, ["l_quantity", "l_extendedprice"], "label"), "label", "prediction")


@query("""WITH x AS (SELECT quality AS y, toxic AS p FROM labels), c AS (SELECT l.label, count(*) FILTER (WHERE y = label) AS s, count(*) FILTER (WHERE p = label) AS c, count(*) FILTER (WHERE y = label AND p = label) AS h FROM x, (VALUES (0), (1)) l(label) GROUP BY 1)
SELECT label, s AS support, round(CASE WHEN c > 0 THEN h / c ELSE 0 END, 6) AS precision, round(CASE WHEN s > 0 THEN h / s ELSE 0 END, 6) AS recall, round(CASE WHEN h > 0 THEN 2 * (h / c) * (h / s) / (h / c + h / s) ELSE 0 END, 6) AS f1 FROM c""")
def class_report(spark, d):
    return rounded(M.class_report(t(spark, d, "labels"), "quality", "toxic"))


@query("SELECT round(avg(hit), 6) AS balanced_accuracy FROM (SELECT quality, avg(CAST(quality = toxic AS INT)) AS hit FROM labels GROUP BY 1)")
def balanced_accuracy(spark, d):
    return rounded(M.balanced_accuracy(t(spark, d, "labels"), "quality", "toxic"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, d):
    return t(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


MISSING = " UNION ALL ".join(f"""SELECT '{c}' AS col, (avg(x) FILTER (WHERE m) - avg(x) FILTER (WHERE NOT m)) / sqrt(((count(*) FILTER (WHERE m) - 1) * var_samp(x) FILTER (WHERE m) + (count(*) FILTER (WHERE NOT m) - 1) * var_samp(x) FILTER (WHERE NOT m)) / (count(*) - 2)
* (1 / count(*) FILTER (WHERE m) + 1 / count(*) FILTER (WHERE NOT m))) AS t, sum(r) FILTER (WHERE m) - count(*) FILTER (WHERE m) * (count(*) FILTER (WHERE m) + 1) / 2 AS u
FROM (SELECT p_partkey % 3 = 0 AS m, {c}::DOUBLE AS x, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r FROM part)""" for c in ("p_size", "p_retailprice"))


@query(f"SELECT col, round(t, 6) AS t, round(u, 6) AS u FROM ({MISSING})")
def missingness_stats(spark, d):
    return missingness_tests(spark, d).select("col", "t", "u")


@query()
def missingness_tests(spark, d):
    return rounded(M.missingness_tests(t(spark, d, "part"), F.col("p_partkey") % 3 == 0, ["p_size", "p_retailprice"]))


@query()
def missingness_report(spark, d):
    part = t(spark, d, "part").withColumn("v", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))).withColumn("odd", F.col("p_partkey") % 2)
    return M.missingness_report(part, "v", ["p_size", "p_retailprice", "odd"])


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT a, b, (SELECT sum(n) FROM c x WHERE x.a = p.a) * (SELECT sum(n) FROM c x WHERE x.b = q.b) / (SELECT sum(n) FROM c) AS e FROM (SELECT DISTINCT a FROM c) p, (SELECT DISTINCT b FROM c) q)
SELECT round(sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e), 5) AS stat, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM g LEFT JOIN c USING (a, b)""")
def chi_square(spark, d):
    return M.chi_square(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("stat", 5).alias("stat"), "dof")


@query()
def kernel_spectrum(spark, d):
    df, v = _vectors(spark, d)
    return rounded(M.kernel_spectrum(df, "vec_id", v))


@query()
def kernel_spectrum_poly(spark, d):
    df, v = _vectors(spark, d)
    return rounded(M.kernel_spectrum(df, "vec_id", v, "poly"), 4)


@query()
def mds(spark, d):
    df, v = _vectors(spark, d)
    return M.mds_plane(df, "vec_id", v).select("vec_id", F.round("x1", 6).alias("x"), F.round("x2", 6).alias("y"))


# --- tables as graph stores hold them, checks on them, previews


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def upsert_nodes(spark, d):
    return S.upsert(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").withColumn("row", F.col("o_orderkey")), ["o_custkey"], "row").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT * FROM (VALUES (0, 'n_nationkey', (SELECT count(n_nationkey) FROM nation)), (1, 'n_name', (SELECT count(n_name) FROM nation)), (2, 'n_regionkey', (SELECT count(n_regionkey) FROM nation))) v(position, col, filled)")
def preview(spark, d):
    return S.preview(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")).drop("type")


@query("SELECT doc_id IS NULL AS doc_id, source IS NULL AS source FROM (SELECT nullif(doc_id, 3) AS doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS source, lang FROM documents)")
def null_mask(spark, d):
    x = t(spark, d, "documents").select(F.nullif("doc_id", F.lit(3)).alias("doc_id"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"), F.lit("x").alias("lang"))
    return S.null_mask(x)


@query("SELECT label, count(*) AS n FROM (SELECT 'nation' AS label FROM nation UNION ALL SELECT 'region' FROM region UNION ALL SELECT 'part' FROM part) GROUP BY 1")
def label_counts(spark, d):
    rows = [t(spark, d, name).select(F.array(F.lit(name)).alias("labels")) for name in ("nation", "region", "part")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def frame_rollback(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    back = []
    for how in ("codes", "dummy"):
        rows, plan = S.encode_frame(x, ["o_orderstatus"], how)
        back.append(S.decode_frame(rows, plan))
    return back[0].intersect(back[1])


@query("SELECT bin, CAST(sum(CASE WHEN odd THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN odd THEN 0 ELSE 1 END) AS BIGINT) AS b FROM (SELECT o_orderkey % 2 = 1 AS odd, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) GROUP BY bin")
def hist_pair(spark, d):
    o = t(spark, d, "orders")
    return ST.histogram_pair(o.filter("o_orderkey % 2 = 1"), o.filter("o_orderkey % 2 <> 1"), "o_totalprice", 30)


# --- further statistics and imputation


@query("SELECT p_partkey, round((p_size - a) / (b - a), 6) AS p_size, round((p_retailprice - c) / (e - c), 6) AS p_retailprice FROM part, (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part)")
def minmax_scaling(spark, d):
    return rounded(ST.scaled(t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "minmax"))


@query("""WITH c AS (SELECT l_linenumber AS k, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1),
s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c), j AS (SELECT p, q, (p + q) / 2 AS m FROM s)
SELECT round(CASE WHEN bool_or(p > 0 AND q = 0) THEN NULL ELSE sum(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END) END, 9) AS kl,
round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 9) AS js FROM j""")
def divergence(spark, d):
    r = F.col("l_returnflag") == "R"
    return rounded(ST.divergence(t(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(r).alias("a"), F.count_if(~r).alias("b")), "a", "b"), 9)


@query("SELECT round(corr(CAST(l_returnflag = 'R' AS INT), l_quantity), 6) AS r, count(*) AS n FROM lineitem")
def point_biserial(spark, d):
    return rounded(ST.point_biserial(t(spark, d, "lineitem").withColumn("back", F.col("l_returnflag") == "R"), "back", "l_quantity"))


@query("""WITH c AS (SELECT l_linenumber AS x, l_quantity AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x),
q AS (SELECT sum(n) AS n, sum(n) * (sum(n) - 1) / 2 AS pairs, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY x)) AS tx, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY y)) AS ty FROM c)
SELECT round(s / sqrt((pairs - tx) * (pairs - ty)), 6) AS tau, CAST(n AS BIGINT) AS n FROM s, q""")
def kendall(spark, d):
    return rounded(ST.kendall(t(spark, d, "lineitem"), "l_linenumber", "l_quantity"))


Z = ", ".join(f"({k}, {(k + 0.5) / 100}, {NormalDist().inv_cdf((k + 0.5) / 100)!r})" for k in range(100))


@query(f"WITH z(k, p, z) AS (VALUES {Z}), q AS (SELECT quantile_cont(c_acctbal, [{', '.join(str((k + 0.5) / 100) for k in range(100))}]) AS q, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) SELECT CAST(k AS INT) AS k, round(q[k + 1], 6) AS x, round(m + s * z, 6) AS normal FROM z, q")
def qq_normal(spark, d):
    return rounded(ST.qq_normal(t(spark, d, "customer"), "c_acctbal", 100))


GAPS = f"{DAILY}, g AS (SELECT t, CASE WHEN day(t) % 7 <> 0 THEN x END AS x, row_number() OVER (ORDER BY t) AS i FROM daily)"


def _gaps(spark, d):
    return daily(spark, d).withColumn("x", F.when(F.dayofmonth("t") % 7 != 0, F.col("x")))


@query(f"WITH {GAPS}, m AS (SELECT avg(x) AS a, quantile_cont(x, 0.5) AS b FROM g) SELECT t, round(coalesce(x, a), 4) AS mean, round(coalesce(x, b), 4) AS median, round(coalesce(x, -1), 4) AS const FROM g, m")
def impute_simple(spark, d):
    x = _gaps(spark, d).select("t", *(F.col("x").alias(c) for c in ("mean", "median", "const")))
    return rounded(W.imputed(W.imputed(W.imputed(x, "mean", "mean"), "median", "median"), "const", "const", value=-1.0), 4)


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), (SELECT min(f) FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 QUALIFY n = max(n) OVER ()))) AS flag FROM lineitem")
def impute_mode(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return W.imputed(x, "flag", "mode")


@query(f"""WITH {GAPS}, w AS (SELECT t, x, i, last_value(x IGNORE NULLS) OVER b AS x0, first_value(x IGNORE NULLS) OVER a AS x1, max(CASE WHEN x IS NOT NULL THEN i END) OVER b AS i0, min(CASE WHEN x IS NOT NULL THEN i END) OVER a AS i1
FROM g WINDOW b AS (ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT t, round(x0, 4) AS filled, round(CASE WHEN x IS NOT NULL OR x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (i - i0) / (i1 - i0) END, 4) AS line FROM w""")
def impute_ordered(spark, d):
    x = _gaps(spark, d).select("t", F.col("x").alias("filled"), F.col("x").alias("line"))
    return rounded(W.imputed(W.imputed(x, "filled", "ffill", "t"), "line", "interpolate", "t"), 4)


# --- small sources and shapes


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN '2015-02-30' WHEN o_orderkey % 3 = 1 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day FROM orders")
def date_coerced(spark, d):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, "2015-02-30").when(k == 1, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(spark, d, "orders").select("o_orderkey", C.date_coerced(s).alias("day"))


@query("SELECT s_suppkey, CASE WHEN lat <= 90 THEN lon END AS lon, CASE WHEN lat <= 90 THEN lat END AS lat FROM (SELECT s_suppkey, CAST(s_suppkey % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey % 100 AS DOUBLE) AS lat FROM supplier)")
def points(spark, d):
    p = t(spark, d, "supplier").select("s_suppkey", C.point(F.col("s_suppkey") % 360 - 180, F.col("s_suppkey") % 100).alias("p"))
    return p.select("s_suppkey", "p.lon", "p.lat")


@query("SELECT * FROM (VALUES ('a', 1), ('a', 2), ('b', 3)) v(name, k)")
def list_source(spark, d):
    rows = spark.createDataFrame([("a", [1, 2]), ("b", [3]), ("c", [])], "name string, ks array<int>")
    return rows.select("name", F.explode("ks").alias("k"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, ' ') THEN substr(p_type, instr(p_type, ' ') + 1) ELSE p_type END AS rest, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE p_brand END AS number FROM part")
def prefix_split(spark, d):
    return t(spark, d, "part").select("p_partkey", C.after_prefix(F.col("p_type"), " ").alias("rest"), C.after_prefix(F.col("p_brand"), "#").alias("number"))


@query("SELECT label, position, n FROM (VALUES ('R', 0), ('X', 1), ('A', 2)) l(label, position) LEFT JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) ON l_returnflag = label")
def reindexed(spark, d):
    labels = spark.createDataFrame([(c, k) for k, c in enumerate("RXA")], "label string, position int")
    n = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return labels.join(n, "label", "left")


@query("SELECT c_custkey, c_name FROM customer")
def positional_slice(spark, d):
    c = t(spark, d, "customer")
    return c.select(c.columns[:2])


@query("SELECT CAST(part AS INT) AS part, n FROM (VALUES (0, 500::BIGINT), (1, 300::BIGINT), (2, 200::BIGINT)) v(part, n)")
def mixture_sizes(spark, d):
    return mixture(spark, [(500, 10, 2), (300, 20, 3), (200, 35, 5)]).groupBy("part").agg(F.count("x").alias("n"))


# --- key-value states


KV_STATES = "kv AS (SELECT CAST(o_orderkey % 3 AS INT) AS node, o_custkey % 50 AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY ALL)"


def _kv(spark, d):
    k = F.col("o_orderkey")
    return KV.written(t(spark, d, "orders").select((k % 3).cast("int").alias("node"), (F.col("o_custkey") % 50).alias("key"), F.col("o_orderstatus").alias("value"), k.alias("at")), "at")


@query(f"WITH {KV_STATES} SELECT * FROM kv")
def kv_states(spark, d):
    return _kv(spark, d)


@query(f"WITH {KV_STATES} SELECT key, value FROM kv WHERE node = 1")
def kv_scan(spark, d):
    return KV.scan(_kv(spark, d), 1)


@query(f"WITH {KV_STATES} SELECT value FROM kv WHERE node = 1 AND key = 7")
def kv_read(spark, d):
    return KV.read_key(_kv(spark, d), 1, 7)


@query(f"""WITH {KV_STATES}, two AS (SELECT * FROM kv UNION ALL SELECT 3, key, value FROM kv WHERE node = 1), n AS (SELECT DISTINCT node FROM two)
SELECT a.node AS a, b.node AS b, NOT EXISTS (SELECT 1 FROM (SELECT key, value FROM two WHERE node = a.node) x FULL JOIN (SELECT key, value FROM two WHERE node = b.node) y ON x.key = y.key WHERE x.key IS NULL OR y.key IS NULL OR x.value IS DISTINCT FROM y.value) AS same
FROM n a JOIN n b ON a.node < b.node""")
def kv_agreement(spark, d):
    s = _kv(spark, d)
    return KV.agreement(s.unionByName(s.filter("node = 1").withColumn("node", F.lit(3))))


@query(f"""WITH {KV_STATES} SELECT 'available' AS verdict, (SELECT count(*) = count(value) FROM kv) AS holds UNION ALL
SELECT 'consistent', (SELECT max(n) = 1 AND min(k) = (SELECT count(DISTINCT node) FROM kv) FROM (SELECT key, count(DISTINCT value) AS n, count(*) AS k FROM kv GROUP BY 1)) UNION ALL SELECT 'tolerant', (SELECT bool_and(l_quantity > 0 AND l_discount >= 0 AND l_tax >= 0) FROM lineitem WHERE l_linenumber = 1)""")
def kv_verdicts(spark, d):
    parts = t(spark, d, "lineitem").filter("l_linenumber = 1").select((F.col("l_quantity") > 0).alias("disconnected"), (F.col("l_discount") >= 0).alias("reconnected"), (F.col("l_tax") >= 0).alias("success_during"))
    return KV.verdicts(_kv(spark, d).select("value"), _kv(spark, d), parts)


# --- micro-benchmarks


@query("SELECT action, CAST(n AS BIGINT) AS n FROM (VALUES ('rows', 1000000), ('filtered', 500000), ('groups', 100), ('repartitioned', 1000000)) v(action, n)")
def bench_mem(spark, d):
    return bench.memory(spark)


@query("SELECT i % 100 AS group_key, CAST(sum(154) AS BIGINT) AS total_len, count(*) AS row_count FROM range(500000) r(i) GROUP BY 1")
def bench_hdd(spark, d):
    return bench.disk(spark).drop("total_value")  # of random numbers


@query("SELECT a.i % 10 AS key1, b.j % 50 AS key2, CAST(sum(12) AS BIGINT) AS len1, CAST(sum(12) AS BIGINT) AS len2, count(*) AS n FROM range(500000) a(i) JOIN range(500000) b(j) ON a.i = b.j + 100 GROUP BY ALL")
def bench_network(spark, d):
    return bench.network(spark)


@query()
def bench_cpu(spark, d):
    return bench.cpu(spark)
