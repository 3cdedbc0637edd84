"""Pareto order sampling of documents to source targets, in DataFrame operations only.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share the total size; a target stops at 3 times
its source's size and the excess is shared again by weight. That water level is closed-form once sources are ordered by
capacity over weight. A source whose target is r times its size takes floor(r) certain whole copies of each document; the
rest is a sample of fixed size in words: document i has the inclusion probability p_i, proportional to the root of its
size, and documents are taken in the order of [u / (1 - u)] / [p_i / (1 - p_i)] (Pareto order) until the words are reached;
the document that crosses the mark is taken when that comes nearer.

The mark is found without sorting a source in one task: sizes are summed in 8192 bins of the order, a running sum over the
bins finds the bin with the mark, and only that bin's rows are ordered.

Defined results: null texts and texts without words have size 0 and are taken 0 words; null sources are one source, the
last; repeated rows of one id and text share their random number, and a number from their partition orders them; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, maybe_broadcast, word_array

BINS = 8192
MOST = 3


def targets(docs: DataFrame) -> DataFrame:
    """source, source_size, target, _root (sum of size^1.5); docs has source and size. One row for each source."""
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.sqrt("size") * F.col("size")).alias("_root"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    whole = Window.partitionBy(F.lit(1))
    by_cap = whole.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_cap", (MOST * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    per = per.withColumn("_total", F.sum("source_size").over(whole)).withColumn("_weights", F.sum("_w").over(whole))
    per = per.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(by_cap), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("_w").over(by_cap), F.lit(0.0))))
    # The level after capping all sources of a smaller ratio; the first source that it leaves uncapped sets it for good.
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    per = per.withColumn("_set", level)
    target = F.when(F.col("_set").isNull() | (F.col("_ratio") <= F.col("_set")), F.col("_cap")).otherwise(F.col("_w") * F.col("_set"))
    return per.select("source", "source_size", target.alias("target"), "_root")


def uniform(seed: str):
    """A number in (0, 1) from the md5 of id and seed: 52 bits, the same in every run and engine."""
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"|{seed}"))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def pareto_mix(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs."""
    return _plan(docs, seed).drop("_crc")


def mix_documents(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    A row is found again by id, source and checksum of its text; of rows that agree in all three, one stands for all of them,
    as often as they are taken in all."""
    keys = ["doc_id", "source", "_crc"]
    plan = _plan(docs, seed).groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_alike")).filter("_copies > 0")
    plan = maybe_broadcast(cut(plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_crc").alias("_c"), "_copies", "_alike")))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("_d")) & docs["source"].eqNullSafe(F.col("_s")) & (crc == F.col("_c")))
    cells = [F.col(f"`{c}`") for c in docs.columns]
    alike = rows.filter("_alike > 1").groupBy("_d", "_s", "_c", "_copies").agg(F.min_by(F.struct(*cells), F.xxhash64(*cells)).alias("_row"))
    once = rows.filter("_alike = 1").select(*cells, "_copies").unionAll(alike.select("_row.*", "_copies"))
    return once.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")


def _plan(docs: DataFrame, seed: str) -> DataFrame:
    base = docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"))
    base = cut(base.withColumn("_row", F.monotonically_increasing_id()))
    plan = maybe_broadcast(cut(targets(base)))
    # One row for each source: broadcast behind a check of its size, else a shuffle join that AQE may split.
    rows = base.join(plan, base["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_whole", F.floor(ratio + 1e-12)).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    p = F.least(F.lit(0.999999), F.when(F.col("_root") > 0, F.col("_rest") * F.sqrt("size") / F.col("_root")).otherwise(F.lit(0.0)))
    u = uniform(seed)
    rows = rows.withColumn("_q", F.when((F.col("size") > 0) & (F.col("_rest") > 0), (u / (1 - u)) * ((1 - p) / p)))
    rows = rows.withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS))
    bins = rows.filter("_bin is not null").groupBy("source", "_bin", "_rest").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = bins.withColumn("_before", before).filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
    marks = maybe_broadcast(cut(marks.select(F.col("source").alias("_s"), F.col("_bin").alias("_mark"), "_before")))  # one row a source at most
    rows = rows.join(marks, rows["source"].eqNullSafe(marks["_s"]), "left").drop("_s")
    at = F.when(F.col("_bin") == F.col("_mark"), F.col("_q"))
    edge = rows.filter(at.isNotNull())
    w = Window.partitionBy("source").orderBy("_q", "_crc", "_row").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_sofar", F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    edge = edge.withColumn("_in", (F.col("_sofar") + F.col("size") / 2 <= F.col("_rest")))
    rest = rows.filter(at.isNull()).withColumn("_in", F.col("_bin").isNotNull() & (F.col("_mark").isNull() | (F.col("_bin") < F.col("_mark"))))
    keep = ["doc_id", "size", "source", "source_size", "target", "_whole", "_in", "_crc"]
    out = rest.select(*keep).unionAll(edge.select(*keep))
    copies = (F.col("_whole") + F.coalesce(F.col("_in"), F.lit(False)).cast("int")).cast("long")
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))).select("doc_id", "size", "source", "source_size", F.round("target", 4).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "_crc")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(sqrt(size) * size) AS root,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0 * source_size / w AS ratio FROM s),
-- every candidate water level: cap all sources whose ratio is smaller
l AS (SELECT a.ratio, ((SELECT sum(source_size) FROM r) - coalesce((SELECT sum(3.0 * b.source_size) FROM r b WHERE b.ratio < a.ratio), 0))
             / (SELECT sum(c.w) FROM r c WHERE c.ratio >= a.ratio) AS level FROM r a),
v AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, root, CASE WHEN ratio <= (SELECT level FROM v) THEN 3.0 * source_size ELSE w * (SELECT level FROM v) END AS target FROM r),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
y AS (SELECT d.doc_id, d.size, d.u, x.*, greatest(0.0, target - whole * source_size) AS rest FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
z AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN (u / (1 - u)) * ((1 - least(0.999999, rest * sqrt(size) / root)) / least(0.999999, rest * sqrt(size) / root)) END AS q FROM y),
c AS (SELECT *, coalesce(sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM z)
SELECT doc_id, size, source, source_size, round(target, 4) AS target,
       CAST(CASE WHEN size > 0 THEN whole + CASE WHEN q IS NOT NULL AND sofar < rest AND sofar + size / 2.0 <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies,
       CAST(CASE WHEN size > 0 THEN whole + CASE WHEN q IS NOT NULL AND sofar < rest AND sofar + size / 2.0 <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) * size AS taken
FROM c
"""
