"""Descriptive statistics, distances of distributions, and correlations, in long form where one pass serves all columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, col, x) with x double; null and NaN values are left out."""
    cells = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(*keys, F.explode(cells).alias("_e")).select(*keys, "_e.col", "_e.x").filter("x is not null and not isnan(x)")


STRIPES = 64


def ranged(values: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Rows (col, x, counts) with distinct x in each col and, for each count c, before_c (its sum over smaller x), all_c (over all x), and after (the next
    larger x, null for the largest).

    The values are checkpointed first, as they are read three times. A column's values are dealt to stripes between approximate quantiles, so no task holds all of them; sums of whole stripes, at most STRIPES + 1 a
    column, are added up and joined back. The borders are constants of the plan: a task that is run again deals its rows alike."""
    from .graph import checkpointed

    values = checkpointed(values)
    shares = F.array(*(F.lit(k / STRIPES) for k in range(1, STRIPES)))
    borders = values.groupBy("col").agg(F.percentile_approx("x", shares, 10_000).alias("e")).collect()  # a row for each column
    stripe = F.lit(0)
    for r in borders:
        inside = F.size(F.filter(F.array(*map(F.lit, sorted(set(r["e"])))), lambda e: e < F.col("x")))
        stripe = F.when(F.col("col") == r["col"], inside).otherwise(stripe)
    rows = values.withColumn("_s", stripe)
    heads = rows.groupBy("col", "_s").agg(F.min("x").alias("_head"), *(F.sum(c).alias(f"_in_{c}") for c in counts))
    order, whole, inside = Window.partitionBy("col").orderBy("_s"), Window.partitionBy("col"), Window.partitionBy("col", "_s").orderBy("x")
    lower = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = [lower(f"_in_{c}", order).alias(f"_off_{c}") for c in counts]
    heads = heads.select("col", "_s", F.lead("_head").over(order).alias("_ahead"), *offsets, *(F.sum(f"_in_{c}").over(whole).alias(f"all_{c}") for c in counts))
    out = rows.select("*", F.lead("x").over(inside).alias("_lead"), *(lower(c, inside).alias(f"_low_{c}") for c in counts)).join(F.broadcast(heads), ["col", "_s"])
    sums = {f"before_{c}": F.col(f"_off_{c}") + F.col(f"_low_{c}") for c in counts}
    return out.withColumns(sums | {"after": F.coalesce("_lead", "_ahead")}).drop("_s", "_ahead", "_lead", *(f"_{k}_{c}" for k in ("off", "low") for c in counts))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(col, q): exact quantiles with linear interpolation, in the order of the shares, for columns that have a value."""
    at = ranged(melt(df, columns).groupBy("col", "x").agg(F.count("*").alias("n")), ["n"])
    parts = []
    for k, share in enumerate(shares):
        h = F.lit(float(share)) * (F.col("all_n") - 1)
        held = lambda i: (F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n"))
        parts += [F.max(F.when(held(F.floor(h)), F.col("x"))).alias(f"_a{k}"), F.max(F.when(held(F.ceil(h)), F.col("x"))).alias(f"_b{k}"), F.max(h - F.floor(h)).alias(f"_w{k}")]
    row = at.groupBy("col").agg(*parts)
    return row.select("col", F.array(*((1 - F.col(f"_w{k}")) * F.col(f"_a{k}") + F.col(f"_w{k}") * F.col(f"_b{k}") for k in range(len(shares)))).alias("q"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = melt(df, columns).groupBy("col").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.join(F.broadcast(quantiles(df, columns, [0.25, 0.5, 0.75])), "col")  # a row for each column
    return out.select("col", "n", "mean", "std", "min", *(F.col("q")[k].alias(f"q{p}") for k, p in enumerate((25, 50, 75))), "max")


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Normalised Shannon entropy of a column's values (null excluded); 0 for one value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    total = counts.agg(F.sum("count").alias("_t"), F.count("*").alias("_k"))
    p = F.col("count") / F.col("_t")
    out = counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("h"), F.max("_k").alias("k"))  # one row meets the counts
    return out.select(F.when(F.col("k") > 1, F.col("h") / F.log2(F.col("k").cast("double"))).otherwise(F.lit(0.0)).alias("entropy"))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("col"), (F.col("_n") - F.col(c)).alias("missing")) for c in columns))
    return counts.select(F.explode(cells).alias("e")).select("e.col", "e.missing")


def nearest_quantiles(df: DataFrame, column: str, n: int) -> DataFrame:
    """(k, x): element at index round-half-even(k / (n - 1) * (count - 1)) of the sorted values."""
    values = melt(df, [column]).groupBy("col", "x").agg(F.count("*").alias("n"))
    total = values.agg((F.sum("n") - 1).alias("last"))
    asked = total.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), F.rint(k / float(n - 1) * F.col("last")).alias("at")))).alias("e")).select("e.k", "e.at")
    return ranged(values, ["n"]).join(F.broadcast(asked), (F.col("at") >= F.col("before_n")) & (F.col("at") < F.col("before_n") + F.col("n"))).select("k", "x")  # n rows


def qq_pairs(a: DataFrame, b: DataFrame, column: str, n: int) -> DataFrame:
    return nearest_quantiles(a, column, n).withColumnRenamed("x", "a").join(nearest_quantiles(b, column, n).withColumnRenamed("x", "b"), "k")


def wasserstein(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, distance): area between the two distribution functions, over counts of distinct values."""
    both = melt(a, columns).groupBy("col", "x").agg(F.count("*").alias("p")).withColumn("q", F.lit(0).cast("long"))
    both = both.unionByName(melt(b, columns).groupBy("col", "x").agg(F.count("*").alias("q")).withColumn("p", F.lit(0).cast("long")))
    both = both.groupBy("col", "x").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    gap = F.abs((F.col("before_p") + F.col("p")) / F.col("all_p") - (F.col("before_q") + F.col("q")) / F.col("all_q"))
    return ranged(both, ["p", "q"]).select("col", (gap * (F.col("after") - F.col("x"))).alias("d")).groupBy("col").agg(F.sum("d").alias("distance"))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs in one aggregation."""
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(columns, 2)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in combinations(columns, 2)))
    return row.select(F.explode(cells).alias("e")).select("e.a", "e.b", "e.r")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of average ranks; ranks come from counts of distinct values, so ties cost nothing."""
    base = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    for c in columns:
        counts = base.groupBy(F.lit(c).alias("col"), F.col(c).alias("x")).agg(F.count("*").alias("n"))
        ranks = ranged(counts, ["n"]).select(F.col("x").alias(c), (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"_r_{c}"))
        base = base.join(ranks, c)
    return pearson(base.select(*(F.col(f"_r_{c}").alias(c) for c in columns)), columns)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n), bins from 0, the last one closed."""
    limits = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null").crossJoin(F.broadcast(limits))  # one row
    k = F.least(F.floor((F.col("x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))
    return x.select(k.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def histogram_pair(a: DataFrame, b: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, a, b): counts of two tables over the same equal bins of their common range, the last one closed."""
    both = a.select(F.col(column).cast("double").alias("x"), F.lit(1).alias("a")).unionAll(b.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("a"))).filter("x is not null")
    x = both.crossJoin(F.broadcast(both.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))))  # one row
    k = F.least(F.floor((F.col("x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    return x.groupBy(k.alias("bin")).agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))


def scaled(df: DataFrame, columns: Sequence[str], how: str = "standard") -> DataFrame:
    """Columns by population standard deviation, min-max, or median and interquartile range; constants become 0."""
    if how == "robust":
        q = {r["col"]: r["q"] for r in quantiles(df, columns, [0.25, 0.5, 0.75]).collect()}  # a row for each column
        pairs = {c: (q[c][1], q[c][2] - q[c][0]) if c in q else (None, None) for c in columns}
        out = df.withColumns({f"_{k}_{c}": F.lit(v).cast("double") for c, pair in pairs.items() for k, v in zip("ab", pair, strict=True)})
    else:
        aggs = []
        for c in columns:
            x = F.col(c)
            aggs += [F.avg(x).alias(f"_a_{c}"), F.stddev_pop(x).alias(f"_b_{c}")] if how == "standard" else [F.min(x).alias(f"_a_{c}"), (F.max(x) - F.min(x)).alias(f"_b_{c}")]
        out = df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row of parameters
    keep = [c for c in df.columns if c not in columns]
    return out.select(*keep, *(F.when(F.col(f"_b_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_b_{c}")).when(F.col(c).isNotNull(), F.lit(0.0)).alias(c) for c in columns))


def divergence(counts: DataFrame, a: str, b: str) -> DataFrame:
    """(kl, js) of the shares of two counts, one row for each bin, natural logarithms. kl is null where `a` has rows in a bin that `b` lacks
    (it is infinite) and both are null where a side has no rows; js is the mean of both sides' divergence from their mixture."""
    total = counts.agg(F.sum(a).alias("_na"), F.sum(b).alias("_nb"))  # one row
    shares = counts.crossJoin(F.broadcast(total)).filter("_na > 0 and _nb > 0").select((F.col(a) / F.col("_na")).alias("p"), (F.col(b) / F.col("_nb")).alias("q"))
    term = lambda x, y: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / y)).otherwise(0.0)
    middle = (F.col("p") + F.col("q")) / 2
    kl = F.when(F.max((F.col("p") > 0) & (F.col("q") == 0)), None).otherwise(F.sum(term("p", F.nullif("q", F.lit(0.0)))))
    return shares.agg(kl.alias("kl"), ((F.sum(term("p", middle)) + F.sum(term("q", middle))) / 2).alias("js"))


def point_biserial(df: DataFrame, flag: str, column: str) -> DataFrame:
    """(r, n): correlation of a boolean with a numeric column over the rows that have both."""
    both = df.select(F.col(flag).cast("boolean").cast("double").alias("_f"), F.col(column).cast("double").alias("_x")).dropna()
    return both.agg(F.corr("_f", "_x").alias("r"), F.count("*").alias("n"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """(tau, n): Kendall's tau-b, ties corrected, null where a column is constant. Pairs are counted by running sums over the table of distinct values
    of one column by those of the other, never row by row: for columns of few distinct values."""
    cells = df.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    grid = cells.select("x").distinct().crossJoin(cells.select("y").distinct()).join(cells, ["x", "y"], "left").fillna(0.0, ["n"])
    before = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    lower, whole = Window.partitionBy("x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("x")
    grid = grid.withColumn("_s", F.coalesce(F.sum("n").over(before), F.lit(0.0)))  # rows of this y and a smaller x
    less = F.coalesce(F.sum("_s").over(lower), F.lit(0.0))
    more = F.sum("_s").over(whole) - less - F.col("_s")
    score = grid.select("n", less.alias("less"), more.alias("more")).agg(F.sum(F.col("n") * (F.col("less") - F.col("more"))).alias("s"), F.sum("n").alias("n"))
    tied = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(name))
    row = score.crossJoin(tied("x", "_tx")).crossJoin(tied("y", "_ty"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    free = (pairs - F.col("_tx")) * (pairs - F.col("_ty"))
    return row.select(F.when(free > 0, F.col("s") / F.sqrt(free)).alias("tau"), F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"))


def qq_normal(df: DataFrame, column: str, n: int) -> DataFrame:
    """(k, x, normal): quantiles of the column at the shares (k + 1/2) / n (linear interpolation) beside those of the normal distribution of its mean and
    standard deviation."""
    at = [(k + 0.5) / n for k in range(n)]
    row = df.agg(F.percentile(column, F.array(*map(F.lit, at))).alias("_q"), F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = F.array(*(F.lit(NormalDist().inv_cdf(p)) for p in at))
    return row.select("_m", "_s", F.posexplode(F.arrays_zip(F.col("_q").alias("x"), z.alias("z"))).alias("k", "_e")).select("k", "_e.x", (F.col("_m") + F.col("_s") * F.col("_e.z")).alias("normal"))
