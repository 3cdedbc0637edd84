"""Models on bounded numbers of columns: covariance-based ones aggregate X'X in Spark and solve a small system at the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_quantile, chi2_sf, fisher_exact, normal_cdf, skew_test, t_two_sided
from .sampling import shuffled
from .windows import over


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of products of deviations from the means, in two aggregations: means first, so that large means don't cancel."""
    base = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    p = len(columns)
    row = base.agg(F.count("*"), *(F.avg(c) for c in columns)).first()
    n, near = row[0], np.array([v or 0.0 for v in row[1:]])
    d = [F.col(c) - float(m) for c, m in zip(columns, near, strict=True)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    row = base.agg(*(F.sum(x) for x in d), *(F.sum(d[i] * d[j]) for i, j in upper)).first()
    off = np.array([v or 0.0 for v in row[:p]])
    x = np.zeros((p, p))
    for (i, j), v in zip(upper, row[p:], strict=True):
        x[i, j] = x[j, i] = v or 0.0
    return n, near + off / max(n, 1), x - np.outer(off, off) / max(n, 1)


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    n, mean, x = moments(df, columns)
    return mean, x / max(n, 1)


def pca_scores(df: DataFrame, columns: Sequence[str], dims: int = 2) -> DataFrame:
    """All columns of df with pc1, pc2, ...: coordinates of scaled rows on the largest components. A component's largest loading is positive."""
    mean, cov = covariance(df, columns)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    out = df
    for k, i in enumerate(np.argsort(values)[::-1][:dims]):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(np.round(vectors[:, i], 9))), i])
        out = out.withColumn(f"pc{k + 1}", sum(((F.col(c).cast("double") - float(m)) * float(w / s) for c, m, w, s in zip(columns, mean, v, sd, strict=True)), F.lit(0.0)))
    return out


def pca(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """component, eigenvalue, share, cumulative share, and reconstruction error with that many components, of scaled columns."""
    _, cov = covariance(df, columns)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    values = np.sort(np.linalg.eigvalsh(cov / np.outer(sd, sd)))[::-1]
    share = values / values.sum()
    rows = [(k + 1, float(values[k]), float(share[k]), float(share[: k + 1].sum()), float(values[k + 1 :].sum() / len(columns))) for k in range(len(values))]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double, mse double")


def squared_distance(columns: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance as an expression; null where a column is null."""
    inv = np.linalg.pinv(cov)
    d = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean, strict=True)]
    total: Column = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            total = total + d[i] * d[j] * float(inv[i, j])
    return total


def mahalanobis(df: DataFrame, columns: Sequence[str], quantile: float = 0.95, robust: bool = False) -> DataFrame:
    """All columns with d2 and outlier; the limit is the chi-square quantile."""
    mean, cov = robust_covariance(df, columns) if robust else covariance(df, columns)
    return df.withColumn("d2", squared_distance(columns, mean, cov)).withColumn("outlier", F.col("d2") > chi2_quantile(quantile, len(columns)))


def robust_covariance(df: DataFrame, columns: Sequence[str], rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant: mean and covariance of the half of the rows with the smallest determinant, then of all rows within its 0.975 limit.

    Concentration steps from two fixed starts (medians with absolute deviations, and classical moments) are aggregations; a step keeps rows up to
    the distance's (approximate, 1e-4) quantile. Constant columns keep a variance of 0. Fewer rows than columns plus two: classical moments.
    """
    base = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    p = len(columns)

    def fit(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        upper = [(i, j) for i in range(p) for j in range(i, p)]
        row = rows.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in upper)).first()
        cov = np.zeros((p, p))
        for (i, j), v in zip(upper, row[1 + p :], strict=True):
            cov[i, j] = cov[j, i] = v or 0.0
        return row[0], np.array([v or 0.0 for v in row[1 : 1 + p]]), cov

    n, mean, cov = fit(base)
    if n < p + 2:
        return mean, cov
    middle = np.array(base.agg(*(F.percentile_approx(c, F.lit(0.5), 10_000) for c in columns)).first(), float)
    spread = np.array(base.agg(*(F.percentile_approx(F.abs(F.col(c) - float(m)), F.lit(0.5), 10_000) for c, m in zip(columns, middle, strict=True))).first(), float) * 1.4826
    spread = np.where(spread > 0, spread, np.sqrt(np.diag(cov)))
    share, best = (n + p + 1) // 2 / n, (math.inf, mean, cov)
    for m, s in ((middle, np.diag(spread**2)), (mean, cov)):
        last = math.inf
        for _ in range(rounds):
            d2 = squared_distance(columns, m, s)
            limit = base.agg(F.percentile_approx(d2, F.lit(share), 10_000)).first()[0]
            _, m, s = fit(base.filter(d2 <= limit))
            volume = float(np.linalg.det(s))
            if volume >= last * (1 - 1e-9):
                break
            last = volume
        if last < best[0]:
            best = (last, m, s)
    d2 = squared_distance(columns, best[1], best[2])
    scale = base.agg(F.percentile_approx(d2, F.lit(0.5), 10_000)).first()[0] / chi2_quantile(0.5, p)
    if not scale > 0:
        return best[1], best[2]
    _, mean, cov = fit(base.filter(d2 / scale < chi2_quantile(0.975, p)))
    return mean, cov


def solved(n: int, mean: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (intercept first), their standard errors and the sum of squared residuals, from moments whose last column is the target."""
    p = len(mean) - 1
    scale = np.sqrt(np.maximum(np.diag(x)[:p], 1e-300))
    inv = np.linalg.pinv(x[:p, :p] / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    slope = inv @ x[:p, p]
    rss = max(float(x[p, p] - slope @ x[:p, p]), 0.0)
    var = rss / max(n - p - 1, 1)
    first = var * (1 / max(n, 1) + mean[:p] @ inv @ mean[:p])
    return np.append(mean[p] - slope @ mean[:p], slope), np.sqrt(np.maximum(np.append(first, var * np.diag(inv)), 0)), rss


def least_squares(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (intercept first), their standard errors, and rows; normal equations from aggregated moments."""
    n, mean, x = moments(df, [*features, target])
    beta, se, _ = solved(n, mean, x)
    return beta, se, n


def predict(df: DataFrame, features: Sequence[str], beta: np.ndarray, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, sum((F.col(c) * float(b) for c, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0]))))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    m = df.agg(F.avg(y).alias("_m"))
    e = F.col(y) - F.col(p)
    return df.crossJoin(F.broadcast(m)).agg(F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.sum((F.col(y) - F.col("_m")) ** 2)).alias("r2"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, support, precision, recall, f1; undefined ratios are 0."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    hit = cells.filter("y = p").select(F.col("y").alias("label"), F.col("n").alias("hit"))
    rows = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    cols = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("called"))
    out = rows.join(cols, "label", "full").join(hit, "label", "left").fillna(0, ["support", "called", "hit"])
    precision = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return out.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def balanced_accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean recall over the labels that occur."""
    return class_report(df, y, p).filter("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def logistic(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Multinomial logistic regression with balanced class weights; adds prediction."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = df.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("_t"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("count"))).alias("_w"))
    base = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(df.join(F.broadcast(weights), label))
    base = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(base).transform(base)
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", family="multinomial", regParam=1e-4, maxIter=100).fit(base)
    return model.transform(base).drop("_raw", "_x", "_w", "rawPrediction", "probability")


def iterative_impute(df: DataFrame, key: str, columns: Sequence[str], rounds: int = 5) -> DataFrame:
    """Missing cells by regressions on the other columns, in turn; starts from means. Parameters only travel to the driver."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    work = df.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] or 0.0))).alias(c) for c in columns), *(F.col(c).isNull().alias(f"_m_{c}") for c in columns))
    gaps = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    for _ in range(rounds):
        for c in columns:
            if gaps[c]:
                others = [x for x in columns if x != c]
                beta, _, _ = least_squares(work.filter(~F.col(f"_m_{c}")), others, c)
                work = predict(work, others, beta, "_p").withColumn(c, F.when(F.col(f"_m_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_p")
        from .graph import checkpointed

        work = checkpointed(work)
    return work.select(key, *columns)


def lagged(df: DataFrame, x: str, order: str, lags: int) -> DataFrame:
    out = df.select(F.col(order).alias("t"), F.col(x).cast("double").alias("y"))
    return out.select("t", "y", *(F.lag("y", k).over(over("t")).alias(f"l{k}") for k in range(1, lags + 1)))


def ar_fit(df: DataFrame, x: str, order: str, lags: int) -> tuple[np.ndarray, list[float]]:
    """Coefficients of an autoregression (intercept first), and the last `lags` values, newest first.

    A sum of products of two lags depends on their difference but for the first and last steps: one join of the numbered series with itself
    by difference gives all sums, and the ends, at most 2 * lags values, are put right at the driver."""
    base = df.select(F.col(order).alias("t"), F.col(x).cast("double").alias("y")).filter("y is not null")
    shift = float(base.agg(F.avg("y")).first()[0] or 0.0)
    s = base.select((F.row_number().over(over("t"))).alias("i"), (F.col("y") - shift).alias("d"))
    later = s.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("h"), F.col("d").alias("e"), F.col("i").alias("j")).withColumn("i", F.col("j") + F.col("h"))
    sums = {r["h"]: r["s"] for r in s.join(later, "i").groupBy("h").agg(F.sum(F.col("d") * F.col("e")).alias("s")).collect()}
    whole = s.agg(F.count("*").alias("n"), F.sum("d").alias("s")).first()
    n, p = whole["n"], lags
    head = np.array([r["d"] for r in s.filter(F.col("i") <= p).orderBy("i").collect()])
    tail = np.array([r["d"] for r in s.filter(F.col("i") > n - p).orderBy("i").collect()])
    if n <= 2 * p + 1:
        raise ValueError(f"{n} steps are too few for {p} lags")
    m = n - p
    # total[k]: sum over the fitted steps of the value k steps before
    total = np.array([whole["s"] - head[: p - k].sum() - tail[p - k :].sum() for k in range(p + 1)])
    cross = np.zeros((p + 1, p + 1))
    for h in range(p + 1):
        first = np.concatenate([[0.0], np.cumsum(head[h:] * head[: p - h])])  # products that end by step h + 1, h + 2, ...
        last = np.concatenate([[0.0], np.cumsum((tail[h:] * tail[: p - h])[::-1])])
        for k in range(p + 1 - h):  # lags k and k + h
            cross[k, k + h] = cross[k + h, k] = sums.get(h, 0.0) - first[p - k - h] - last[min(k, p - h)]
    at = [*range(1, p + 1), 0]  # features, then the target
    mean = total[at] / m
    beta, _, _ = solved(m, mean + shift, cross[np.ix_(at, at)] - m * np.outer(mean, mean))
    return beta, [float(v) + shift for v in tail[::-1]]


def ar_forecast(df: DataFrame, x: str, order: str, lags: int, steps: int) -> DataFrame:
    """(step, forecast) of an autoregression with intercept."""
    beta, last = ar_fit(df, x, order, lags)
    out = []
    for s in range(steps):
        y = float(beta[0] + beta[1:] @ np.array(last[:lags]))
        out.append((s + 1, y))
        last.insert(0, y)
    return df.sparkSession.createDataFrame(out, "step int, forecast double")


def ar_order(df: DataFrame, x: str, order: str, most: int, period: int = 1) -> DataFrame:
    """(lags, bic, chosen) for 0 to `most` lags on the same steps; with a period, each step of it has its own intercept (lags and series
    are taken from their means by step of the period, which gives the same fit as indicators)."""
    names = [*(f"l{k}" for k in range(1, most + 1)), "y"]
    rows = lagged(df, x, order, most).withColumn("_s", (F.row_number().over(over("t")) - 1) % period).dropna()
    w = Window.partitionBy("_s")
    rows = rows.select(*((F.col(c) - F.avg(c).over(w)).alias(c) for c in names))
    n, mean, cross = moments(rows, names)
    out = []
    for k in range(most + 1):
        at = [*range(k), most]
        rss = solved(n, mean[at], cross[np.ix_(at, at)])[2]
        out.append((k, n * (math.log(2 * math.pi * rss / n) + 1) + (k + period + 1) * math.log(n)))
    best = min(range(most + 1), key=lambda k: out[k][1])
    return df.sparkSession.createDataFrame([(k, b, k == best) for k, b in out], "lags int, bic double, chosen boolean")


def adf_p(stat: float) -> float:
    """Approximate p of the Dickey-Fuller statistic with a constant."""
    # Response surface of the test's distribution.
    if stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    return normal_cdf(sum(c * stat**k for k, c in enumerate(small if stat <= -1.61 else large)))


def adf(df: DataFrame, x: str, order: str, lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: stat, p, lags, n and 1, 5 and 10 % values. Without `lags`, the number of lagged differences up to
    12 * (n / 100)^(1/4) of the least AIC on the same steps is taken."""
    base = df.select(F.col(order).alias("t"), F.col(x).cast("double").alias("y")).filter("y is not null")
    w = over("t")
    base = base.withColumn("before", F.lag("y").over(w)).withColumn("dy", F.col("y") - F.col("before"))
    count = base.count()
    most = min(math.ceil(12 * (count / 100) ** 0.25), count // 2 - 2) if lags is None else lags
    base = base.select("t", "before", "dy", *(F.lag("dy", k).over(w).alias(f"d{k}") for k in range(1, most + 1)))
    if lags is None:
        n, mean, cross = moments(base, ["before", *(f"d{k}" for k in range(1, most + 1)), "dy"])
        fits = []
        for k in range(most + 1):
            at = [*range(k + 1), most + 1]
            fits.append(n * math.log(max(solved(n, mean[at], cross[np.ix_(at, at)])[2], 1e-300) / n) + 2 * (k + 2))
        lags = int(np.argmin(fits))
    beta, se, n = least_squares(base, ["before", *(f"d{k}" for k in range(1, lags + 1))], "dy")
    stat = float(beta[1] / se[1])
    # Critical values of the test with a constant, as polynomials of 1 / n.
    critical = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))
    values = [sum(c / n**k for k, c in enumerate(row)) for row in critical]
    return df.sparkSession.createDataFrame([(stat, adf_p(stat), lags, n, *values)], "stat double, p double, lags int, n long, crit_1 double, crit_5 double, crit_10 double")


def pacf(r: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations (lag 0 first), by Durbin and Levinson."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        num = r[k] - float(phi @ np.array(r[k - 1 : 0 : -1])) if k > 1 else r[1]
        den = 1 - float(phi @ np.array(r[1:k])) if k > 1 else 1.0
        a = num / den
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return out


def missingness_tests(df: DataFrame, mask: Column, columns: Sequence[str]) -> DataFrame:
    """For each numeric column, t test and Mann-Whitney test of its values between rows with and without the mask."""
    from .stats import melt, ranged

    long = melt(df.withColumn("_m", mask.cast("int")), columns, ["_m"])
    g = {(r["col"], r["_m"]): r for r in long.groupBy("col", "_m").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")).collect()}
    counts = long.groupBy("col", "x").agg(F.count("*").alias("n"), F.sum("_m").alias("k"))
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    u = {r["col"]: r for r in ranged(counts, ["n"]).withColumn("rank", rank).groupBy("col").agg(F.sum(F.col("rank") * F.col("k")).alias("ranks"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties")).collect()}
    rows = []
    for c in columns:
        a, b = g.get((c, 1)), g.get((c, 0))
        if not a or not b or a["n"] < 2 or b["n"] < 2:
            continue
        n1, n0 = a["n"], b["n"]
        pooled = ((n1 - 1) * a["var"] + (n0 - 1) * b["var"]) / (n1 + n0 - 2)
        t = (a["mean"] - b["mean"]) / math.sqrt(pooled * (1 / n1 + 1 / n0)) if pooled > 0 else 0.0
        stat, n = u[c]["ranks"] - n1 * (n1 + 1) / 2, n1 + n0
        var = n1 * n0 / 12 * (n + 1 - u[c]["ties"] / (n * (n - 1)))
        z = (abs(stat - n1 * n0 / 2) - 0.5) / math.sqrt(var) if var > 0 else 0.0
        rows.append((c, float(t), t_two_sided(t, n - 2), float(stat), min(1.0, 2 * (1 - normal_cdf(z)))))
    return df.sparkSession.createDataFrame(rows, "col string, t double, t_p double, u double, u_p double")


def missingness_report(df: DataFrame, feature: str, columns: Sequence[str], least: int = 20) -> DataFrame:
    """How other columns differ between rows with and without `feature`: (col, test, missing, present, p), empty up to `least` missing values.

    Columns with at least ten values are numeric (others of that size get no test): medians [quartiles] - counts, Mann-Whitney where both skew tests reject at 0.05, pooled t test
    otherwise. Others are tabulated against missingness: Fisher's exact test for 2 x 2 tables with a cell below 5, else chi-square (Yates for 2 x 2).
    p is rounded to 3 places (chi-square 4), null where a test isn't defined.
    """
    from .stats import melt

    spark, schema = df.sparkSession, "col string, test string, missing string, present string, p double"
    base = df.withColumn("_m", F.col(feature).isNull())
    if base.filter("_m").limit(least + 1).count() <= least:
        return spark.createDataFrame([], schema)
    values = base.agg(*(F.count_distinct(c).alias(c) for c in columns)).first().asDict()
    numeric = [c for c, k in df.select(*columns).dtypes if values[c] >= 10 and k not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")]
    rows: list[tuple] = [(c, None, None, None, None) for c in columns if values[c] >= 10 and c not in numeric]
    if numeric:
        q = F.percentile("x", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
        parts = melt(base, numeric, ["_m"]).groupBy("col", "_m").agg(F.count("x").alias("n"), F.skewness("x").alias("skew"), q.alias("q")).collect()
        facts = {(r["col"], r["_m"]): r for r in parts}
        tests = {r["col"]: r for r in missingness_tests(base, F.col("_m"), numeric).collect()}
        for c in numeric:
            sides = [facts.get((c, m)) for m in (True, False)]
            told = ["{:.1f} [{:.1f}-{:.1f}] - {}".format(*r["q"], r["n"]) if r else None for r in sides]
            skewed = [skew_test(r["n"], math.nan if r["skew"] is None else r["skew"])[1] if r else math.nan for r in sides]
            if c not in tests or any(math.isnan(x) for x in skewed):
                rows.append((c, None, *told, None))
            else:
                name = "mann-whitney" if max(skewed) <= 0.05 else "t"
                rows.append((c, name, *told, round(tests[c]["u_p" if name == "mann-whitney" else "t_p"], 3)))
    for c in (c for c in columns if values[c] < 10):
        counts = base.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v"), "_m").count().collect()  # below 20 rows
        cell = {(r["v"], r["_m"]): r["count"] for r in counts}
        table = [[cell.get((v, m), 0) for m in (True, False)] for v in sorted({v for v, _ in cell})]
        told = ["; ".join(f"{v}: {cell[v, m]}" for v in sorted({v for v, _ in cell}) if (v, m) in cell) for m in (True, False)]
        flat, sums = [x for r in table for x in r], [sum(r[k] for r in table) for k in (0, 1)]
        if len(table) < 2 or not all(sums):
            rows.append((c, None, *told, None))
        elif len(table) == 2 and min(flat) < 5:
            rows.append((c, "fisher", *told, round(fisher_exact(*flat), 3)))
        else:
            total = sum(sums)
            pairs = [(x, sum(r) * s / total) for r in table for x, s in zip(r, sums, strict=True)]
            shift = 0.5 if len(table) == 2 else 0.0
            stat = sum((abs(x - e) - min(shift, abs(x - e))) ** 2 / e for x, e in pairs)
            rows.append((c, "chi-square", *told, round(chi2_sf(stat, len(table) - 1), 4)))
    return spark.createDataFrame(rows, schema)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """stat, dof, p of independence."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy(a).agg(F.sum("n").alias("ra")), cells.groupBy(b).agg(F.sum("n").alias("rb"))
    total = cells.agg(F.sum("n").alias("t"))
    grid = ra.crossJoin(rb).join(cells, [a, b], "left").crossJoin(F.broadcast(total))  # category by category, not row by row
    e = F.col("ra") * F.col("rb") / F.col("t")
    row = grid.agg(F.sum((F.coalesce("n", F.lit(0)) - e) ** 2 / e).alias("stat"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof")).first()
    return df.sparkSession.createDataFrame([(row["stat"], row["dof"], chi2_sf(row["stat"] or 0.0, max(row["dof"], 1)))], "stat double, dof long, p double")


def sinkhorn(m: np.ndarray, rounds: int = 100, tol: float = 1e-7) -> np.ndarray:
    """Rows and columns of a small non-negative matrix balanced to sum to 1."""
    m = np.maximum(np.asarray(m, float), 1e-12)
    for _ in range(rounds):
        old = m
        m = m / m.sum(axis=1, keepdims=True)
        m = m / m.sum(axis=0, keepdims=True)
        if np.abs(m - old).max() < tol:
            break
    return m


def mds(distances: np.ndarray, dims: int = 2) -> np.ndarray:
    """Classical scaling of a small matrix of distances; mds_plane does it for tables of vectors."""
    n = len(distances)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (distances**2) @ j)
    top = np.argsort(values)[::-1][:dims]
    return vectors[:, top] * np.sqrt(np.maximum(values[top], 0))


def products(df: DataFrame, v: Column, features: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, feature sums and sums of feature products over all rows with a vector. A task sums its batches to width * (width + 1) cells, which
    Spark adds up, so neither a task nor the driver holds more than that whatever the rows."""

    def run(batches):
        n, sums, total = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if len(batch):
                f = features(np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float))
                n, sums, total = n + len(f), sums + f.sum(axis=0), total + f.T @ f
        cells = np.concatenate([[n], sums, total.ravel()])
        if n:
            for a in range(0, len(cells), 1 << 16):
                part = cells[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array(part)], ["cell", "value"])

    out = np.zeros(1 + width + width * width)
    sums = df.select(v.alias("v")).filter("v is not null").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    table = sums.toArrow()
    out[table["cell"].to_numpy()] = table["value"].to_numpy()
    return int(out[0]), out[1 : 1 + width], out[1 + width :].reshape(width, width)


def mds_plane(df: DataFrame, key: str, v: Column, dims: int = 2) -> DataFrame:
    """key, x1, x2, ...: classical scaling of the Euclidean distances of all vectors. Its coordinates are those on the largest components of the
    centred vectors, so no distance matrix is made. A component's largest loading is positive; rows without a vector get nulls."""
    first = df.select(v.alias("v")).filter("v is not null").first()
    near = np.array(first[0] if first else [0.0] * dims, dtype=float)
    n, sums, x = products(df, v, lambda rows: rows - near, len(near))
    off = sums / max(n, 1)
    _, vectors = np.linalg.eigh(x - n * np.outer(off, off))
    cells = []
    for k in range(dims):
        w = vectors[:, -1 - k]
        w = w * np.sign(w[np.argmax(np.abs(np.round(w, 9)))])
        parts = F.zip_with(v, F.array(*map(F.lit, (near + off).tolist())), lambda a, m: a - m)
        cells.append(F.aggregate(F.zip_with(parts, F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a).alias(f"x{k + 1}"))
    return df.select(key, *cells)


def kernel_spectrum(df: DataFrame, key: str, v: Column, kind: str = "rbf", gamma: float = 0.1, top: int = 20, landmarks: int = 512) -> DataFrame:
    """(component, eigenvalue): the largest eigenvalues of the centred kernel matrix of all vectors, rbf or (x.y + 1)^2.

    Every row enters, by its kernel values with `landmarks` vectors (Nystroem features): the matrix of all pairs is never made, work grows with
    the rows. Exact while there are no more vectors than landmarks, or the kernel's rank is no larger than theirs; else a lower bound of
    each eigenvalue, closer the more landmarks there are.
    """
    rows = df.select(key, v.alias("v")).filter("v is not null")
    marks = np.array([r[0] for r in rows.orderBy(shuffled([key], 1), key).limit(landmarks).select("v").collect()], dtype=float)
    if not len(marks):
        return df.sparkSession.createDataFrame([], "component int, eigenvalue double")

    def kernel(a: np.ndarray) -> np.ndarray:
        dots = a @ marks.T
        if kind != "rbf":
            return (dots + 1) ** 2
        return np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] + (marks * marks).sum(axis=1) - 2 * dots, 0))

    values, vectors = np.linalg.eigh(kernel(marks))
    kept = values > values[-1] * 1e-13
    root = vectors[:, kept] / np.sqrt(values[kept])
    n, sums, x = products(rows, F.col("v"), lambda a: kernel(a) @ root, root.shape[1])
    spectrum = np.linalg.eigvalsh(x - np.outer(sums, sums) / n)[::-1][: min(top, n)]
    return df.sparkSession.createDataFrame([(k + 1, float(e)) for k, e in enumerate(spectrum)], "component int, eigenvalue double")
