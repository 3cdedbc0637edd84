"""Windows over a time series: a DataFrame of (t, x) with one row a step, or with group columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf


def over(order: str, by: Sequence[str] = ()):
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)


def rolling_mean(x: str, order: str, size: int, centred: bool = False, least: int | None = None, by: Sequence[str] = ()) -> Column:
    a, b = (-(size // 2), (size - 1) // 2) if centred else (1 - size, 0)
    w = over(order, by).rowsBetween(a, b)
    return F.when(F.count(x).over(w) >= (size if least is None else least), F.avg(x).over(w))


def ewm_mean(df: DataFrame, x: str, order: str, halflife: float, name: str = "ewm", by: Sequence[str] = ()) -> DataFrame:
    """Adjusted exponentially weighted mean, ignoring missing values but not their steps."""
    n = F.row_number().over(over(order, by))
    total = F.count("*").over(Window.partitionBy(*(by or [F.lit(1)])))
    weight = F.pow(F.lit(2.0), (F.col("_n") - F.col("_t")) / halflife)
    w = over(order, by).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_n", n).withColumn("_t", total)
    return out.withColumn(name, F.sum(F.col(x) * weight).over(w) / F.sum(F.when(F.col(x).isNotNull(), weight)).over(w)).drop("_n", "_t")


def fill_both(x: Column, order: str, by: Sequence[str] = ()) -> Column:
    """Forward, then backward fill."""
    w = over(order, by)
    return F.coalesce(F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def fill_cascade(df: DataFrame, x: str, order: str, size: int = 365, shift: int = 45, halflife: float = 365.0) -> DataFrame:
    """Missing steps from the shifted rolling mean, else the exponential mean, else the nearest step."""
    out = ewm_mean(df.withColumn("_roll", rolling_mean(x, order, size)), x, order, halflife, "_ewm")
    out = out.withColumn("_shift", F.lag("_roll", shift).over(over(order)))
    out = out.withColumn("_x", F.coalesce(x, "_shift", "_ewm"))
    return out.withColumn(x, fill_both(F.col("_x"), order)).drop("_roll", "_ewm", "_shift", "_x")


def decompose(df: DataFrame, x: str, order: str, period: int, centred: bool = True) -> DataFrame:
    """trend, seasonal and resid of an additive model; odd periods."""
    w = over(order).rowsBetween(-(period // 2), period // 2) if centred else over(order).rowsBetween(1 - period, 0)
    out = df.withColumn("_i", F.row_number().over(over(order)) - 1)
    out = out.withColumn("trend", F.when(F.count("*").over(w) == period, F.avg(x).over(w)))
    out = out.withColumn("_p", F.col("_i") % period)
    means = out.groupBy("_p").agg(F.avg(F.col(x) - F.col("trend")).alias("_s"))
    means = means.crossJoin(F.broadcast(means.agg(F.avg("_s").alias("_m")))).select("_p", (F.col("_s") - F.col("_m")).alias("seasonal"))
    out = out.join(means, "_p", "left")
    return out.withColumn("resid", F.col(x) - F.col("trend") - F.col("seasonal")).drop("_i", "_p")


def split_series(df: DataFrame, order: str, trim: int, share: float = 0.8) -> DataFrame:
    """part 'train' or 'test' after trimming both ends."""
    out = df.withColumn("_i", F.row_number().over(over(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    cut = F.floor((F.col("_n") - 2 * trim) * share) + trim
    out = out.filter((F.col("_i") >= trim) & (F.col("_i") < F.col("_n") - trim))
    return out.withColumn("part", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_i", "_n")


def acf(df: DataFrame, x: str, order: str, lags: int) -> DataFrame:
    """(lag, r) for lags 0 to `lags`, in one join on the step number and one aggregation."""
    mean = df.agg(F.avg(x).alias("_m"))
    s = df.crossJoin(F.broadcast(mean)).select((F.row_number().over(over(order))).alias("i"), (F.col(x) - F.col("_m")).alias("d"))
    shifted = s.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), (F.col("i")).alias("j"), F.col("d").alias("e")).withColumn("i", F.col("j") + F.col("lag"))
    sums = s.join(shifted, "i").groupBy("lag").agg(F.sum(F.col("d") * F.col("e")).alias("c"))
    zero = s.agg(F.sum(F.col("d") * F.col("d")).alias("c0"))
    return sums.crossJoin(F.broadcast(zero)).select("lag", (F.col("c") / F.col("c0")).alias("r"))


def ljung_box(df: DataFrame, x: str, order: str, lags: int) -> DataFrame:
    """(lag, q)."""
    n = df.agg(F.count(x).alias("n"))
    r = acf(df, x, order, lags).filter("lag > 0").crossJoin(F.broadcast(n))
    term = F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))
    return r.select("lag", (F.col("n") * (F.col("n") + 2) * F.sum(term).over(over("lag").rowsBetween(Window.unboundedPreceding, 0))).alias("q"))


def ljung_box_test(df: DataFrame, x: str, order: str, lags: int) -> DataFrame:
    """(lag, q, p); one row a lag at the driver."""
    rows = [(r["lag"], r["q"], chi2_sf(r["q"], r["lag"])) for r in ljung_box(df, x, order, lags).orderBy("lag").collect()]
    return df.sparkSession.createDataFrame(rows, "lag int, q double, p double")


def denoised(df: DataFrame, x: str, order: str, period: int, trend: bool = False) -> DataFrame:
    """The series without its seasonal part (and without trend if asked), from a trailing decomposition that knows nothing of the future, in
    column `denoised`; `noise` is what was taken away, so a forecast gets it back by date."""
    out = decompose(df, x, order, period, centred=False)
    noise = F.col("seasonal") + F.col("trend") if trend else F.col("seasonal")
    return out.withColumn("noise", noise).withColumn("denoised", F.col(x) - F.col("noise")).drop("trend", "seasonal", "resid")


def with_noise(forecast: DataFrame, noise: DataFrame, order: str, name: str = "forecast") -> DataFrame:
    """A forecast with the noise of the same steps added."""
    return forecast.join(noise.select(order, F.col("noise").alias("_noise")), order, "left").withColumn(name, F.col(name) + F.coalesce("_noise", F.lit(0.0))).drop("_noise")


def interpolated(x: Column, order: str, by: Sequence[str] = ()) -> Column:
    """Gaps filled on the straight line between the rows around them, by row number; leading gaps stay, trailing ones take the last value."""
    w = Window.partitionBy(*by).orderBy(order) if by else over(order)
    i = F.row_number().over(w)
    at = F.when(x.isNotNull(), i)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x0, x1 = F.last(x, True).over(back), F.first(x, True).over(ahead)
    i0, i1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    return F.when(x.isNotNull() | x1.isNull(), x0).otherwise(x0 + (x1 - x0) * (i - i0) / (i1 - i0))


def imputed(df: DataFrame, column: str, how: str, order: str | None = None, value: object = None) -> DataFrame:
    """Nulls of a column by mean, median, mode (least of the commonest), const (`value`), ffill or interpolate (both along `order`)."""
    x = F.col(column)
    if how == "const":
        return df.withColumn(column, F.coalesce(x, F.lit(value)))
    if how in ("ffill", "interpolate"):
        if order is None:
            raise ValueError(f"{how} needs an order")
        fill = F.last(x, True).over(over(order).rowsBetween(Window.unboundedPreceding, 0)) if how == "ffill" else interpolated(x, order)
        return df.withColumn(column, fill)
    if how not in ("mean", "median", "mode"):
        raise ValueError(f"unknown way {how}: mean, median, mode, const, ffill or interpolate")
    one = {"mean": F.avg(column), "median": F.median(column), "mode": F.mode(column, True)}[how]
    return df.crossJoin(F.broadcast(df.agg(one.alias("_fill")))).withColumn(column, F.coalesce(x, F.col("_fill"))).drop("_fill")  # one row
