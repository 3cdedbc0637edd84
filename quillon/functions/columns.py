"""Scalar expressions: all are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(c: Column) -> Column:
    """Upper-case trimmed text; null stays null."""
    return F.upper(F.trim(c.cast("string")))


def text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def numeric(c: Column) -> Column:
    """A double, null where the value isn't a number; NaN counts as missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def boolean(c: Column) -> Column:
    return F.coalesce(c.try_cast("double") != 0, F.lit(False))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("", "nan", "NaN"), t)


def hhmm(c: Column) -> Column:
    """'HH:mm' of an HHMM number; 2400 is midnight, anything else outside the clock is null."""
    n = F.floor(c.try_cast("double")).cast("int")
    n = F.when(n == 2400, 0).otherwise(n)
    h, m = F.floor(n / 100).cast("int"), n % 100
    return F.when((n >= 0) & (h <= 23) & (m <= 59), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))


def date_of(y: Column, m: Column, d: Column, strict: bool = False) -> Column:
    if strict:
        return F.make_date(y, m, d)
    return F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def sha_int64(c: Column) -> Column:
    """SHA-256 of the text modulo 2^63 - 1, by Horner's rule over eight hexadecimal pieces."""
    digest = F.sha2(c.cast("string"), 256)
    modulus = F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")
    parts = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(8)))
    step = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: ((a * F.lit(1 << 32).cast("decimal(12,0)") + x) % modulus).cast("decimal(38,0)"))
    return step.cast("long")


def positive(c: Column) -> Column:
    """The positive part, 0 for null."""
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def clip_low(c: Column, low: float = 0.0) -> Column:
    """At least `low`; null stays null."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """Values by a dictionary, others as they are."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def binned(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the left-closed bin [edge, next edge); the last edge may be infinite; outside is null."""
    out = F.lit(None).cast("string")
    for a, b, name in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = c >= a if b == float("inf") else (c >= a) & (c < b)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def right_bins(c: Column, edges: Sequence[Column | float]) -> Column:
    """Number of the right-closed bin, the lowest edge included."""
    e = [x if isinstance(x, Column) else F.lit(float(x)) for x in edges]
    out = F.lit(None).cast("int")
    for k in range(len(e) - 1, 0, -1):
        low = c >= e[0] if k == 1 else c > e[k - 1]
        out = F.when(low & (c <= e[k]), F.lit(k - 1)).otherwise(out)
    return out


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def tokens(c: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w\w+)"), 1)


def date_coerced(c: Column) -> Column:
    """Date of a text; null where it has none."""
    return F.trim(c).try_cast("date")


def point(lon: Column, lat: Column) -> Column:
    """Point (lon, lat) in degrees; null where a part is missing or off the globe."""
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))


def after_prefix(c: Column, separator: str) -> Column:
    """What follows the first separator; the whole text where there is none."""
    at = F.instr(c, separator)
    return F.when(at > 0, F.substr(c, at + len(separator))).otherwise(c)
