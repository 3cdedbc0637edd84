"""Operators on pairs of rows: outliers by neighbours, mixed-type dissimilarity, text cosine, nearest-neighbour imputation.

They are quadratic by definition, and take all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from .graph import checkpointed
from .stats import null_report, quantiles


def vector(columns: Sequence[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns))


def zscore_flags(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    row = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    flag = F.greatest(*(F.coalesce(F.abs(F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns), F.lit(0.0)) > limit
    return df.crossJoin(F.broadcast(row)).withColumn("outlier", flag).drop(*row.columns)  # one row of parameters


def iqr_flags(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    flag = F.lit(False)
    for c, (q1, q3) in percentile_limits(df, columns).items():
        flag = flag | F.coalesce((F.col(c) < q1 - k * (q3 - q1)) | (F.col(c) > q3 + k * (q3 - q1)), F.lit(False))
    return df.withColumn("outlier", flag)


def percentile_limits(df: DataFrame, columns: Sequence[str], lower: float = 0.25, upper: float = 0.75) -> dict[str, tuple[float, float]]:
    return {r["col"]: (r["q"][0], r["q"][1]) for r in quantiles(df, columns, [lower, upper]).collect()}  # a row for each column


def balanced(df: DataFrame, columns: Sequence[str], rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """Columns scaled by rows and columns in turn (rows to a sum of 1, then columns) until both hold within the tolerance or for `rounds`
    rounds. A row's factor is an expression of its own cells, so a round is one aggregation of column sums; values are at least 1e-12.
    A common factor of the weights cancels in a row's sum: they are kept near 1 by powers of 2, which round nothing, or they would shrink with the
    rows in each round until they are 0."""
    cells = [F.greatest(F.col(c).cast("double"), F.lit(1e-12)) for c in columns]
    weights = [1.0] * len(columns)
    for _ in range(rounds):
        scaled = [x * F.lit(w) for x, w in zip(cells, weights, strict=True)]
        total = sum(scaled[1:], scaled[0])
        row = df.agg(*(F.sum(x / total) for x in scaled)).first()
        sums = [v or 1.0 for v in row]
        off = max(abs(v - 1.0) for v in sums)
        weights = [w / v for w, v in zip(weights, sums, strict=True)]
        scale = 2.0 ** -math.frexp(max(weights))[1]
        weights = [w * scale for w in weights]
        if off <= tolerance:
            break
    shown = [x * F.lit(w) for x, w in zip(cells, weights, strict=True)]
    parts = [x * F.lit(w * v) for x, w, v in zip(cells, weights, sums, strict=True)]  # the row sums come before the last scaling of columns; both share the power of 2
    total = sum(parts[1:], parts[0])
    return df.withColumns({c: x / total for c, x in zip(columns, shown, strict=True)})


def limit_score(df: DataFrame, limits: Mapping[str, tuple[float, float]], method: str = "count") -> DataFrame:
    """Number of columns outside their limits, scaled to [0, 1] over the table. Methods: count; percentile (limits are pairs of shares, taken as
    quantiles of the column); sinkhorn (flags balanced over rows and columns before they are summed)."""
    if method not in ("count", "percentile", "sinkhorn"):
        raise ValueError(f"unknown method {method}")
    if method == "percentile":
        limits = {c: percentile_limits(df, [c], *pair)[c] for c, pair in limits.items()}
    flags = {f"_o_{c}": F.coalesce(~F.col(c).between(a, b), F.lit(False)).cast("double") for c, (a, b) in limits.items()}
    out = df.withColumns(flags)
    if method == "sinkhorn":
        out = balanced(out, list(flags))
    out = out.withColumn("_h", sum((F.col(c) for c in flags), F.lit(0.0))).drop(*flags)
    row = out.agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    return out.crossJoin(F.broadcast(row)).withColumn("score", F.when(F.col("_hi") > F.col("_lo"), (F.col("_h") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_h", "_lo", "_hi")


def share_flags(scores: DataFrame, score: str, share: float, largest: bool) -> DataFrame:
    """outlier: scores up to the quantile `share`, or above the quantile 1 - share. The scores are computed once, for the quantile and the flags."""
    scores = checkpointed(scores)
    row = scores.agg(F.percentile(score, F.lit(1 - share if largest else share)).alias("_cut"))
    flag = F.col(score) > F.col("_cut") if largest else F.col(score) <= F.col("_cut")
    return scores.crossJoin(F.broadcast(row)).withColumn("outlier", flag).drop("_cut")


def outliers(df: DataFrame, key: str, columns: Sequence[str], method: str = "zscore", value_1: float | None = None, value_2: float | None = None) -> DataFrame:
    """(key, outlier) by one of: zscore (limit 3), iqr (factor 1.5), mahalanobis (quantile 0.95, robust), kde (bandwidth 1, lowest 2 % of densities),
    dbscan (eps 0.8, 10 rows), lof (20 neighbours, highest 2 %). The two values replace these settings in that order."""
    pick = lambda v, default: default if v is None else v
    v = vector(columns)
    if method == "zscore":
        out = zscore_flags(df, columns, pick(value_1, 3.0))
    elif method == "iqr":
        out = iqr_flags(df, columns, pick(value_1, 1.5))
    elif method == "mahalanobis":
        from .models import mahalanobis

        out = mahalanobis(df, columns, pick(value_1, 0.95), robust=True)
    elif method == "kde":
        out = share_flags(kde_scores(df, key, v, pick(value_1, 1.0)), "log_density", pick(value_2, 0.02), False)
    elif method == "dbscan":
        out = dbscan_noise(df, key, v, pick(value_1, 0.8), int(pick(value_2, 10))).withColumnRenamed("noise", "outlier")
    elif method == "lof":
        out = share_flags(lof(df, key, v, int(pick(value_1, 20))), "lof", pick(value_2, 0.02), True)
    else:
        raise ValueError(f"unknown method {method}: zscore, iqr, mahalanobis, kde, dbscan or lof")
    return out.select(key, "outlier")


def vector_blocks(df: DataFrame, key: str, v: Column, size: int = 2048) -> DataFrame:
    """(n, keys, x): the vectors of at most `size` rows (about a megabyte) as bytes of doubles. Rows without a key are left out; missing or
    short vectors are filled with NaN, which makes their distances missing."""
    width = df.select(F.max(F.size(v)).alias("n")).first()["n"] or 0
    width = max(width, 1)
    rows = max(64, min(size, (1 << 17) // width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                some = batch.slice(k, rows)
                x = np.full((some.num_rows, width), np.nan)
                for i, one in enumerate(some.column("v")):
                    if one.is_valid:
                        cells = np.array(one.as_py(), float)
                        x[i, : len(cells)] = cells
                keys = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("k"))
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), keys, pa.array([x.tobytes()], pa.binary())], ["n", "keys", "x"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), v.cast("array<double>").alias("v")).filter("k is not null").mapInArrow(pack, f"n int, keys array<{kind}>, x binary")


def against(a: DataFrame, b: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Every block of a (by vector_blocks) against every block of b. kernel(blocks of one block of a) gets an iterator of (keys, x, other keys,
    other x, approximate squared distances, their error) and gives arrays of the schema's columns. Distances come from one product of
    matrices about a's mean; where their error could be seen they are summed by column instead. Pairs with a missing distance have NaN."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i] for c in batch.schema.names}
                x, y = (np.frombuffer(cell[c].as_buffer(), float).reshape(-1, cell[n].as_py()) for c, n in (("x", "n"), ("y", "m")))
                if x.shape[1] != y.shape[1]:
                    w = max(x.shape[1], y.shape[1])
                    x, y = (np.pad(z, ((0, 0), (0, w - z.shape[1])), constant_values=np.nan) for z in (x, y))
                ks, js = (cell[c].values.to_numpy(zero_copy_only=False) for c in ("keys", "others"))
                fine = x[~np.isnan(x).any(axis=1)]
                middle = fine.mean(axis=0) if len(fine) else np.zeros(x.shape[1])
                u, w = x - middle, y - middle
                p, q = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", w, w)
                error = 4 * np.finfo(float).eps * (x.shape[1] + 4) * max(np.nanmax(p, initial=0.0), np.nanmax(q, initial=0.0))
                if error < 1e-11:
                    d2 = u @ w.T
                    d2 *= -2
                    d2 += p[:, None]
                    d2 += q
                    np.maximum(d2, 0.0, out=d2)
                else:
                    d2, error = np.zeros((len(x), len(y))), 0.0
                    for c in range(x.shape[1]):
                        d2 += (x[:, c, None] - y[:, c]) ** 2
                yield cell["block"].as_py(), (ks, x, js, y, d2, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        stream = pairs_of(batches)
        ahead = next(stream, None)
        while ahead is not None:
            block = ahead[0]

            def mine() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == block:
                    yield ahead[1]
                    ahead = next(stream, None)

            for columns in kernel(mine()):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(max(4, min(64, blocks.count() // 4)))

    left = dealt(a).select(F.monotonically_increasing_id().alias("block"), "n", "keys", "x")
    right = dealt(b).select(F.col("n").alias("m"), F.col("keys").alias("others"), F.col("x").alias("y"))
    return left.join(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def kde_scores(df: DataFrame, key: str, v: Column, h: float = 1.0) -> DataFrame:
    """(key, log density up to a constant), self included."""
    kind = dict(df.dtypes)[key]
    blocks = checkpointed(vector_blocks(df, key, v))

    def kernel(blocks: Iterator[tuple]) -> Iterator[list]:
        total = some = seen = keys = None
        for ks, _, js, _, d2, _ in blocks:
            same = ks[:, None] == js
            there = ~np.isnan(d2) & ~same
            d2 *= -1 / (2 * h * h)
            np.exp(d2, out=d2)
            d2[~there] = 0.0
            if total is None:
                keys, total, some, seen = ks, np.zeros(len(ks)), np.zeros(len(ks), bool), np.zeros(len(ks), bool)
            total += d2.sum(axis=1)
            some |= there.any(axis=1)
            seen |= ~same.all(axis=1)
        if total is not None:
            yield [keys[seen], pa.array(total[seen], mask=~some[seen])]

    part = against(blocks, blocks, kernel, f"{key} {kind}, s double")
    return part.groupBy(key).agg(F.ln(F.sum("s") + 1.0).alias("log_density"))


def dbscan_noise(df: DataFrame, key: str, v: Column, eps: float, least: int) -> DataFrame:
    """Noise is neither core (at least `least` rows within eps, itself included) nor within eps of a core row."""
    kind, limit = dict(df.dtypes)[key], eps * eps

    def kernel(blocks: Iterator[tuple]) -> Iterator[list]:
        many = keys = None
        for ks, x, js, y, d2, error in blocks:
            near = d2 <= limit
            i, j = np.nonzero(np.abs(d2 - limit) <= error)
            for k in range(0, len(i), 65536):  # on the edge: the exact sum decides
                r, c = i[k : k + 65536], j[k : k + 65536]
                exact = np.zeros(len(r))
                for t in range(x.shape[1]):
                    exact += (x[r, t] - y[c, t]) ** 2
                near[r, c] = exact <= limit
            near &= ks[:, None] != js
            keys, many = ks, near.sum(axis=1) + (0 if many is None else many)
        if many is not None:
            on = many > 0
            yield [keys[on], many[on].astype(np.int64)]

    rows = df.select(F.col(key), v.alias("_v"))
    count = lambda a, b: against(a, b, kernel, f"{key} {kind}, near long").groupBy(key).agg(F.sum("near").alias("near"))
    blocks = checkpointed(vector_blocks(rows, key, F.col("_v")))
    core = checkpointed(count(blocks, blocks).filter(F.col("near") + 1 >= least).select(key))
    centres, rest = (checkpointed(vector_blocks(rows.join(core, key, how), key, F.col("_v"))) for how in ("left_semi", "left_anti"))
    touched = count(rest, centres).select(key).union(core).distinct()
    return df.select(key).join(touched.withColumn("_in", F.lit(True)), key, "left").select(key, F.col("_in").isNull().alias("noise"))


def lof(df: DataFrame, key: str, v: Column, k: int = 20) -> DataFrame:
    """(key, lof) with the k nearest rows, ties by key."""
    kind = dict(df.dtypes)[key]
    blocks = checkpointed(vector_blocks(df, key, v))

    def kernel(blocks: Iterator[tuple]) -> Iterator[list]:
        row, dist, key_of, keys = np.zeros(0, np.int64), np.zeros(0), None, None
        for ks, x, js, y, d2, error in blocks:
            keys, key_of = ks, js[:0] if key_of is None else key_of
            d2[ks[:, None] == js] = np.nan
            d2[np.isnan(d2)] = np.inf
            worst = np.full(len(ks), np.inf)  # of the k best so far
            full = np.bincount(row, minlength=len(ks)) >= k
            np.maximum.at(w := np.zeros(len(ks)), row, dist)
            worst[full] = w[full]
            if d2.shape[1] > k:
                worst = np.minimum(worst, np.partition(d2, k - 1, axis=1)[:, k - 1])
            rows, dists, others = [row], [dist], [key_of]
            for a in range(0, len(ks), 64):  # ties may be many: bounded sets of exact sums
                r, c = np.nonzero((d2[a : a + 64] <= worst[a : a + 64, None] + 2 * error) & (d2[a : a + 64] < np.inf))
                exact = np.zeros(len(r))
                for t in range(x.shape[1]):
                    exact += (x[a + r, t] - y[c, t]) ** 2
                order = np.lexsort((np.unique(js, return_inverse=True)[1][c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                rows.append(a + r[first])
                dists.append(exact[first])
                others.append(js[c[first]])
            row, dist, key_of = np.concatenate(rows), np.concatenate(dists), np.concatenate(others)
            order = np.lexsort((np.unique(key_of, return_inverse=True)[1], dist, row))
            row, dist, key_of = row[order], dist[order], key_of[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, dist, key_of = row[first], dist[first], key_of[first]
        if len(row):
            yield [keys[row], key_of, dist]

    w = Window.partitionBy("i").orderBy("d2", "j")
    near = against(blocks, blocks, kernel, f"i {kind}, j {kind}, d2 double")
    nn = checkpointed(near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("i", "j", F.sqrt("d2").alias("d")))
    kd = nn.groupBy(F.col("i").alias("j")).agg(F.max("d").alias("kd"))
    lrd = nn.join(kd, "j").groupBy("i").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    return nn.join(lrd.select(F.col("i").alias("j"), F.col("lrd").alias("other")), "j").join(lrd, "i").groupBy(F.col("i").alias(key)).agg(F.avg(F.col("other") / F.col("lrd")).alias("lof"))


def dissimilarity(df: DataFrame, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """(i, j, d): mean over the columns where both rows count. Kinds: NO and SB nominal and symmetric binary, NU numeric distance,
    AB asymmetric binary (both false isn't counted), TX cosine distance of tf-idf."""
    texts = [c for c, kind in kinds.items() if kind == "TX"]
    a = df.select(F.col(key).alias("i"), *(F.col(c).alias(f"a_{c}") for c in kinds))
    b = df.select(F.col(key).alias("j"), *(F.col(c).alias(f"b_{c}") for c in kinds))
    total, n = F.lit(0.0), F.lit(0)
    for c, kind in kinds.items():
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        d = F.abs(x - y).cast("double") if kind == "NU" else F.coalesce(f"_d_{c}", F.lit(1.0)) if kind == "TX" else (x != y).cast("double")
        on = x.isNotNull() & y.isNotNull()
        if kind == "AB":
            on = on & (x | y)
        total, n = total + F.when(on, d).otherwise(0.0), n + F.when(on, 1).otherwise(0)
    both = a.join(b, F.col("i") < F.col("j"))
    for c in texts:
        both = both.join(tfidf_cosine(df, key, c).withColumnRenamed("d", f"_d_{c}"), ["i", "j"], "left")
    return both.select("i", "j", F.when(n > 0, total / n).alias("d"))


def tfidf_cosine(df: DataFrame, key: str, column: str) -> DataFrame:
    """(i, j, d): cosine distance of smoothed tf-idf, for pairs that share a term (others are at distance 1)."""
    tf = df.select(F.col(key).alias("i"), F.explode(tokens(F.col(column))).alias("t")).groupBy("i", "t").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n"))
    idf = tf.groupBy("t").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("t", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "t").select("i", "t", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "i").select("i", "t", (F.col("w") / F.col("norm")).alias("w"))
    other = w.select(F.col("i").alias("j"), "t", F.col("w").alias("x"))
    return w.join(other, "t").filter("i < j").groupBy("i", "j").agg((1 - F.sum(F.col("w") * F.col("x"))).alias("d"))


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], target: str, k: int = 5) -> DataFrame:
    """(key, target): missing values from the mean of the k nearest rows that have it, by distance over present columns."""
    p = float(len(columns))
    a = df.filter(F.col(target).isNull()).select(F.col(key).alias("i"), *(F.col(c).cast("double").alias(f"a_{c}") for c in columns))
    b = df.filter(F.col(target).isNotNull()).select(F.col(key).alias("j"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"b_{c}") for c in columns))
    on = [F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull() for c in columns]
    total = sum((F.when(o, (F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2).otherwise(0.0) for o, c in zip(on, columns, strict=True)), F.lit(0.0))
    present = sum((o.cast("int") for o in on), F.lit(0))
    d = a.join(F.broadcast(b) if b.limit(5001).count() <= 5000 else b).select("i", "j", "y", F.when(present > 0, total * p / present).alias("d")).filter("d is not null")
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("r") <= k)
    filled = near.groupBy(F.col("i").alias(key)).agg(F.avg("y").alias("_f"))
    return df.join(filled, key, "left").select(key, F.coalesce(F.col(target).cast("double"), "_f").alias(target))


def merge_report(df: DataFrame, imputed: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Missing cells from the imputed table, and (col, before, after) of missing cells. Numeric columns take any value, text columns only values that
    the column has; columns of other types stay as they are and aren't reported."""
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    labels = [c for c in columns if kinds[c] == "string"]
    for c in labels:
        known = df.select(F.col(c).alias(f"_k_{c}")).filter(f"`_k_{c}` is not null").distinct()
        imputed = imputed.join(known, F.col(c) == F.col(f"_k_{c}"), "left").withColumn(c, F.col(f"_k_{c}")).drop(f"_k_{c}")
    out = merge_imputed(df, imputed.select(key, *(F.col(c).cast(kinds[c]).alias(c) for c in numbers + labels)), key, numbers + labels).select(*df.columns)
    count = lambda t, name: null_report(t, numbers + labels).withColumnRenamed("missing", name)
    return out, count(df, "before").join(count(out, "after"), "col")


def merge_imputed(df: DataFrame, imputed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Missing cells from the imputed table; others stay."""
    other = imputed.select(key, *(F.col(c).alias(f"_i_{c}") for c in columns))
    out = df.join(other, key, "left")
    return out.select(*(c for c in df.columns if c not in columns), *(F.coalesce(c, f"_i_{c}").alias(c) for c in columns))
