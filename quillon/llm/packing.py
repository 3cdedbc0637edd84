"""Optimal length buckets and token-budget batches.

The histogram of token counts covers all documents and every length exactly. It has at most sqrt(2 * tokens) entries, as that many
distinct lengths need so many tokens (5.7 million for 16 * 10^12 tokens), so the driver may hold it. Dynamic programming over
it chooses at most `buckets` upper lengths that minimise the padding of all documents to their bucket's length. Inside a bucket
of length L a batch holds max(1, budget // L) rows, the last one fewer.

Defined results: a null or empty text has 0 tokens and is padded to its bucket; a document longer than the budget is a
batch of its own; repeated rows are packed separately; an empty table gives an empty result. Other input columns may have
any name: result columns of the same name replace them in `pack_documents`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, word_array

PARTS = 4096


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of the buckets with the least total padding; lengths ascend and are distinct.

    cost(i, j) = lengths[j] * (rows in i..j) - (tokens in i..j) satisfies the quadrangle inequality, so split points ascend with
    the end, and each layer is solved by halving: all ends of one depth at once, each over the range that its neighbours leave."""
    n = len(lengths)
    if n == 0:
        return []
    x = np.asarray(lengths, np.float64)
    rows, toks = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(x * counts)])
    best = x * rows[1:] - toks[1:]
    splits: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        new, arg = best.copy(), np.full(n, -1, np.int64)  # -1: no further bucket
        a, b, lo, hi = (np.array([v], np.int64) for v in (0, n - 1, 0, n - 1))
        while len(a):
            mid = (a + b) // 2
            size = np.maximum(np.minimum(mid - 1, hi) - lo + 1, 0)
            at, some = lo.copy(), np.flatnonzero(size)
            if len(some):
                ends = np.cumsum(size[some])
                of = np.repeat(some, size[some])
                i = np.arange(ends[-1]) - np.repeat(ends - size[some], size[some]) + lo[of]
                cost = best[i] + x[mid[of]] * (rows[mid[of] + 1] - rows[i + 1]) - (toks[mid[of] + 1] - toks[i + 1])
                least = np.minimum.reduceat(cost, ends - size[some])
                hits = np.flatnonzero(cost == np.repeat(least, size[some]))
                firsts = hits[np.searchsorted(hits, ends - size[some])]  # the first split of the least cost
                at[some] = i[firsts]
                lower = least < new[mid[some]]
                new[mid[some][lower]], arg[mid[some][lower]] = least[lower], at[some][lower]
            a, b, lo, hi = np.concatenate([a, mid + 1]), np.concatenate([mid - 1, b]), np.concatenate([lo, at]), np.concatenate([at, hi])
            on = a <= b
            a, b, lo, hi = a[on], b[on], lo[on], hi[on]
        splits.append(arg)
        best = new
    out, j = [], n - 1
    for arg in reversed(splits):
        if j >= 0 and arg[j] >= 0:
            out.append(int(lengths[j]))
            j = int(arg[j])
    out.append(int(lengths[j]))
    return sorted(set(out))


def pack_documents(docs: DataFrame, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """All columns of docs with n_tokens, bucket, bucket_tokens, batch, slot and pad_tokens.

    Texts are read twice: once for narrow rows, from which buckets and the parts' first ranks come, and once to carry them along;
    without a text to carry (`pack_lengths`), once."""
    added = ["n_tokens", "bucket", "bucket_tokens", "batch", "slot", "pad_tokens", "_part", "_at", "_first"]
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), *_measures())
    return _packed(rows, cut(rows.select("doc_id", "n_tokens", "_part")), kept, buckets, budget)


def pack_lengths(docs: DataFrame, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot and pad_tokens of every row of docs."""
    rows = cut(docs.select("doc_id", *_measures()))
    return _packed(rows, rows, ["doc_id"], buckets, budget)


def _measures():
    part = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(PARTS)).cast("int").alias("_part")
    return F.size(word_array(F.col("text"))).cast("long").alias("n_tokens"), part


def _packed(base: DataFrame, narrow: DataFrame, kept: list[str], buckets: int, budget: int) -> DataFrame:
    histogram = narrow.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()  # bounded, see above
    bounds = best_boundaries(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy().astype(np.float64), buckets)
    bucket, length = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("n_tokens") <= bounds[k]
        bucket, length = F.when(inside, F.lit(k)).otherwise(bucket), F.when(inside, F.lit(bounds[k]).cast("long")).otherwise(length)
    base = base.withColumn("bucket", bucket).withColumn("bucket_tokens", length)
    # Ranks in a bucket without one task for each: counts by part give each part's first rank.
    counts = narrow.groupBy(bucket.alias("bucket"), "_part").count()
    first = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("bucket", "_part", first.alias("_first")))  # at most buckets * PARTS rows
    w = Window.partitionBy("bucket", "_part").orderBy(F.col("doc_id").asc_nulls_last(), "n_tokens")
    out = base.withColumn("_at", F.row_number().over(w) - 1).join(F.broadcast(counts), ["bucket", "_part"], "left")
    rank, cap = F.col("_first") + F.col("_at"), F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(bucket_tokens, 1)"))
    return out.withColumn("batch", (rank - rank % cap).cast("long")).withColumn("slot", (rank % cap).cast("int")).select(*(F.col(f"`{c}`") for c in kept), "n_tokens", "bucket", "bucket_tokens", (F.col("batch") / cap).cast("long").alias("batch"), "slot", (F.col("bucket_tokens") - F.col("n_tokens")).alias("pad_tokens"))
