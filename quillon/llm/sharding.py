"""Vector bin packing of documents into shards.

Documents are grouped by equal text. The groups, each with a vector of bytes, tokens and rows, are placed largest first into the
shard whose residual capacity has the highest dot product with the group's vector; then groups of the heaviest and the lightest shard
are swapped while that evens out bytes. Every group of more than 1/2^15 of all bytes is placed by itself (there are fewer than 2^15 of them).
Lighter ones are gathered in 2^16 cells by their hash first and each cell is placed as one, so the packing problem has a fixed size; one such
group moves a shard's bytes by less than 0.2 % of its size at 40 shards. A group heavier than 1/8 of a shard is
salted by row over several items: at most 8 * shards such groups can exist, so their list may be broadcast.

Defined results: a null text counts as empty (size 16, no tokens); repeated rows are separate rows of a group; an empty
table gives an empty result; columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, cut, word_array

CELLS, ALONE = 1 << 16, 1 << 15
HEAVY = 8


def place(load: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each cell; load has a row of (bytes, tokens, rows) for each. Cells that would overfill a shard's bytes go
    to the one with the most room."""
    total = np.maximum(load.sum(axis=0), 1)
    share = load / total  # of the whole, by dimension
    residual = np.full((shards, load.shape[1]), 1.0 / shards)
    out = np.zeros(len(load), np.int32)
    for k in np.lexsort((np.arange(len(load)), -share.max(axis=1))):
        v = share[k]
        fits = residual[:, 0] >= v[0]
        score = np.where(fits, residual @ v, residual[:, 0] - 1e6)
        s = int(np.argmax(score))
        out[k] = s
        residual[s] -= v
    return even_out(load, out, shards)


def even_out(load: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Swap two cells of like row counts between the heaviest and the lightest shard in bytes while that brings them nearer;
    where few groups fill a shard, the joint placement alone leaves a few percent."""
    size = np.bincount(shard, weights=load[:, 0], minlength=shards)
    for _ in range(rounds):
        a, b = int(np.argmax(size)), int(np.argmin(size))
        gap = size[a] - size[b]
        mine, other = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        if gap <= 0.0005 * size.mean() or not len(mine) or not len(other):
            break
        other = other[np.argsort(load[other, 0], kind="stable")]
        k = np.clip(np.searchsorted(load[other, 0], load[mine, 0] - gap / 2), 0, len(other) - 1)
        moved = load[mine, 0] - load[other[k], 0]
        left = np.abs(gap - 2 * moved) + 1e-3 * gap * np.abs(load[mine, 2] - load[other[k], 2])
        i = int(np.argmin(left))
        if left[i] >= gap:
            break
        x, y = mine[i], other[k[i]]
        shard[x], shard[y] = b, a
        size[a] -= moved[i]
        size[b] += moved[i]
    return shard


def _assigned(rows: DataFrame, shards: int, overhead: int) -> DataFrame:
    """_row, doc_id, size, text_crc32, n_tokens, shard, slot for rows with _row (distinct numbers), doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    base = rows.select(
        "_row",
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.size(word_array(F.col("text"))).cast("long").alias("n_tokens"),
        F.xxhash64(text).alias("_group"),
    )
    base = cut(base)  # narrow rows: the texts are read once
    whole = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    limit = max(1, whole // (shards * HEAVY))
    groups = base.groupBy("_group").agg(F.sum("size").alias("_w"), F.count("*").alias("_r")).filter(F.col("_w") * ALONE > whole)
    salts = F.when((F.col("_w") > limit) & (F.col("_r") > 1), F.ceil(F.col("_w") / limit)).otherwise(1).cast("long")
    groups = cut(groups.select("_group", salts.alias("_salts")))  # fewer than ALONE rows
    marked = base.join(F.broadcast(groups), "_group", "left")
    salt = F.pmod(F.xxhash64("_row"), F.col("_salts"))
    item = F.when(F.col("_salts").isNull(), F.pmod(F.xxhash64("_group"), F.lit(CELLS))).otherwise(F.xxhash64("_group", salt).bitwiseOR(F.lit(CELLS).cast("long")))  # bit 16 keeps heavy groups apart from cells
    items = marked.select("_row", "doc_id", "size", "text_crc32", "n_tokens", item.alias("_item"))
    sums = items.groupBy("_item").agg(F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")).orderBy("_item").collect()
    load = np.array([[x["b"], x["t"], x["r"]] for x in sums], float).reshape(-1, 3)
    shard = place(load, shards)
    first, seen = [], np.zeros(shards, np.int64)
    for s, x in zip(shard, sums, strict=True):
        first.append(int(seen[s]))
        seen[s] += x["r"]
    plan = rows.sparkSession.createDataFrame([(x["_item"], int(s), f) for s, x, f in zip(shard, sums, first, strict=True)], "_item long, shard int, _first long")
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "_row")) - 1
    return items.withColumn("_at", rank).join(F.broadcast(plan), "_item").withColumn("slot", (F.col("_first") + F.col("_at")).cast("long")).drop("_at", "_first", "_item")  # CELLS + ALONE + 8 * shards items


def pack_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), n_tokens of every row of docs."""
    rows = _assigned(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), shards, overhead)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> DataFrame:
    """Write whole documents as Parquet in a folder for each shard, ordered by slot; returns doc_id, shard and slot.

    Rows are numbered and written once before, so repeated and null ids are no matter. Result columns `shard` and `slot` replace columns
    of those names."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot", "_row")]
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn("_row", F.monotonically_increasing_id()))
        plan = cut(_assigned(rows.select("_row", "doc_id", "text"), shards, 16).select("_row", "doc_id", "shard", "slot"))
        whole = rows.join(plan.drop("doc_id"), "_row").drop("_row")
        whole.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return plan.drop("_row")
