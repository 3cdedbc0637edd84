"""Quality rules with a modified Kneser-Ney character model and language-specific perplexity bands.

Base rules count words, symbols, repeated lines and repeated five-word windows of the whole text. The language model is a
4-gram model over the bytes of UTF-8 as they are: no two bytes share a symbol or a count. Spark counts the 4-grams of every document by language; lower orders
are continuation counts of those. Each order is two sorted arrays, hashes of n-grams (packed bytes, so they never collide) and their log probabilities,
searched by bisection, as long as the n-grams that occur (8 bytes each). Languages are gathered in blocks of at most `block_entries` entries (one
language at least). With one block, documents stay where they are; with more, they are dealt out by block, salted, and a task holds
the models of one block at a time, so all documents are read once. A document is scored by the model of its own language alone, so its
score doesn't depend on the blocks or on other languages.

Bands: over the documents of a language that pass the base rules, the mean log probabilities are counted in bins of 0.005;
with their quartiles q1 and q3, a document of n bytes is rejected outside [q1 - d, q3 + d], where d = width * iqr + noise / sqrt(n),
iqr at least 0.01; the last term is the sampling error of short texts.

Defined results: null and empty texts have counts of 0 and fail the base rules; a null language is a language of its own;
repeated rows and null ids are judged like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, maybe_broadcast, ship
from .textkit import Block, blocks, signed

S, ORDER = 256, 4
PAD = 10
SYMBOL = np.arange(S, dtype=np.uint8)  # every byte is a symbol of its own
HELD = 2_000_000  # n-grams that a task holds before it passes its sums on
MARKS = np.zeros(256, bool)
MARKS[[ord(c) for c in "#*$%&|<>"]] = True


def packed(block: Block) -> np.ndarray:
    """The packed 4-gram that ends at each byte of the block; each document is preceded by three line ends."""
    lengths = np.diff(block.off)
    padded = np.full(len(block.data) + 3 * block.n_docs + 3, PAD, np.uint32)
    at = np.arange(len(block.data)) + 3 * (np.repeat(np.arange(block.n_docs), lengths) + 1)
    padded[at] = SYMBOL[block.data]
    keys = ((padded[:-3] << 8 | padded[1:-2]) << 8 | padded[2:-1]) << 8 | padded[3:]
    return keys[at - 3]


def distinct_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def by_language(batch: pa.RecordBatch, order: dict[str, int] | None = None) -> Iterator[tuple[str, np.ndarray]]:
    langs = np.array(batch.column("_lang").to_pylist(), object)
    for lang in sorted(set(langs), key=lambda x: (order[x] if order else 0, x)):
        yield lang, np.flatnonzero(langs == lang)


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of this task; sums are kept until they are HELD n-grams in all. Keys are unsigned 32-bit numbers in signed ones."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (keys, total) in sums.items():
            for k in range(0, len(keys), 500_000):
                part = keys[k : k + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int32)), pa.array(total[k : k + 500_000])], ["lang", "key", "n"])
        sums.clear()

    for batch in blocks(batches, size=2 << 20):
        for lang, rows in by_language(batch):
            keys, n = np.unique(packed(Block(batch.column("text").take(pa.array(rows)))), return_counts=True)
            if lang in sums:
                keys, n = distinct_sums(np.concatenate([sums[lang][0], keys]), np.concatenate([sums[lang][1], n]))
            sums[lang] = keys, n.astype(np.int64)
        if sum(len(k) for k, _ in sums.values()) > HELD:
            yield from flush()
    yield from flush()


class Model:
    """For each order a sorted array of its n-grams (packed bytes) and one of their log10 p, and, likewise, of contexts and their log10
    back-off weights; single bytes are dense. All are as long as the n-grams that occur."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        grams, c = keys[order].astype(np.int64), counts[order].astype(float)
        tables = {ORDER: (grams, c)}
        for k in range(ORDER - 1, 0, -1):  # lower orders: continuation counts of the n-grams above
            below, c = np.unique(tables[k + 1][0] % S**k, return_counts=True)
            tables[k] = below, c.astype(float)
        self.keys: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.gamma: dict[int, np.ndarray] = {}
        self.base = float(np.log10(1.0 / S))
        for k in range(1, ORDER + 1):
            grams, c = tables[k]
            d = self.discounts(c)[np.minimum(c, 3).astype(int)]
            contexts, at = np.unique(grams // S, return_inverse=True)
            total = np.bincount(at, weights=c, minlength=len(contexts))
            gamma = np.bincount(at, weights=d, minlength=len(contexts)) / np.maximum(total, 1)
            p = (c - d) / total[at] + gamma[at] * 10.0 ** self._lower(grams % S ** (k - 1), k - 1)
            self.keys[k], self.logs[k] = grams.astype(np.uint32), np.log10(p).astype(np.float32)
            self.contexts[k], self.gamma[k] = contexts.astype(np.uint32), np.log10(gamma).astype(np.float32)

    @staticmethod
    def discounts(c: np.ndarray) -> np.ndarray:
        """Discounts of counts of 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
        n = [0.0] + [float(np.count_nonzero(c == k)) for k in (1, 2, 3, 4)]
        if min(n[1:]) == 0:
            return np.array([0.0, 0.5, 0.75, 0.9])
        y = n[1] / (n[1] + 2 * n[2])
        return np.array([0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))])

    @staticmethod
    def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
        return at, keys[at] == q

    def _lower(self, q: np.ndarray, k: int) -> np.ndarray:
        """log10 p of n-grams of k bytes: found, or the back-off weight of their context (1 if it never occurs) and the order below."""
        if k == 0:
            return np.full(len(q), self.base)
        q = q.astype(np.uint32)
        at, hit = self._find(self.keys[k], q)
        out = np.where(hit, self.logs[k][at] if len(self.keys[k]) else 0.0, 0.0)
        miss = np.flatnonzero(~hit)
        if len(miss):
            less = q[miss]
            at, known = self._find(self.contexts[k], less // np.uint32(S))
            back = np.where(known, self.gamma[k][at] if len(self.contexts[k]) else 0.0, 0.0)
            out[miss] = back + self._lower(less % np.uint32(S ** (k - 1)), k - 1)
        return out

    def score(self, q: np.ndarray) -> np.ndarray:
        return self._lower(q, ORDER)


def rules(block: Block, columns: dict[str, np.ndarray]) -> None:
    """Counts of the base rules for each document of the block."""
    n = np.diff(block.word_off)
    h = block.hashes()
    byte_doc = np.repeat(np.arange(block.n_docs), np.diff(block.off))
    points = block.solid & ((block.data & 0xC0) != 0x80)
    columns["n_words"] = n
    columns["word_chars"] = np.bincount(byte_doc[points], minlength=block.n_docs)
    columns["n_symbols"] = np.bincount(byte_doc[MARKS[block.data]], minlength=block.n_docs)
    # lines: from a document's start or after a line end, to the next line end or the document's end
    breaks = np.flatnonzero(block.data == 10)
    nonempty = np.flatnonzero(np.diff(block.off) > 0)
    start = np.sort(np.concatenate([block.off[nonempty], breaks + 1]))
    stop = np.sort(np.concatenate([block.off[nonempty + 1], breaks]))
    # a break at a document's last byte opens an empty line at the next one's start: both sorts keep such pairs aligned
    words = np.searchsorted(block.start, stop) - np.searchsorted(block.start, start)
    keep = (stop > start) & (words > 0)
    start, stop = start[keep], stop[keep]
    doc = np.searchsorted(block.off, start, "right") - 1
    lines = block.span_hash(start, stop) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    columns["n_dup_lines"] = np.bincount(doc, minlength=block.n_docs) - np.bincount(doc[np.unique(lines, return_index=True)[1]], minlength=block.n_docs)
    at, w = block.windows(h, 5)
    w = w ^ (block.doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    ordered = np.sort(w)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(h) + 5, bool)
    if len(twice):
        k = np.searchsorted(twice, w)
        k[k == len(twice)] = 0
        flagged = at[twice[k] == w]
        for j in range(5):
            covered[flagged + j] = True
    columns["n_repeat_words"] = np.bincount(block.doc[covered[: len(h)]], minlength=block.n_docs)


def quality_rules(docs: DataFrame, width: float = 2.5, noise: float = 0.4, block_entries: int = 16_000_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log10_mean, perplexity."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("\0null")).alias("_lang"))
    counts = cut(docs.select("text", "_lang").mapInArrow(count_ngrams, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    sizes = [(r["lang"], r["count"]) for r in counts.groupBy("lang").count().orderBy("lang").collect()]
    groups: list[list[str]] = []
    held = 0
    for lang, n in sizes:
        if not groups or held + n > block_entries:
            groups.append([])
            held = 0
        groups[-1].append(lang)
        held += n
    schema = "doc_id long, _lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log10_mean double"
    sent = []
    for langs in groups:
        models = {}
        for x in langs:
            table = counts.filter(F.col("lang") == x).select("key", "n").toArrow()  # the distinct 4-grams of a language
            models[x] = Model(table["key"].to_numpy().view(np.uint32).astype(np.int64), table["n"].to_numpy())
        sent.append(spark.sparkContext.broadcast(models))
    block_of = {x: k for k, langs in enumerate(groups) for x in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = -1
        for batch in blocks(batches, size=3 << 20):
            columns: dict[str, np.ndarray] = {}
            texts = batch.column("text")
            rules(Block(texts), columns)
            mean, columns["n_bytes"] = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lang, rows in by_language(batch, block_of):
                if block_of[lang] != at:
                    if at >= 0:
                        sent[at].__dict__.pop("_value", None)  # one block's models at a time
                    at = block_of[lang]
                block = Block(texts.take(pa.array(rows)))
                total = np.bincount(np.repeat(np.arange(len(rows)), np.diff(block.off)), weights=sent[at].value[lang].score(packed(block)), minlength=len(rows))
                mean[rows] = total / np.maximum(np.diff(block.off), 1)
                columns["n_bytes"][rows] = np.diff(block.off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("_lang"), *(pa.array(columns[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")), pa.array(mean)], ["doc_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "log10_mean"])

    if len(groups) > 1:
        number = F.create_map(*(F.lit(v) for pair in block_of.items() for v in pair))[F.col("_lang")]
        docs = docs.withColumn("_block", number).repartition("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(256))).sortWithinPartitions("_block").drop("_block")
    scored = docs.mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = cut(scored.withColumn("base_failed", failed))
    bins = scored.filter(~F.col("base_failed")).groupBy("_lang", F.floor(F.col("log10_mean") * 200).alias("bin")).count()
    w = Window.partitionBy("_lang")
    bins = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    q = bins.groupBy("_lang").agg(*(F.min(F.when(F.col("upto") >= x * F.col("all"), F.col("bin") / 200)).alias(f"q{k}") for k, x in ((1, 0.25), (3, 0.75))))
    bands = q.select("_lang", "q1", "q3", (width * F.greatest(F.col("q3") - F.col("q1"), F.lit(0.01))).alias("_spread"))
    out = scored.join(maybe_broadcast(cut(bands), 10_000), "_lang", "left")
    d = F.col("_spread") + noise / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    kept = ~F.col("base_failed") & F.col("log10_mean").between(F.col("q1") - d, F.col("q3") + 0.005 + d)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.nullif(F.col("_lang"), F.lit("\0null")).alias("lang"), "log10_mean", F.pow(F.lit(10.0), -F.col("log10_mean")).alias("perplexity"))
