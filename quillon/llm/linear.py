"""Hashed n-gram indicators, log-count ratios, a hinge-loss fit by dual coordinate descent, and probabilities from margins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release
from .textkit import Block, blocks, mix

BITS = 20
U = np.uint64
Features = Callable[[Block], tuple[np.ndarray, np.ndarray]]


def bucket(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix(x ^ U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(64 - BITS)).astype(np.int64)


def distinct(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc.astype(np.int64) << BITS | ids)
    return key >> BITS, key & ((1 << BITS) - 1)


def gather(sample: DataFrame, features: Features, lower: bool, labels: list[str], least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a sample of bounded size (its bound is the caller's parameter), at the driver. Features of fewer
    than `least` documents are left out, as no fit keeps them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            block = Block(batch.column("text"), lower=lower)
            doc, ids = distinct(*features(block))
            at = np.searchsorted(doc, np.arange(block.n_docs + 1))
            cells = [ids[at[d] : at[d + 1]].astype(np.int32).tobytes() for d in range(block.n_docs)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), *(batch.column(c).cast(pa.int32()) for c in labels)], ["ids", *labels])

    table = sample.select("text", *labels).mapInArrow(run, f"ids binary, {', '.join(f'{c} int' for c in labels)}").toArrow()
    y = np.column_stack([table[c].to_numpy() for c in labels]).astype(np.int64).reshape(table.num_rows, len(labels))
    chunks = table["ids"].chunks
    del table
    counts, keys = np.zeros(1 << BITS, np.int32), []
    for chunk in chunks:
        for x in chunk:
            cell = x.as_buffer()
            counts[np.frombuffer(cell, np.int32)] += 1  # a document's features are distinct
            keys.append((zlib.crc32(cell), cell.size))
    often = counts >= least
    found: list[np.ndarray] = []
    while chunks:  # a chunk at a time: the table goes as the rows come
        for x in chunks.pop(0):
            r = np.frombuffer(x.as_buffer(), np.int32)
            found.append(r[often[r]])
    order = sorted(range(len(found)), key=lambda i: (*keys[i], *y[i]))  # the same order in every run
    del counts, keys
    release()
    return [found[i] for i in order], y[order]


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, seed: int) -> DataFrame:
    """Whole rows of docs with labels, for the `most` labelled ids of the lowest hash. An id that is labelled twice takes the larger label."""
    labels = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns)).dropna()
    known = labels.join(docs.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` ids
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.max(c).alias(c) for c in columns))


class Fit:
    """w: weight of each feature times its ratio, ratio: log-count ratios of kept features (others 0), bias, and the
    slope and offset that turn margins into probabilities."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, extra: np.ndarray | None = None, least: int = 3, sure: float = 3.0, unit: bool = True, c: float = 1.0, folds: int = 3, calibrate: bool = True):
        self.unit = unit
        self.extra_n = 0 if extra is None else extra.shape[1]
        self.base = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        self.w, self.ratio = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.extra_w, self.bias, self.slope, self.offset = np.zeros(self.extra_n), 0.0, 0.0, float(np.log(self.base / (1 - self.base)))
        self.oof = np.full(len(y), self.base)
        if len(y) < 20 or y.min() == y.max():
            return  # nothing to learn: the base rate
        self._ratios(rows, y, least, sure)
        self._descend(rows, y, extra, c)
        if calibrate:
            fold = np.arange(len(y)) % folds
            margin = np.zeros(len(y))
            for k in range(folds):
                a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                part = Fit([rows[i] for i in a], y[a], None if extra is None else extra[a], least, sure, unit, c, calibrate=False)
                margin[b] = part.margins([rows[i] for i in b], None if extra is None else extra[b])
            self._scale(margin, y)
            self.oof = self.probability(margin)

    def _ratios(self, rows: list[np.ndarray], y: np.ndarray, least: int, sure: float) -> None:
        p, q = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for value, total in ((1, p), (0, q)):
            for i in np.flatnonzero(y == value):
                total[rows[i]] += 1  # a row's features are distinct
        n1, n0 = (y == 1).sum(), (y == 0).sum()
        on = np.flatnonzero(p + q >= least)
        p, q = p[on], q[on]
        r = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
        error = np.sqrt(1 / (p + 1) - 1 / (n1 + 2) + 1 / (q + 1) - 1 / (n0 + 2))
        keep = np.abs(r) > sure * error
        self.ratio[on[keep]] = r[keep]

    def _vector(self, ids: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        ids = ids[self.ratio[ids] != 0]
        x = self.ratio[ids]
        norm = np.sqrt((x**2).sum() + 1.0) if self.unit else 10.0
        return ids, np.concatenate([x / norm, [] if more is None else more, [1.0]])

    def _descend(self, rows: list[np.ndarray], y: np.ndarray, extra: np.ndarray | None, c: float, epochs: int = 12) -> None:
        """Dual coordinate descent for the hinge loss with an L2 penalty; both classes weigh half."""
        tail = self.extra_n + 1
        w = np.zeros((1 << BITS) + tail)
        last = np.arange(1 << BITS, (1 << BITS) + tail, dtype=np.int32)
        data = []
        for i, r in enumerate(rows):
            ids, x = self._vector(r, None if extra is None else extra[i])
            data.append((np.concatenate([ids, last]), x.astype(np.float32), float(x @ x)))
        sign = np.where(y == 1, 1.0, -1.0)
        upper = c * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        alpha, rng = np.zeros(len(y)), np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                at, x, square = data[i]
                g = sign[i] * float(w[at] @ x) - 1
                new = min(max(alpha[i] - g / square, 0.0), upper[i])
                if new != alpha[i]:
                    w[at] += (new - alpha[i]) * sign[i] * x
                    alpha[i] = new
        self.w, self.extra_w, self.bias = w[: 1 << BITS] * self.ratio, w[1 << BITS : -1], float(w[-1])

    def margins(self, rows: list[np.ndarray], extra: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(rows))
        for i, ids in enumerate(rows):
            norm = np.sqrt((self.ratio[ids] ** 2).sum() + 1.0) if self.unit else 10.0
            out[i] = self.w[ids].sum() / norm + self.bias + (0.0 if extra is None else float(self.extra_w @ extra[i]))
        return out

    def _scale(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the out-of-fold margins, by Newton steps with a small ridge."""
        x, b = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, self.offset])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * b)
            b = b + step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(max(b[0], 0.0)), float(b[1])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))

    def slim(self) -> Fit:
        """With arrays of half the size, for sending to executors (8 MB whatever the corpus)."""
        self.w, self.ratio = self.w.astype(np.float32), self.ratio.astype(np.float32)
        self.oof = np.zeros(0)
        return self

    def block_margin(self, n: int, doc: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
        """Margins of the n documents of a block; (doc, ids) may repeat."""
        on = self.ratio[ids] != 0
        doc, ids = distinct(doc[on], ids[on])
        norm = np.sqrt(np.bincount(doc, weights=self.ratio[ids].astype(float) ** 2, minlength=n) + 1.0) if self.unit else 10.0
        return np.bincount(doc, weights=self.w[ids], minlength=n) / norm + self.bias + (0.0 if extra is None else extra @ self.extra_w)
