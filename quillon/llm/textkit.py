"""Vectorised words, word hashes and windows over blocks of UTF-8 texts.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D. Hashes are 64-bit: a polynomial over random byte values,
taken from prefix sums (so a whole block costs a few array passes), then mixed. Two different words of a corpus of 10^8
distinct words collide with a chance of about 3 in 10,000 in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = _rng.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


class Block:
    """Some whole texts: bytes, offsets, and (lazily) words with their hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.n_docs, self.lower = len(texts), lower
        n = len(self.data)
        self.solid = ~SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[self.off[:-1]] = True
        self.first = first[:n]
        begin = self.solid.copy()
        begin[1:] &= ~self.solid[:-1] | self.first[1:]
        stop = self.solid.copy()
        stop[:-1] &= ~self.solid[1:] | self.first[1:]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        #: Words of document d are word_off[d] to word_off[d + 1].
        self.word_off = np.searchsorted(self.start, self.off)
        self._prefix = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, U)
            np.cumsum((_BYTE_LOWER if self.lower else _BYTE)[self.data] * _power(len(self.data))[0][: len(self.data)], out=self._prefix[1:])
        inverse = _power(len(self.data) + 1)[1]
        return mix((self._prefix[end] - self._prefix[start]) * inverse[start] + (end - start).astype(U) * _Q[63])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that start a window of k words of one document, and the windows' hashes."""
        last = self.word_off[1:][self.doc]
        at = np.flatnonzero(np.arange(len(h)) + k <= last)
        total = np.zeros(len(at), U)
        for j in range(k):
            total += h[at + j] * _Q[j]
        return at, mix(total + U(k))

    def per_doc(self, values: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc if doc is None else doc, weights=values, minlength=self.n_docs)

    def shingles(self, h: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each document its sorted distinct k-word shingles; with fewer words the whole sequence is the one."""
        at, w = self.windows(h, k)
        bounds = np.searchsorted(at, self.word_off)
        for d in range(self.n_docs):
            a, b = self.word_off[d], self.word_off[d + 1]
            if b - a >= k:
                yield np.unique(w[bounds[d] : bounds[d + 1]])
            elif b > a:
                yield mix((h[a:b] * _Q[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `size` bytes of text; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        total, a = np.cumsum(lengths), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U, copy=False).view(np.int64), pa.int64())
