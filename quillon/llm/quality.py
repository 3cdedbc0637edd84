"""Quality classifier: a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators: one- and two-word n-grams, and one- to three-word n-grams of word shapes (kinds of characters, a capital first,
length class, equal to the word before), hashed into 2^20 buckets. Features that the two classes don't tell apart are left
out. The hinge-loss model is fitted by dual coordinate descent on at most `most` labelled documents (a bounded sample, those
of the lowest hash of the id); its out-of-fold margins are turned into probabilities. Every document is scored, whole.

Defined results: null and empty texts have no indicator and get the score of the bias; null ids are scored and count as not
held out; repeated rows get equal scores; without labels every score is 0.5; an empty table gives an empty result; other
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Fit, bucket, gather, labelled_sample
from .runtime import crc_mod, release, ship
from .textkit import Block, blocks

_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 32
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 8 if chr(_c) in "#*$%&|<>" else 16


def quality_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    h = block.hashes()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = np.bitwise_or.reduceat(_KIND[block.data], block.start).astype(np.uint64)
    first = _KIND[block.data[block.start]].astype(np.uint64)
    size = np.minimum(block.end - block.start, 31).astype(np.uint64) // np.uint64(8)
    again = np.zeros(len(h), np.uint64)
    again[1:] = (h[1:] == h[:-1]) & (block.doc[1:] == block.doc[:-1])
    shape = shape | first << np.uint64(6) | size << np.uint64(12) | again << np.uint64(14)
    docs, ids = [block.doc, block.doc], [bucket(h, 1), bucket(shape, 2)]
    for source, k, salt in ((h, 2, 3), (shape, 2, 4), (shape, 3, 5)):
        at, w = block.windows(source, k)
        docs.append(block.doc[at])
        ids.append(bucket(w, salt))
    return np.concatenate(docs), np.concatenate(ids)


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 8000, holdout: int = 5) -> Fit:
    """Labels of ids with crc32 modulo `holdout` = 0 are never used."""
    labels = labels.filter(crc_mod(F.col("doc_id"), holdout) != 0)
    rows, y = gather(labelled_sample(docs, labels, ["quality"], most, 8), quality_features, False, ["quality"], 3)
    fit = Fit(rows, y[:, 0] if len(y) else np.zeros(0, np.int64)).slim()
    del rows
    release()
    return fit


def score_batches(batches: Iterator[pa.RecordBatch], fit: Fit, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Scores in front of the columns to keep. Blocks are of 1 MB of text: working arrays take about 30 bytes for each of its bytes,
    and two workers share an executor's memory with the JVM."""
    for batch in blocks(batches):
        block = Block(batch.column("text"))
        doc, ids = quality_features(block)
        p = fit.probability(fit.block_margin(block.n_docs, doc, ids) + np.zeros(block.n_docs))
        yield pa.RecordBatch.from_arrays([pa.array(p), *(batch.column(c) for c in keep)], ["_score", *keep])


def score_quality(docs: DataFrame, fit: Fit, holdout: int = 5, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs to keep (all, unless named) with held_out, score and predicted in front. Others don't come back from Python."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit)
    columns = [c for c in docs.columns if c.lower() not in ("_score", "held_out", "score", "predicted")]
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    kept = [f for f in docs.schema if keep is None or f.name in keep]
    names = [f.name for f in kept]
    schema = ", ".join(["_score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    out = docs.mapInArrow(lambda batches: score_batches(batches, model.value, names), schema)
    held = F.coalesce(crc_mod(F.col("doc_id"), holdout) == 0, F.lit(False))
    return out.select(held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), *(F.col(f"`{c}`") for c in names))


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ship(docs.sparkSession)
    return score_quality(docs.select("doc_id", "text"), train_quality(docs, labels, most), keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")
