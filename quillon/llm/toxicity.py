"""Toxicity by a classifier chain.

The chain predicts the categories of `labels` one after another (here "unusable", quality 0, then "toxic"). Each later linear
model takes the probabilities of the earlier ones as inputs; in training these are out-of-fold predictions, so that it sees
them as good or bad as they will be. Indicators: lower-case (A-Z) words without a last punctuation mark, and their first four
and five bytes, hashed; kept are those that the classes tell apart, scaled by log-count ratios; hinge loss, calibrated.
Trained on at most `most` labelled documents (lowest hash of the id); every document is scored, whole.

Defined results: null and empty texts get the probabilities of the biases; null ids are scored; repeated rows get equal
results; without labels probabilities are 0.5 and nothing is toxic; an empty table gives an empty result; other columns
of the input are carried along by `score_toxicity` unless their names clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Fit, bucket, gather, labelled_sample
from .runtime import release, ship
from .textkit import Block, blocks

CATEGORIES = ("unusable", "toxic")
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


def toxic_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    if not len(block.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = block.end - (_MARK[block.data[block.end - 1]] & (block.end - block.start > 1))
    docs, ids = [block.doc], [bucket(block.span_hash(block.start, end), 11)]
    for k in (4, 5):
        on = end - block.start > k
        docs.append(block.doc[on])
        ids.append(bucket(block.span_hash(block.start[on], block.start[on] + k), 10 + k))
    return np.concatenate(docs), np.concatenate(ids)


def train_chain(docs: DataFrame, labels: DataFrame, most: int = 16000) -> list[Fit]:
    labels = labels.select("doc_id", (1 - F.col("quality")).cast("int").alias("unusable"), F.col("toxic").cast("int").alias("toxic"))
    rows, y = gather(labelled_sample(docs, labels, list(CATEGORIES), most, 7), toxic_features, True, list(CATEGORIES), 2)
    chain: list[Fit] = []
    before = np.zeros((len(rows), 0))
    for k in range(len(CATEGORIES)):
        fit = Fit(rows, y[:, k] if len(y) else np.zeros(0, np.int64), extra=before, unit=False, least=2, sure=2.0)
        before = np.column_stack([before, fit.oof])
        chain.append(fit.slim())
    del rows
    release()
    return chain


def score_toxicity(docs: DataFrame, chain: list[Fit], threshold: float = 0.5) -> DataFrame:
    """All columns of docs, with a probability for each category and toxic."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CATEGORIES]
    columns = [c for c in docs.columns if c.lower() not in (*names, "toxic")]
    kept = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = ", ".join([*(f"{c} double" for c in names), *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, size=3 << 20):
            block = Block(batch.column("text"), lower=True)
            doc, ids = toxic_features(block)
            before = np.zeros((block.n_docs, 0))
            for fit in model.value:
                before = np.column_stack([before, fit.probability(fit.block_margin(block.n_docs, doc, ids, before))])
            yield pa.RecordBatch.from_arrays([*(pa.array(before[:, k]) for k in range(len(names))), *batch.columns], [*names, *batch.schema.names])

    out = kept.mapInArrow(run, schema)
    return out.withColumn("toxic", F.col("p_toxic") > threshold)


def classify_toxicity(docs: DataFrame, labels: DataFrame, most: int = 16000) -> DataFrame:
    """doc_id, p_unusable, p_toxic, toxic of every row of docs."""
    ship(docs.sparkSession)
    return score_toxicity(docs.select("doc_id", "text"), train_chain(docs, labels, most)).select("doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic")
