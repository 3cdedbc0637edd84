"""Corpus pipeline: quality, toxicity, near duplicates, mixing, packing. Each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.jaccard import keep_one
from quillon.llm.mixing import mix_documents
from quillon.llm.packing import pack_documents
from quillon.llm.quality import score_quality, train_quality
from quillon.llm.runtime import shared_dir, ship
from quillon.llm.toxicity import score_toxicity, train_chain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the classifiers; the stages are tested one by one against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1."""
    ship(spark)
    fit = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, fit).filter("predicted = 1").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    ship(spark)
    chain = train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, chain).filter("not toxic").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join."""
    return keep_one(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return mix_documents(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length bucket, batch and slot."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
