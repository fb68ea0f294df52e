"""A corpus pipeline over `documents`: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhire.llm import packing, parity_join, quality_fm, toxicity_crf
from tallyhire.llm.common import keep, read
from tallyhire.llm.queries import BYTE_BPE

TOXIC_FROM = 0.7
GOOD_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the conditional random field scores below TOXIC_FROM."""
    field = toxicity_crf.train(docs, read(spark, sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"
    return toxicity_crf.score(docs, field, out=score).filter(F.col(score) < TOXIC_FROM).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorisation machine scores GOOD_FROM or more."""
    machine = quality_fm.train(docs, read(spark, sf_dir, "labels"), metadata=("n_chars",))
    score = f"score_{uuid.uuid4().hex}"
    return quality_fm.score(docs, machine, metadata=("n_chars",), out=score).filter(F.col(score) >= GOOD_FROM).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the Jaccard join, that of the smallest doc_id; rows without words all stay."""
    return parity_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Trained models and linear programs have no SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
