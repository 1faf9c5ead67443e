"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before
kept, and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the rows are written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.llm import language, mixing, prob_minhash
from bazaarlens.llm.queries import packed_documents
from bazaarlens.llm.staging import prepare, staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determined language: null texts and texts without letters."""
    prepare(spark)
    return language.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    prepare(spark)
    return prob_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that sources have their target weights."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of all documents, with their ids, in sequences of 2048 tokens."""
    prepare(spark)
    return packed_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Language likelihoods, minima of hashed processes and the packing heuristic have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = f"pipeline-{uuid.uuid4().hex[:8]}"
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"{name}-{k}")
    return docs
