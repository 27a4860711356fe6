"""A corpus pipeline: documents in, kept and encoded documents out.

Each stage works on all rows that its predecessor kept and returns the columns
of documents; the last returns the encodings. Stages are written as Parquet and
read again, so a stage that fails is repeated from its predecessor's files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import op1_quality, op3_minhash, op4_mixing, op5_pieces, op10_language
from tidemark.llm.common import read
from tidemark.llm.queries import tokenizer_path
from tidemark.session import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known and holds most of the text."""
    return op10_language.keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return op1_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8)."""
    return op3_minhash.keep_first(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights of sources, languages and topics."""
    return op4_mixing.keep_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_chunks, round_trip of every document left."""
    return op5_pieces.encode_documents(docs, tokenizer_path(op5_pieces.MODEL))


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing),
          ("sentencepiece", encoding)]

#: Language mixtures, similarity groups and encodings cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
