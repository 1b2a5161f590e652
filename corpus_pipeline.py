"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, SentencePiece encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  All but the last return the
columns of ``documents``; the last returns one row of token ids per document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gapwright.llm import decontaminate, line_dedup, minhash, quality_rules, sentencepiece_bpe
from gapwright.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strictest rule policy keeps."""
    return quality_rules.apply_policy(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 of them share."""
    return line_dedup.clean(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded once more as a check."""
    carry = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return sentencepiece_bpe.encode_checked(docs, carry)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("decontamination", leaks), ("pieces", pieces)]

#: The last stage looks pieces up in a vocabulary file, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a Parquet table in the shared folder before the next one reads it."""
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
