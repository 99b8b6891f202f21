"""Training corpus from raw documents: a chain of five stages, each written and read again.

Every stage takes a null text for an empty one (and keeps it null), treats rows with equal or null doc_id
one by one, and gives an empty table for an empty one; what ties and repeated rows get is said in the
docstrings of the operators that the stages call.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path

from pyspark.sql import DataFrame, SparkSession

from domainlake.llm.common import table
from domainlake.llm.mixing import mix
from domainlake.llm.packing import pack
from domainlake.llm.secrets import redact_secrets
from domainlake.llm.simhash import drop_near_duplicates
from domainlake.llm.toxicity import drop_toxic
from domainlake.session import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHashes over three-word shingles that differ in three bits or less stays."""
    return drop_near_duplicates(docs, shingle=3, differences=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the domains' tokens come near to their target weights; none goes."""
    return mix(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learnt models and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; the result has a row for each packed piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
