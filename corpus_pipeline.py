"""The corpus pipeline: stages applied in order to the documents table, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and calls one operator of ``gristmill.llm`` with its
production parameters. All but the last return the columns of ``docs``:

1. language identification drops documents in no known language,
2. near-duplicate detection keeps the document with the smallest id of each class,
3. benchmark decontamination drops documents that hold a benchmark item,
4. the secret scan masks what it reports in the texts,
5. mixing returns one row per copy the mix takes, with ``epoch`` and ``words``.

Rows with nulls, empty texts, repeated rows and extra columns are treated as the operators say; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import credentials, dartminhash, decontaminate, language, mixing
from gristmill.llm.tables import table
from gristmill.plans.session import checkpoint


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return credentials.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

# SQL can express neither the language model nor the signatures; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
