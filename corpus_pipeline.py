"""Corpus pipeline: quality classifier, near-dedup, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again before the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontamination, mixing, near_copies, quality_lm, secrets
from corvane.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_lm.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word Jaccard similarity of 0.8 or more)."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out in the texts; all documents stay."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken, with its output shard."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
    return docs


#: The stages hold trained models and hashed draws, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None
