"""A training corpus from ``documents``: five stages, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, whatever
their names; rows that a stage rejects are gone for the next one. NULL texts are empty ones, NULL
ids are ids like any other, repeated rows are copies, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from footfall.llm import (
    byte_bpe,
    decontamination,
    near_duplicates,
    quality_classifier,
    quality_rules,
)
from footfall.llm.tables import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal classifier holds for good; it learns from the rated ones."""
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the counts and lie near their language's histograms."""
    return quality_rules.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates."""
    return near_duplicates.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and the number and digests of the token ids of every text."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: The classifier's training and the alignments can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
