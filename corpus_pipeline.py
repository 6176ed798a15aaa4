"""The corpus pipeline: language ID, exact de-duplication, near de-duplication, secret scans, packing.

Each stage takes the documents that the one before kept, as a stored table, and decides for all of them. The stages keep every
column. Rows without an id go through: they can be rejected, masked and packed, and lose to an equal text with an id, but near
copies are told apart by id alone, so there they stay. Empty tables go through as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from speechgrid.llm import language, secrets
from speechgrid.llm.exact_dedup import one_of_equal
from speechgrid.llm.near_copies import near_copies
from speechgrid.llm.packing import pack
from speechgrid.session import stage_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text of a language among the labels; what has no letter or resembles none of them goes."""
    return language.accepted(docs, language.learn(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the row with the largest id."""
    return one_of_equal(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id."""
    return docs.join(near_copies(docs).filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents by sequence and offset."""
    return pack(docs)


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_duplicates), ("secret_scan", secret_masks), ("pack", packed)]

#: Learnt models and shingle similarity are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{stage_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
