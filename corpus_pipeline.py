"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from querna.llm import jaccard_join, packing, pii, quality_rules, suffix_dedup
from querna.llm.common import shared_dir, temporaries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go.

    Null doc_ids, null, empty and very long texts, repeated rows, ties, clashing columns and
    empty tables are as in ``quality_rules.filter_quality``.
    """
    return quality_rules.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Null doc_ids, null, empty and very long texts, repeated rows, ties, clashing columns and
    empty tables are as in ``jaccard_join.drop_near_duplicates``.
    """
    return jaccard_join.drop_near_duplicates(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in one document.

    Null doc_ids, null, empty and very long texts, repeated rows, ties, clashing columns and
    empty tables are as in ``suffix_dedup.cut_passages``.
    """
    return suffix_dedup.cut_passages(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind.

    Null doc_ids, null, empty and very long texts, repeated rows, ties, clashing columns and
    empty tables are as in ``pii.redact``.
    """
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of neighbouring documents along the curve.

    Null doc_ids, null, empty and very long texts, repeated rows, ties, clashing columns and
    empty tables are as in ``packing.pack``.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Hashed sketches, boosted trees and the Hilbert order are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with temporaries(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
