"""Corpus pipeline over documents: quality rules, near-duplicate removal, secret redaction, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docbraid.llm.common import materialise
from docbraid.llm.packing import pack
from docbraid.llm.quality import keep_good
from docbraid.llm.secrets import redact_live
from docbraid.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules do not reject.

    Null, empty and short texts stay, and so do all rows of a repeated one; any
    column may be null, further ones are kept, no rows give no rows.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, nulls last; of equal rows one.

    Null texts are copies of nothing and stay if their rows differ, empty and
    wordless ones are copies of equal texts; further columns are kept, no rows
    give no rows.
    """
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets replaced.

    Null and empty texts stay as they are, repeated rows are redacted alike, a
    null source is an owner of its own; further columns are kept, no rows give no rows.
    """
    return redact_live(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences that hold the redacted texts of all documents, with each piece's document and place.

    Null and empty texts are one end token, repeated rows are packed as often as
    they occur, null ids stay null; further columns play no part, no rows give no rows.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash signatures and the packing plan are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
