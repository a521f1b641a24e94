"""Batching of rows for engine calls, and putting results back in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(docs: DataFrame, pieces: Column, doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, idx, source) and the columns to keep: one row for each piece.

    The outer form, filtered, computes the pieces once: for the inner one Catalyst
    infers a filter on their number and computes them for it a second time.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(pieces).alias("idx", "source"), *keep).filter("idx IS NOT NULL")


def fixed_batches(rows: DataFrame, size: int = 64) -> DataFrame:
    """Adds batch: idx div size, within each document."""
    return rows.withColumn("batch", F.floor(F.col("idx") / size))


def rotated(rows: DataFrame, n_providers: int) -> DataFrame:
    """Adds provider: batches taken in turn."""
    return rows.withColumn("provider", F.pmod("batch", F.lit(n_providers)))


def reassembled(rows: DataFrame, text: str = "translated", joiner: str = " ") -> DataFrame:
    """(doc_id, n, text): pieces in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.col(text).alias("t"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["t"]), joiner).alias("text"))


def page_failures(rows: DataFrame, per_page: int = 10) -> DataFrame:
    """(doc_id, page, blocks, failed_blocks, failed): a page fails if any of its blocks did."""
    page = F.floor(F.col("idx") / per_page)
    return rows.groupBy("doc_id", page.alias("page")).agg(F.count("*").alias("blocks"), F.count_if(~F.col("ok")).alias("failed_blocks"), F.bool_or(~F.col("ok")).alias("failed"))


def page_report(rows: DataFrame, overflow: Column, per_page: int = 10) -> DataFrame:
    """(doc_id, translated, overflowed, failed, failed_pages): counters of a document's blocks, and the pages with a failed one."""
    page = F.when(~F.col("ok"), F.floor(F.col("idx") / per_page))
    return rows.groupBy("doc_id").agg(
        F.count_if("ok").alias("translated"),
        F.count_if(F.col("ok") & overflow).alias("overflowed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.array_sort(F.collect_set(page)).alias("failed_pages"),
    )
