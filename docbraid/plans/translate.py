"""From documents to translated, checked and exported documents: one lazy plan, no barriers but its shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbraid.functions.split import units
from docbraid.functions.text import mock_translate
from docbraid.operators import batches, blocks, jobs, qa
from docbraid.operators.routing import Engine, amazon_cost, run_chain


def demo_engines(lang: str) -> list[Engine]:
    """Three engines that need no network: one fails by rule, one is empty by rule, the last is certain except for every seventh row."""
    spot = F.col("doc_id") + F.col("idx")
    served = lambda source, rule: mock_translate(F.when(rule, source), lang)
    size = F.length("source")
    return [
        Engine("INDICTRANS2", lambda s: served(s, F.pmod(spot, F.lit(3)) == 1), F.lit(0), latency=size),
        Engine("AMAZON_TRANSLATE", lambda s: F.coalesce(served(s, F.pmod(spot, F.lit(3)) == 2), F.when(F.pmod(spot, F.lit(2)) == 0, F.lit(" "))), amazon_cost(F.col("source")), latency=2 * size),
        Engine("MOCK", lambda s: served(s, F.pmod(spot, F.lit(7)) != 0), F.lit(0), latency=F.lit(1)),
    ]


def analyse(docs: DataFrame) -> DataFrame:
    """(doc_id, chunks, chars, headings, sections): what a translation of each document takes."""
    b = blocks.text_blocks(docs)
    heads = b.groupBy("doc_id").agg(F.count_if(F.col("type") == "heading").alias("headings"), F.count("*").alias("blocks"))
    c = blocks.chunk_blocks(b).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("source_text")).alias("chars"))
    return heads.join(c, "doc_id", "left").na.fill(0)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, source)"""
    return batches.exploded(docs, units(F.col("text")))


def translate(docs: DataFrame, lang: str, engines: list[Engine] | None = None) -> DataFrame:
    """(doc_id, idx, source, translated, engine, ok, attempts)"""
    return run_chain(segments(docs), engines or demo_engines(lang))


def checked(docs: DataFrame, lang: str) -> DataFrame:
    """Progress and quality report of each document."""
    rows = translate(docs, lang)
    report = qa.row_report(qa.row_scores(qa.with_flags(rows, lang)))
    return jobs.progress(rows).join(report.select("doc_id", "overall_score", "pass"), "doc_id")
