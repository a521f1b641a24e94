"""Leak scans and comparisons of two engines' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbraid.functions.text import leaks, length_divergence, preview


def leak_scan(rows: DataFrame, text: str = "translated", min_words: int = 3, target: str | None = None) -> DataFrame:
    """(doc_id, idx, kind, run, preview) of the rows that leak."""
    found = rows.select("doc_id", "idx", leaks(F.col(text), min_words, target).alias("l"), preview(F.col(text)).alias("preview"))
    return found.select("doc_id", "idx", "l.kind", "l.run", "preview").filter("kind IS NOT NULL")


def leak_counts(rows: DataFrame, text: str = "translated", min_words: int = 3) -> DataFrame:
    """(doc_id, scanned, in_script, mixed, full_english)."""
    c = rows.select("doc_id", leaks(F.col(text), min_words).alias("l"))
    kind = lambda k: F.count_if(F.col("l.kind") == k).alias(k)
    return c.groupBy("doc_id").agg(F.count("*").alias("scanned"), F.count_if(F.col("l.label").isNotNull()).alias("in_script"), kind("mixed"), kind("full_english"))


def worst_leaks(scan: DataFrame, show: int = 10) -> DataFrame:
    return scan.filter("kind = 'mixed'").orderBy(F.desc("run"), "doc_id", "idx").limit(show)


def aligned(source: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, idx, source, a, b) for the positions that all three have."""
    return source.join(a, ["doc_id", "idx"]).join(b, ["doc_id", "idx"])


def divergent(pairs: DataFrame, show: int = 20) -> DataFrame:
    """The rows whose two outputs differ most in length."""
    ratio = F.round(length_divergence(F.col("a"), F.col("b")), 6)
    return pairs.select("doc_id", "idx", ratio.alias("ratio")).filter("ratio IS NOT NULL").orderBy(F.desc("ratio"), F.desc("doc_id"), F.desc("idx")).limit(show)


def ab_summary(pairs: DataFrame) -> DataFrame:
    """One row: leaks and untouched English of both sides."""
    sides = ("a", "b")
    scanned = pairs.select(*[leaks(F.col(side)).alias(f"l_{side}") for side in sides], *[F.col(side).rlike(r"\p{L}").alias(f"letters_{side}") for side in sides])
    cols = []
    for side in sides:
        indic = F.col(f"l_{side}.label").isNotNull()
        cols.append(F.count_if(indic & (F.col(f"l_{side}.run") >= 3)).alias(f"mixed_{side}"))
        cols.append(F.count_if(~indic & F.col(f"letters_{side}")).alias(f"english_{side}"))
    return scanned.agg(F.count("*").alias("n"), *cols)
