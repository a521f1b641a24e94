"""Deterministic quality checks of translations, scores and reports.

The documents that describe these checks leave most thresholds open; the
defaults here are this library's own choice.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbraid.functions import kernels
from docbraid.functions.text import latin_ratio, script_ratio, trimmed

LATIN_MAX, SCRIPT_MIN, LENGTH_BAND = 0.3, 0.5, (0.3, 3.0)
WEIGHTS = {"ERROR": 20, "WARNING": 8, "INFO": 2}
#: Ten digits of each numeral system, to ASCII.
NUMERALS = "".join(chr(z + i) for z in (0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0x660, 0x6F0) for i in range(10))
NUMBER = r"[0-9]+(?:[.,][0-9]+)*%?"
CITATION = r"\[[0-9, ]+\]|(?:Figure|Table) [0-9]+"


_ASCII = str.maketrans(NUMERALS, "0123456789" * (len(NUMERALS) // 10))
_NUMBER, _CITATION, _DIGIT = re.compile(NUMBER), re.compile(CITATION), re.compile(f"[0-9{NUMERALS}]")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, NUMERALS, "0123456789" * (len(NUMERALS) // 10)), F.lit(NUMBER), F.lit(0))


def missing_items(source: Column, target: Column) -> Column:
    """Items of the source array that the target has fewer times, with multiplicity; sorted."""
    many = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.array_sort(F.filter(F.array_distinct(source), lambda x: many(source, x) > many(target, x)))


def _numbers(text: str) -> list[str]:
    return _NUMBER.findall(text if text.isascii() else text.translate(_ASCII)) if _DIGIT.search(text) else []


def _lost(source: str | None, target: str | None) -> list[str] | None:
    if source is None or target is None:
        return None
    have = _numbers(source)
    return sorted(Counter(have) - Counter(_numbers(target))) if have else []


def _unmarked(source: str | None, target: str | None) -> list[str] | None:
    if source is None or target is None:
        return None
    kept = set(_CITATION.findall(target)) if (mine := dict.fromkeys(_CITATION.findall(source))) else ()
    return [m for m in mine if m not in kept]


def lost_numbers(source: Column, target: Column) -> Column:
    """missing_items of the numbers of two texts, read once."""

    @F.arrow_udf("array<string>")
    def lost(a: pa.Array, b: pa.Array) -> pa.Array:
        return kernels.mapped(_lost, pa.list_(pa.string()), a, b)

    return lost.asNondeterministic()(source, target)


def lost_markers(source: Column, target: Column) -> Column:
    """Citation marks of the source, each once and in order, that the target has not."""

    @F.arrow_udf("array<string>")
    def lost(a: pa.Array, b: pa.Array) -> pa.Array:
        return kernels.mapped(_unmarked, pa.list_(pa.string()), a, b)

    return lost.asNondeterministic()(source, target)


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def same_shape(a: Column, b: Column) -> Column:
    """Whether two tables have as many rows, and as many cells in each."""
    return F.transform(a, F.size) == F.transform(b, F.size)


def without_terms(text: Column, terms: tuple[str, ...]) -> Column:
    for t in terms:
        text = F.replace(text, F.lit(t), F.lit(""))
    return text


def with_flags(rows: DataFrame, target: str, verbatim: tuple[str, ...] = ()) -> DataFrame:
    """Adds found, the array of (type, severity, detail) of every finding on (source, translated)."""
    s, t = F.col("source"), F.col("translated")
    clean = without_terms(t, verbatim)
    ratio = F.length(t) / F.greatest(F.length(s), F.lit(1))
    read = {"latin": latin_ratio(clean), "script": script_ratio(clean, target), "lost": lost_numbers(s, t), "marks": lost_markers(s, t)}
    made = rows.withColumn("read", F.struct(*[c.alias(k) for k, c in read.items()]))
    latin, script, lost, marks = (F.col(f"read.{k}") for k in read)
    flag = lambda test, kind, severity, detail: F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail")))
    found = F.array(
        flag(latin > LATIN_MAX, "untranslated", "ERROR", F.format_string("%.3f", latin)),
        flag(script < SCRIPT_MIN, "wrong_script", "WARNING", F.format_string("%.3f", script)),
        flag(~ratio.between(*LENGTH_BAND), "length_anomaly", "WARNING", F.format_string("%.3f", ratio)),
        flag(F.size(lost) > 0, "number_mismatch", "ERROR", F.array_join(lost, ", ")),
        flag(F.size(marks) > 0, "citation_mismatch", "WARNING", F.array_join(marks, ", ")),
    )
    return made.withColumn("found", F.filter(found, lambda x: x.isNotNull())).drop("read")


def flags(rows: DataFrame, target: str, verbatim: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, idx, type, severity, detail): one row for every finding."""
    return with_flags(rows, target, verbatim).select("doc_id", "idx", F.inline_outer("found")).filter("type IS NOT NULL")


def by_type(found: DataFrame) -> DataFrame:
    """(type, severity, flags, documents): the findings of a run."""
    return found.groupBy("type", "severity").agg(F.count("*").alias("flags"), F.count_distinct("doc_id").alias("documents"))


def row_scores(flagged: DataFrame) -> DataFrame:
    """Adds score, errors, flags to rows with found: 100 less the weights, 0 at least; no join, no shuffle."""
    weight = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])
    lost = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + F.element_at(weight, x["severity"]))
    errors = F.size(F.filter("found", lambda x: x["severity"] == "ERROR")).cast("long")
    return flagged.withColumns({"score": F.greatest(F.lit(0).cast("long"), 100 - lost), "errors": errors, "flags": F.size("found").cast("long")}).drop("found")


def row_report(scored: DataFrame, least: int = 70) -> DataFrame:
    """(doc_id, overall_score, chunks, flagged, errors, failed, pass) of rows with ok and their scores: one aggregation."""
    s = scored.groupBy("doc_id").agg(
        F.round(F.avg("score"), 6).alias("overall_score"), F.count("*").alias("chunks"), F.count_if(F.col("score") < least).alias("flagged"), F.sum("errors").alias("errors"), F.count_if(~F.col("ok")).alias("failed")
    )
    return s.withColumn("pass", (F.col("errors") == 0) & (F.col("flagged") == 0) & (F.col("failed") == 0))


def glossary_violations(relevant: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Relevant terms whose rendering is missing from the translation; a relevant that carries translated needs no rows."""
    joined = relevant if rows is None else relevant.join(rows.select("doc_id", "idx", "translated"), ["doc_id", "idx"])
    return joined.filter(F.instr(F.col("translated"), F.col("target_term")) == 0).select("doc_id", "idx", "source_term", "target_term")


def scores(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, idx, score, errors, flags): 100 less the weights of the flags, 0 at least."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), F.col("severity"))
    sums = found.groupBy("doc_id", "idx").agg(F.sum(weight).alias("w"), F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count("*").alias("flags"))
    joined = rows.select("doc_id", "idx").join(sums, ["doc_id", "idx"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select("doc_id", "idx", F.greatest(F.lit(0).cast("long"), 100 - zero("w")).alias("score"), zero("errors").alias("errors"), zero("flags").alias("flags"))


def report(scored: DataFrame, rows: DataFrame, least: int = 70) -> DataFrame:
    """(doc_id, overall_score, chunks, flagged, errors, failed, pass): one row for each document."""
    s = scored.groupBy("doc_id").agg(F.round(F.avg("score"), 6).alias("overall_score"), F.count("*").alias("chunks"), F.count_if(F.col("score") < least).alias("flagged"), F.sum("errors").alias("errors"))
    failed = rows.groupBy("doc_id").agg(F.count_if(~F.col("ok")).alias("failed"))
    return s.join(failed, "doc_id").withColumn("pass", (F.col("errors") == 0) & (F.col("flagged") == 0) & (F.col("failed") == 0))


def sampled(rows: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """A fixed share of the rows, the same ones on every run."""
    return rows.filter(F.pmod(F.xxhash64("doc_id", "idx", F.lit(seed)), F.lit(100)) < percent)


def blank(text: Column) -> Column:
    return trimmed(F.coalesce(text, F.lit(""))) == ""
