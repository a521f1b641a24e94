"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbraid.llm import htmltext, packing, pii, quality, repair, secrets, simhash, telephony, transcripts, unigram


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.compress_corpus(_read(spark, sf_dir, "documents"))


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.render_pages(_read(spark, sf_dir, "pages"))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"))


def op4_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_conversations(_read(spark, sf_dir, "conversations"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session; without one it is drawn anew, and the surrogates of this run can't be undone."""
    key = spark.conf.get("spark.docbraid.surrogate.secret", None)
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), key.encode() if key else token_bytes(32))


def op6_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_corpus(_read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: the UTF-8 bytes of the documents are the payloads, the codecs taking turns by doc_id."""
    codec = F.element_at(F.array(*map(F.lit, telephony.CODECS)), (F.pmod("doc_id", F.lit(len(telephony.CODECS))) + 1).cast("int"))
    calls = _read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"), codec.alias("codec"))
    return telephony.decode_audio(calls, "doc_id", "payload", "codec").withColumnRenamed("call_id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_grammar": op1_repair_grammar,
    "op2_html_layout": op2_html_layout,
    "op3_quality_divergence": op3_quality_divergence,
    "op4_transcript_roles": op4_transcript_roles,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_unigram_pieces": op6_unigram_pieces,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_telephony_audio": op10_telephony_audio,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op3_quality_divergence": quality.ORACLE, "op8_secret_ownership": secrets.ORACLE}
