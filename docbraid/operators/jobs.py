"""Job bookkeeping over event and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docbraid.functions.text import TARGETS, text_progress

RUNNING = ("EXTRACTING", "ANALYZING", "CHUNKING", "TRANSLATING", "POST_EDITING", "QA", "RECONSTRUCTING", "EXPORTING")
TONES = ("FORMAL", "NEUTRAL", "CASUAL")


def latest_state(events: DataFrame, job: str = "user_id") -> DataFrame:
    """(job, event_type, ts): the last event of each job, by time and then id; one partial aggregation, no sort."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy(F.col(job).alias("job_id")).agg(last.alias("e"), F.count("*").alias("events")).select("job_id", F.col("e.event_type").alias("state"), F.col("e.ts").alias("ts"), "events")


def recent(rows: DataFrame, by: str, tie: str, n: int = 100) -> DataFrame:
    """The newest n rows: a top-k, not a sort."""
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def progress(rows: DataFrame) -> DataFrame:
    """(doc_id, done, failed, total, percent, status) from chunk rows with ok."""
    a = rows.groupBy("doc_id").agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))
    status = F.when(F.col("failed") > 0, "PARTIALLY_COMPLETED").otherwise("COMPLETED")
    return a.withColumn("percent", text_progress(F.col("done"), F.col("failed"), F.col("total"))).withColumn("status", status)


def running_counts(rows: DataFrame) -> DataFrame:
    """Adds done and failed so far, in order."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("done", F.sum(F.col("ok").cast("int")).over(w)).withColumn("failed", F.sum((~F.col("ok")).cast("int")).over(w))


def usage(runs: DataFrame) -> DataFrame:
    """(engine, attempts, successes, cost_micro_usd, mean_latency_ms): money in bigint sums, never floats; the mean is of the calls that were timed."""
    mean = F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms")
    return runs.groupBy("engine").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.sum("cost_micro_usd").alias("cost_micro_usd"), mean)


def with_runs(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Every chunk with its number of attempts, 0 included."""
    return chunks.join(runs.groupBy("doc_id", "idx").agg(F.count("*").alias("attempts")), ["doc_id", "idx"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))


def with_attempts(routed: DataFrame) -> DataFrame:
    """The same of rows that still carry their attempts: no second run of the chain, no join."""
    return routed.select("doc_id", "idx", F.size("attempts").cast("long").alias("attempts"))


def validated(jobs: DataFrame) -> DataFrame:
    """Defaults filled in, and problem: null for valid rows. Nothing is dropped."""
    out = jobs.withColumns({"source_language": F.coalesce("source_language", F.lit("en")), "tone": F.coalesce("tone", F.lit("FORMAL")), "mode": F.coalesce("mode", F.lit("DOCUMENT"))})
    problem = (
        F.when(F.col("source_language") != "en", "source_language")
        .when(F.col("target_language").isNull() | ~F.col("target_language").isin(*TARGETS), "target_language")
        .when(~F.col("tone").isin(*TONES), "tone")
        .when(F.length(F.coalesce("special_instructions", F.lit(""))) > 4000, "special_instructions")
    )
    return out.withColumn("problem", problem)


def may_start(jobs: DataFrame, user: str) -> DataFrame:
    """The user's own jobs that are not running."""
    return jobs.filter((F.col("user_id") == user) & ~F.col("status").isin(*RUNNING))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty for a unique key."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def retried(rows: DataFrame, redo: DataFrame) -> DataFrame:
    """Rows with the failed ones replaced by their new versions, by (doc_id, idx)."""
    kept = rows.filter("ok").unionByName(rows.filter("NOT ok").join(redo.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti"))
    return kept.unionByName(redo)
