"""Job events and job queue as streams; checkpoints give at-least-once delivery."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def job_states(events: DataFrame) -> DataFrame:
    """The latest event of each job: one small state row a job, for update or complete mode."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy(F.col("user_id").alias("job_id")).agg(last.alias("e"), F.count("*").alias("events")).select("job_id", F.col("e.event_type").alias("state"), F.col("e.ts").alias("ts"), "events")


def counts_by_window(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and window; late ones count until the watermark passes."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def run_queue(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 5, first_delay: float = 5.0) -> StreamingQuery:
    """Hands each batch of jobs to handle, again after growing pauses if it raises.

    handle must be safe to repeat: a batch is delivered again after a crash.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        for n in range(attempts):
            try:
                return handle(df, epoch)
            except Exception:
                if n == attempts - 1:
                    raise
                time.sleep(first_delay * 2**n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
