from pyspark.sql import functions as F

from docbraid.operators.jobs import latest_state
from docbraid.streaming import jobs

ROWS = [(i, f"2024-01-01 0{i % 6}:00:00", i % 3, ["signup", "view", "error"][i % 3 - 1], 1.0, "{}") for i in range(30)]


def events(spark):
    return spark.createDataFrame(ROWS, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streamed_states_equal_the_batch(spark, tmp_path):
    events(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    q = jobs.job_states(jobs.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("states").collect()) == sorted(latest_state(events(spark)).collect())


def test_windows_close_behind_the_watermark(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    q = jobs.counts_by_window(jobs.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 20  # ten minutes before 05:00 the fifth hour is still open


def test_queue_retries_a_batch(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    seen = []

    def handle(df, epoch):
        seen.append(df.count())
        if len(seen) == 1:
            raise RuntimeError("first try fails")

    jobs.run_queue(jobs.read_events(spark, str(tmp_path / "in")), handle, str(tmp_path / "c"), first_delay=0.01).awaitTermination(120)
    assert seen == [30, 30]
