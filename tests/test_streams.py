"""Streams over folders of files: silence and upserts."""

from pyspark.sql import functions as F

from siltworks.streaming import jobs


def events(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(folder)


def test_silent_keys(spark, tmp_path):
    d = str(tmp_path / "e")
    events(spark, d, [(1, 7, "2024-01-01 00:00:00", "a", 1.0), (2, 8, "2024-01-01 00:00:00", "a", 1.0)])
    events(spark, d, [(3, 8, "2024-01-06 00:00:00", "a", 1.0)])
    events(spark, d, [(4, 9, "2024-01-06 12:00:00", "a", 1.0)])
    events(spark, d, [(5, 9, "2024-01-06 13:00:00", "a", 1.0)])
    got = {r["user_id"] for r in jobs.run_available(jobs.stalled(jobs.event_stream(spark, d))).collect()}
    assert 7 in got and 9 not in got


def test_upsert_keeps_the_last_state(spark, tmp_path):
    d, out = str(tmp_path / "e"), str(tmp_path / "out")
    for k in range(3):
        events(spark, d, [(k, 7, f"2024-01-0{k + 1} 00:00:00", "abc"[k], 1.0), (10 + k, 8, "2024-01-01 00:00:00", "z", 2.0)])
    jobs.upsert(jobs.job_states(jobs.event_stream(spark, d)), out, "user_id")
    got = {r["user_id"]: (r["events"], r["total"], r["last_type"]) for r in spark.read.parquet(out).collect()}
    assert got == {7: (3, 3.0, "c"), 8: (3, 6.0, "z")}
