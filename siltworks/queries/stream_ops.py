"""Streams run over the events table until nothing is left, against the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.queries.registering import Registry
from siltworks.streaming import jobs

query = Registry()


@query("""WITH g AS (SELECT date_trunc('day', ts) AS since, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events)
SELECT since, event_type, n, v FROM g, m WHERE since + INTERVAL 1 DAY <= mark""")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    out = jobs.run_available(jobs.windows(jobs.event_stream(spark, f"{d}/events.parquet")))
    return out.select(F.col("since").cast("timestamp_ntz").alias("since"), "event_type", "n", F.round("v", 4).alias("v"))


@query("SELECT user_id, count(*) AS events, round(sum(value), 4) AS total, max_by(event_type, struct_pack(a := ts, b := event_id)) AS last_type FROM events GROUP BY user_id")
def stream_job_state(spark: SparkSession, d: str) -> DataFrame:
    """STM-01. The state of every job after the stream has run dry."""
    out = jobs.run_available(jobs.job_states(jobs.event_stream(spark, f"{d}/events.parquet")), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("events", "total", "last_type"), "batch").alias("s"))
    return last.select("user_id", "s.events", F.round("s.total", 4).alias("total"), "s.last_type")


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS since, ts FROM events, (SELECT unnest(range(0, 6)) AS k)), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT since, user_id, count(*) AS n FROM w, m WHERE since + INTERVAL 6 HOUR <= mark GROUP BY since, user_id HAVING count(*) >= 3""")
def stream_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """STM-04. Users with three events or more in sliding windows of six hours that the watermark has closed."""
    out = jobs.run_available(jobs.rate_limited(jobs.event_stream(spark, f"{d}/events.parquet")))
    return out.select(F.col("since").cast("timestamp_ntz").alias("since"), "user_id", "n")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x),
 s AS (SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 1 DAY AS until, count(*) AS n FROM y GROUP BY user_id, k), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events) SELECT user_id, since, until, n FROM s, m WHERE until <= mark""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """STM-05. Sessions of a user, ended by a day of silence, that the watermark has closed."""
    out = jobs.run_available(jobs.sessions(jobs.event_stream(spark, f"{d}/events.parquet")))
    return out.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"), F.col("until").cast("timestamp_ntz").alias("until"), "n")


@query("""SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type""")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Extension. Events once each, however often they are delivered within the watermark, counted by kind."""
    e = jobs.event_stream(spark, f"{d}/events.parquet")
    out = jobs.run_available(jobs.distinct_events(e.unionByName(e).select("event_id", "ts", "event_type")))
    return out.groupBy("event_type").agg(F.count("*").alias("events"))


QUERIES, SQL = query.queries, query.sql
