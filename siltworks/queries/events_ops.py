"""Event streams in batch: normalisation, metrics, islands, gaps, rate windows, reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions import text as T
from siltworks.operators.running import running
from siltworks.queries.registering import Registry
from siltworks.sources.tables import table

query = Registry()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")


def micros(c) -> Column:
    """Microseconds since the epoch, for either kind of timestamp."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


@query("""SELECT event_id, substr(coalesce(lower(trim(event_type)), 'unknown'), 1, 80) AS event, CASE WHEN isnan(value) OR value < 0 THEN NULL ELSE round(value, 4) END AS value, round(least(coalesce(CASE WHEN isnan(value) OR value < 0 THEN NULL ELSE value END, 0) / 100.0, 1.0), 6) AS progress,
 CASE WHEN lower(event_type) IN ('error', 'failed') THEN 'error' WHEN lower(event_type) IN ('warning') THEN 'warning' ELSE 'info' END AS level FROM events""")
def event_normalize(spark: SparkSession, d: str) -> DataFrame:
    """FN-40. Names cut to 80 characters, invalid numbers as null, progress at most one, default level."""
    v = F.when(F.isnan("value") | (F.col("value") < 0), None).otherwise(F.col("value"))
    t = F.lower("event_type")
    return events(spark, d).select(
        "event_id",
        F.substring(F.coalesce(F.lower(F.trim("event_type")), F.lit("unknown")), 1, 80).alias("event"),
        F.round(v, 4).alias("value"),
        F.round(F.least(F.coalesce(v, F.lit(0.0)) / 100.0, F.lit(1.0)), 6).alias("progress"),
        F.when(t.isin("error", "failed"), "error").when(t == "warning", "warning").otherwise("info").alias("level"),
    )


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def event_props_parse(spark: SparkSession, d: str) -> DataFrame:
    """FN-41. The number in a property document, and whether the document is one."""
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.is_variant_null(F.try_parse_json("props")).isNotNull().alias("valid"))


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21, UDF-07. Counts, sums and users per kind and overall."""
    return events(spark, d).rollup("event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users")
    )


@query("""WITH x AS (SELECT *, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM events)
SELECT user_id, island, count(*) FILTER (event_type = 'click') AS run, min(ts) AS since FROM x GROUP BY user_id, island HAVING count(*) FILTER (event_type = 'click') > 0""")
def consecutive_islands(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05. Runs of one kind of event between resets by another, per user."""
    e = events(spark, d).withColumn("reset", F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long"))
    x = running(e, "user_id", ["ts", "event_id"], island=("sum", "reset")).withColumn("island", F.coalesce("island", F.lit(0)) + F.col("reset"))
    g = x.groupBy("user_id", "island").agg(F.count_if(F.col("event_type") == "click").alias("run"), F.min("ts").alias("since"))
    return g.where("run > 0")


@query("""WITH x AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, ts AS since, nxt AS until, epoch(nxt) - epoch(ts) AS seconds FROM x WHERE epoch(nxt) - epoch(ts) > 86400""")
def stall_gaps(spark: SparkSession, d: str) -> DataFrame:
    """STM-02. Silences of more than a day per user."""
    x = running(events(spark, d), "user_id", ["ts", "event_id"], since=("last", "ts")).select("user_id", "since", F.col("ts").alias("until")).where("since is not null")
    s = micros("until") / 1e6 - micros("since") / 1e6
    return x.select("user_id", "since", "until", s.alias("seconds")).where("seconds > 86400")


@query("""SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3""")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """STM-04. Events that are at least the third of their user within six hours."""
    span = 6 * 3600 * 1_000_000
    # An event counts in its own stretch of six hours and is looked back at from the next, so a window holds two
    # stretches of a user and not all of their time.
    e = events(spark, d).select("event_id", "user_id", micros("ts").alias("t"))
    b = F.floor(F.col("t") / span)
    x = e.select("*", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))).alias("k")).select("event_id", "user_id", "t", "k.*")
    w = W.partitionBy("user_id", "b").orderBy("t").rangeBetween(-span, 0)
    return x.withColumn("n", F.count("*").over(w)).where("own and n >= 3").select("event_id", "user_id", "n")


@query("""SELECT user_id, event_id, value, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3""")
def last_n_values(spark: SparkSession, d: str) -> DataFrame:
    """WIN-10, STM-06. The last three events of every user."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).select("user_id", "event_id", "value", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 3")


@query("""WITH x AS (SELECT user_id, event_id, ts, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
 y AS (SELECT *, before IS NULL OR value < before - 0.01 AS better FROM x), z AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM y)
SELECT event_id, better, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS waited FROM z""")
def best_so_far_patience(spark: SparkSession, d: str) -> DataFrame:
    """WIN-09. Whether a value beats the best so far by a margin, and for how many events none had."""
    o = ["ts", "event_id"]
    x = running(events(spark, d).withColumn("one", F.lit(1).cast("long")), "user_id", o, keep=True, before=("min", "value"), at=("sum", "one"))
    x = x.withColumns({"better": F.col("before").isNull() | (F.col("value") < F.col("before") - 0.01), "at": F.coalesce("at", F.lit(0))})
    x = x.withColumn("mark", F.when(F.col("better"), F.col("at"))).select("event_id", "user_id", "ts", "better", "at", "mark", "_part")
    y = running(x, "user_id", o, last=("last", "mark"))
    return y.select("event_id", "better", (F.col("at") - F.coalesce("mark", "last")).alias("waited"))


@query("""SELECT user_id, max(ts) AS last_ts, count(*) AS events, max_by(event_type, struct_pack(a := ts, b := event_id)) AS state, max_by(value, struct_pack(a := ts, b := event_id)) FILTER (event_type = 'purchase') AS last_value,
 min_by(event_type, struct_pack(a := ts, b := event_id)) AS first_state FROM events GROUP BY user_id""")
def job_state_reduce(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12, STR-05. The state of every job after all of its events: last non-null values win."""
    o = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id").agg(
        F.max("ts").alias("last_ts"),
        F.count("*").alias("events"),
        F.max_by("event_type", o).alias("state"),
        F.max_by("value", F.when(F.col("event_type") == "purchase", o)).alias("last_value"),
        F.min_by("event_type", o).alias("first_state"),
    )


@query("""WITH x AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 86400 THEN 0 ELSE 1 END AS fresh FROM events),
 y AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM x)
SELECT user_id, session, count(*) AS messages, min(ts) AS first_ts, max(ts) AS last_ts, min_by(event_type, struct_pack(a := ts, b := event_id)) AS title FROM y GROUP BY user_id, session""")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    """FN-13, AGG-23. Sessions of a user: events at most a day apart."""
    return sessions(events(spark, d)).groupBy("user_id", "session").agg(
        F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("title")
    )


def sessions(e: DataFrame, gap: int = 86400) -> DataFrame:
    """STM-05. Events with a session number per user; a gap of more than `gap` seconds begins a new one."""
    o = ["ts", "event_id"]
    x = running(e, "user_id", o, keep=True, _at=("last", "ts"))
    near = micros("ts") - micros("_at") <= gap * 1_000_000
    x = x.withColumn("fresh", F.when(near, 0).otherwise(1).cast("long")).drop("_at")
    return running(x, "user_id", o, session=("sum", "fresh")).withColumn("session", F.coalesce("session", F.lit(0)) + F.col("fresh"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, last_ts, n FROM l ORDER BY last_ts DESC, user_id LIMIT 20""")
def session_retention(spark: SparkSession, d: str) -> DataFrame:
    """TOP-08. The twenty users last seen; the limit is the feature."""
    g = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return g.orderBy(F.desc("last_ts"), "user_id").limit(20)


@query("""SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id""")
def last_view(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07. The last event of one kind per user."""
    return events(spark, d).where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH x AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, count(gap) AS samples, round(avg(gap), 4) AS mean_gap, round(least(0.75, greatest(0.15, CASE WHEN count(gap) >= 4 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 0.2 END)), 6) AS spread FROM x WHERE back <= 50 GROUP BY user_id""")
def eta_estimate(spark: SparkSession, d: str) -> DataFrame:
    """FN-56. Mean gap of a user's last fifty events and the spread of an estimate made from it."""
    back = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))  # fifty of a partition at most go on
    e = running(events(spark, d).select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], at=("last", "ts"))
    x = e.select("user_id", ((micros("ts") - micros("at")) / 1e6).alias("gap"), F.row_number().over(back).alias("back")).where("back <= 50")
    n, m = F.count("gap"), F.avg("gap")
    cv = F.when((n >= 4) & (m > 0), F.stddev_pop("gap") / m).otherwise(0.2)
    return x.groupBy("user_id").agg(n.alias("samples"), F.round(m, 4).alias("mean_gap"), F.round(F.least(F.lit(0.75), F.greatest(F.lit(0.15), cv)), 6).alias("spread"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def events_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day."""
    return events(spark, d).groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


@query("""SELECT event_type, CASE WHEN contains(lower(props), 'error') OR contains(lower(props), 'failed') THEN 'error' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY 1, 2""")
def log_levels(spark: SparkSession, d: str) -> DataFrame:
    """FLT-19, FN-15, FN-76. Events by the level their text tells."""
    lv = F.when(F.contains(F.lower("props"), F.lit("error")) | F.contains(F.lower("props"), F.lit("failed")), "error").otherwise("info")
    return events(spark, d).groupBy("event_type", lv.alias("level")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'signup' THEN 2 ELSE 1 END AS rank FROM events) SELECT user_id, max(rank) AS rank, CASE max(rank) WHEN 3 THEN 'purchase' WHEN 2 THEN 'signup' ELSE 'open' END AS final FROM x GROUP BY user_id""")
def terminal_state(spark: SparkSession, d: str) -> DataFrame:
    """STM-11. The final state by precedence, not by time."""
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    g = events(spark, d).groupBy("user_id").agg(F.max(rank).alias("rank"))
    return g.select("user_id", "rank", F.when(F.col("rank") == 3, "purchase").when(F.col("rank") == 2, "signup").otherwise("open").alias("final"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT doc_id, min(text) AS text FROM documents WHERE doc_kind = 'log' AND text IS NOT NULL GROUP BY doc_id))
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^\[ *[0-9]+%\]')) AS progress_lines, count(*) FILTER (regexp_matches(lower(line), 'error|exception|traceback|failed|fatal')) AS error_lines, coalesce(max(TRY_CAST(regexp_extract(line, '^\[ *([0-9]+)%\]', 1) AS BIGINT)), -1) AS last_percent FROM l GROUP BY doc_id""")
def progress_logs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-19, FLT-23, STM-07. Text progress logs: lines, progress lines, error lines and the highest percentage."""
    t = table(spark, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'log' and text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    line = t.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return line.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("line").rlike(r"^\[ *[0-9]+%\]")).alias("progress_lines"),
        F.count_if(T.log_level(F.col("line")) == "error").alias("error_lines"),
        F.coalesce(F.max(F.regexp_extract("line", r"^\[ *([0-9]+)%\]", 1).try_cast("long")), F.lit(-1)).alias("last_percent"),
    )


QUERIES, SQL = query.queries, query.sql
