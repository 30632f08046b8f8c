"""Structured Streaming: windows with watermarks, exactly-once reduction and keyed state. Windows, sessions and
deduplication are extensions: the operators they stand beside read lines as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltworks.session import shared_dir, ship

STATE = "events long, total double, last_type string, last_ts long"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A table folder or file as a stream, with event time as a timestamp."""
    ship(spark)
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        s, path = s.option("pathGlobFilter", p.getName()), p.getParent().toString()  # streams read folders
    s = s.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(s: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and kind; a window is given out when the watermark has passed it."""
    w = s.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("since"), "event_type", "n", "v")


def distinct_events(s: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each event once however often it is delivered within the watermark."""
    return s.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rate_limited(s: DataFrame, limit: int = 3, width: str = "6 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Users with `limit` events or more in a sliding window."""
    w = s.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= limit).select(F.col("w.start").alias("since"), "user_id", "n")


def sessions(s: DataFrame, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """STM-05. Session windows per user."""
    g = s.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def job_states(s: DataFrame) -> DataFrame:
    """The running state of every job: events, total, last kind and time. State is four numbers per key,
    whatever the number of events; events of one batch are taken in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, kind, at = state.get if state.exists else (0, 0.0, None, -1)
        for pdf in batches:
            n += len(pdf)
            total += float(pdf["value"].fillna(0).sum())
            last = pdf.sort_values(["t", "event_id"]).iloc[-1]
            if last["t"] >= at:
                at, kind = int(last["t"]), last["event_type"]
        state.update((n, total, kind, at))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "last_type": [kind], "last_ts": [at]})

    x = s.withColumn("t", F.unix_micros("ts")).select("user_id", "event_id", "event_type", "value", "t")
    return x.groupBy("user_id").applyInPandasWithState(step, "user_id long, " + STATE, STATE, "update", GroupStateTimeout.NoTimeout)


def stalled(s: DataFrame, idle: str = "1 day", late: str = "2 days") -> DataFrame:
    """STM-02, STM-03. Keys that fell silent: one row when the watermark has passed a key's last event by `idle`.
    State is one time per key, and it goes when the row is given out. Late events don't wake a key."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_ts": [last]})
            return
        last = max([int(x) for pdf in batches for x in pdf["t"]] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    x = s.withWatermark("ts", late).withColumn("t", F.unix_micros("ts")).select("user_id", "ts", "t")
    return x.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_ts long", "last_ts long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert(df: DataFrame, path: str, key: str) -> None:
    """SNK-11, STM-12. Run a stream of states dry into a table of one row per key: every batch is put beside what is
    there, and the row of the latest batch stays. A batch that is run again changes nothing."""
    from siltworks.sources.stores import Place, write_folder

    spark = df.sparkSession

    def put(batch: DataFrame, k: int) -> None:
        new = batch.withColumn("batch", F.lit(k).cast("long"))
        if Place(spark, path).exists():
            new = new.unionByName(spark.read.parquet(path))
        cols = [c for c in new.columns if c not in (key, "batch")]
        write_folder(new.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("batch", *cols)).alias("s"), F.max("batch").alias("batch")).select(key, "s.*", "batch"), path)

    w = df.writeStream.option("checkpointLocation", f"{shared_dir(spark)}/siltworks/upsert-{uuid.uuid4().hex}").trigger(availableNow=True)
    w.outputMode("update").foreachBatch(put).start().awaitTermination()


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there, into a table of the shared folder, and read that. With
    `update` every batch is written, with its number, and the last state of a key is left to the reader."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/siltworks/stream-{uuid.uuid4().hex}"
    w = df.writeStream.option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(base + "/out")
    else:
        q = w.outputMode(mode).foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(base + "/out")).start()
    q.awaitTermination()
    schema = df.schema if mode == "append" else df.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(base + "/out")
