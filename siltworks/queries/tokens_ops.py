"""Byte tokens, document framing, offsets, shards, windows and scale plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.ident import multiset_fingerprint, multiset_fingerprint_sql
from siltworks.operators import packing
from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.sources.tables import SPLIT_SQL, STG, per_text, split_name, table

query = Registry()
#: Fixed value: special tokens before the 256 bytes.
SPECIALS = 13
#: Tokens of a shard, of a window and its stride, as parameters of the queries here.
SHARD, WINDOW, STRIDE = 200_000, 1024, 512

_DOC = f"""{REC}, {STG}, doc AS (SELECT r.record_id, {SPLIT_SQL.format(c="r.split")} AS split, r.original_path AS path, s.text, strlen(s.text) + strlen('# file: ' || r.original_path) + 5 AS tokens FROM rec r JOIN stg s ON s.staged_path = r.staged_path WHERE s.text IS NOT NULL AND r.original_path IS NOT NULL)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    """record_id, split, path, sha (of the text) and the tokens of the framed document: file mark, path line,
    text, line ends, begin and end. Texts are measured where they are read."""
    r = plain_records(spark, d, "original_path", "staged_path", "split").select("record_id", split_name("split").alias("split"), F.col("original_path").alias("path"), "staged_path").where("path is not null")
    x = r.join(per_text(spark, d, bytes=F.octet_length("text"), sha=F.sha2("text", 256)), "staged_path")
    return x.select("record_id", "split", "path", "sha", (F.col("bytes") + F.octet_length(F.concat(F.lit("# file: "), "path")) + 5).cast("long").alias("tokens"))


@query(f"WITH {_DOC} SELECT split, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS longest FROM doc GROUP BY split")
def byte_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """FN-24, AGG-17. Framed documents and byte tokens per split."""
    return docs(spark, d).groupBy("split").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))


@query(f"WITH {_DOC} SELECT record_id, split, tokens, CAST(sum(tokens) OVER (PARTITION BY split ORDER BY path, record_id) - tokens AS BIGINT) AS global_offset FROM doc")
def doc_global_offsets(spark: SparkSession, d: str) -> DataFrame:
    """WIN-03. Where every document begins in the stream of its split, in path order. Running sums are taken over
    range partitions and then joined with the partitions' offsets, so no split is one task."""
    return packing.offsets(docs(spark, d), "split", ["path", "record_id"], "tokens", "global_offset").select("record_id", "split", "tokens", "global_offset")


@query(f"""WITH RECURSIVE {_DOC}, o AS (SELECT record_id, split, tokens, row_number() OVER (PARTITION BY split ORDER BY path, record_id) AS rn FROM doc),
 f AS (SELECT split, rn, record_id, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS shard_offset, tokens FROM o WHERE rn = 1
 UNION ALL SELECT o.split, o.rn, o.record_id, CASE WHEN f.shard_offset + f.tokens + o.tokens > {SHARD} THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.shard_offset + f.tokens + o.tokens > {SHARD} THEN 0 ELSE f.shard_offset + f.tokens END, o.tokens
  FROM f JOIN o ON o.split IS NOT DISTINCT FROM f.split AND o.rn = f.rn + 1)
SELECT record_id, split, shard, shard_offset, tokens FROM f""")
def shard_packing(spark: SparkSession, d: str) -> DataFrame:
    """STR-01. Greedy next-fit shards in path order: a document that would pass the target begins a new shard."""
    return packing.next_fit(docs(spark, d), "split", ["path", "record_id"], "tokens", SHARD).select("record_id", "split", "shard", "shard_offset", "tokens")


@query(f"WITH {_DOC} SELECT split, count(*) AS documents, CAST(sum(CASE WHEN tokens > {WINDOW} + 1 THEN (tokens - {WINDOW} - 2) // {STRIDE} + 1 ELSE 0 END) AS BIGINT) AS windows, count(*) FILTER (tokens <= {WINDOW} + 1) AS too_short FROM doc GROUP BY split")
def sliding_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-25. Sliding windows per split: those that fit a document with its shifted target."""
    w = F.when(F.col("tokens") > WINDOW + 1, F.expr(f"(tokens - {WINDOW} - 2) div {STRIDE} + 1")).otherwise(0)
    return docs(spark, d).groupBy("split").agg(F.count("*").alias("documents"), F.sum(w).cast("long").alias("windows"), F.count_if(F.col("tokens") <= WINDOW + 1).alias("too_short"))


@query(f"WITH {_DOC} SELECT record_id, unnest(range(0, tokens - {WINDOW} - 1, {STRIDE})) AS start FROM doc WHERE tokens > {WINDOW} + 1")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-15. Where every sliding window begins."""
    x = docs(spark, d).where(F.col("tokens") > WINDOW + 1)
    return x.select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - WINDOW - 2, F.lit(STRIDE).cast("long"))).alias("start"))


@query(f"""WITH {_DOC}, t AS (SELECT CAST(sum(tokens) AS BIGINT) AS have FROM doc WHERE split = 'train'), g AS (SELECT unnest([2000000, 5000000, 20000000]) AS target)
SELECT target, 4 * target AS processed, greatest(target - have, 0) AS missing, round(least(have / target, 1.0), 6) AS progress, CAST(ceil(4.0 * target / 12288) AS BIGINT) AS steps FROM t, g""")
def scale_plan(spark: SparkSession, d: str) -> DataFrame:
    """POL-10. What is missing to each target size, tokens processed in four passes and steps."""
    have = docs(spark, d).where("split = 'train'").agg(F.sum("tokens").alias("have"))
    g = spark.createDataFrame([(2_000_000,), (5_000_000,), (20_000_000,)], "target long")
    x = g.crossJoin(F.broadcast(have))  # one row
    return x.select(
        "target",
        (F.col("target") * 4).alias("processed"),
        F.greatest(F.col("target") - F.col("have"), F.lit(0)).alias("missing"),
        F.round(F.least(F.col("have") / F.col("target"), F.lit(1.0)), 6).alias("progress"),
        F.ceil(F.col("target") * 4.0 / 12288).alias("steps"),
    )


@query(f"WITH {_DOC} SELECT split, {multiset_fingerprint_sql('record_id || chr(58) || tokens || chr(58) || sha256(text)')} AS fingerprint, CASE WHEN {SPECIALS} + 256 <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM doc GROUP BY split")
def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """FN-21. Fingerprint of the documents of each split, and the type their ids need."""
    line = F.concat_ws(":", "record_id", F.col("tokens").cast("string"), "sha")
    x = docs(spark, d).select("split", line.alias("line")).groupBy("split").agg(multiset_fingerprint(F.col("line")).alias("fingerprint"))
    return x.withColumn("dtype", F.lit("uint16" if SPECIALS + 256 <= 65535 else "uint32"))


@query("SELECT profile, max_seq_len * batch_size * gradient_accumulation_steps AS tokens_per_step, CAST(ceil(target_dataset_passes * 1000000 / (max_seq_len * batch_size * gradient_accumulation_steps)) AS BIGINT) AS steps FROM train_profiles")
def training_plan(spark: SparkSession, d: str) -> DataFrame:
    """POL-09. Tokens per step and steps for a million unique tokens, per profile."""
    per = F.col("max_seq_len") * F.col("batch_size") * F.col("gradient_accumulation_steps")
    return table(spark, d, "train_profiles").select("profile", per.alias("tokens_per_step"), F.ceil(F.col("target_dataset_passes") * 1_000_000 / per).alias("steps"))


QUERIES, SQL = query.queries, query.sql
