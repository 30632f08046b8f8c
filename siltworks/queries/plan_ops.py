"""Training plans, schedules, probes and generated rows: arithmetic over small tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.queries.registering import Registry
from siltworks.sources.tables import table

query = Registry()
#: Steps of the warm-up and of the whole run, and the two rates, as parameters of the query.
WARMUP, STEPS, HIGH, LOW = 10, 100, 3e-4, 3e-5


@query(f"""SELECT profile, step, round(CASE WHEN step < {WARMUP} THEN {HIGH} * (step + 1) / {WARMUP} ELSE {LOW} + 0.5 * (1 + cos(pi() * least(1.0, (step - {WARMUP}) / CAST({STEPS - WARMUP} AS DOUBLE)))) * ({HIGH} - {LOW}) END, 12) AS rate FROM train_profiles, (SELECT unnest(range(0, {STEPS})) AS step)""")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    """FN-52. Linear warm-up, then a cosine down to the least rate, step by step."""
    p = table(spark, d, "train_profiles", "profile").select("profile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STEPS - 1).cast("long"))).alias("step"))
    s = F.col("step")
    down = LOW + 0.5 * (1 + F.cos(math.pi * F.least(F.lit(1.0), (s - WARMUP) / (STEPS - WARMUP)))) * (HIGH - LOW)
    return p.withColumn("rate", F.round(F.when(s < WARMUP, HIGH * (s + 1) / WARMUP).otherwise(down), 12))


@query("SELECT event_id, round(exp(least(value, 20)), 4) AS perplexity FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    """FN-53. The exponential of a loss, of twenty at most."""
    e = table(spark, d, "events", "event_id", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return e.select("event_id", F.round(F.exp(F.least("value", F.lit(20.0))), 4).alias("perplexity"))


@query("""WITH m AS (SELECT profile, max_seq_len AS d, 4 * max_seq_len AS f, batch_size AS layers FROM train_profiles) SELECT profile, 8192 * d + layers * (4 * d * d + 3 * d * f + 2 * d) + d AS tied, 2 * 8192 * d + layers * (4 * d * d + 3 * d * f + 2 * d) + d AS untied FROM m""")
def parameter_count(spark: SparkSession, d: str) -> DataFrame:
    """FN-54. Parameters of a model whose width is the profile's length and whose layers are its batch size."""
    w, n = F.col("max_seq_len").cast("long"), F.col("batch_size").cast("long")
    body = n * (4 * w * w + 3 * w * 4 * w + 2 * w) + w
    return table(spark, d, "train_profiles").select("profile", (8192 * w + body).alias("tied"), (2 * 8192 * w + body).alias("untied"))


@query("""WITH p AS (SELECT *, max_seq_len * batch_size * gradient_accumulation_steps AS per FROM train_profiles) SELECT profile, per AS tokens_per_step, CAST(least(5000, ceil(4000000 / per), ceil(ceil(1000000 * target_dataset_passes) / per)) AS BIGINT) AS max_steps FROM p""")
def max_steps(spark: SparkSession, d: str) -> DataFrame:
    """FN-55. The least of the limits by steps (5,000), by tokens (4,000,000) and by passes over a million."""
    per = (F.col("max_seq_len") * F.col("batch_size") * F.col("gradient_accumulation_steps")).cast("long")
    by_pass = F.ceil(F.ceil(1_000_000 * F.col("target_dataset_passes")) / per)
    return table(spark, d, "train_profiles").select("profile", per.alias("tokens_per_step"), F.least(F.lit(5000).cast("long"), F.ceil(4_000_000 / per), by_pass).alias("max_steps"))


@query("""SELECT profile, array_to_string(list_sort(list_distinct(list_filter([1, 2, 4, 6, 8, most, batch_size], lambda x: x <= most AND x > 0))), ',') AS batches, CAST(greatest(1, ceil(8192 / (batch_size * max_seq_len))) AS BIGINT) AS accumulate FROM (SELECT *, CAST(4096 // max_seq_len AS INT) AS most FROM train_profiles)""")
def batch_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FN-67, FN-68. Batches to probe, up to what 4,096 tokens hold, and the accumulation that makes 8,192."""
    p = table(spark, d, "train_profiles").withColumn("most", F.floor(4096 / F.col("max_seq_len")).cast("int"))
    c = F.filter(F.array(*map(F.lit, (1, 2, 4, 6, 8)), F.col("most"), F.col("batch_size")), lambda x: (x <= F.col("most")) & (x > 0))
    return p.select("profile", F.array_join(F.array_sort(F.array_distinct(c)), ",").alias("batches"), F.greatest(F.lit(1), F.ceil(8192 / (F.col("batch_size") * F.col("max_seq_len")))).cast("long").alias("accumulate"))


@query("SELECT profile, concat_ws('_', 'fixed', substr(sha256(profile), 1, 16), max_seq_len, 20, batch_size, 1234) AS cache_key FROM train_profiles")
def eval_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN-71. The name of the cached evaluation windows of a profile."""
    return table(spark, d, "train_profiles").select("profile", F.concat_ws("_", F.lit("fixed"), F.substring(F.sha2("profile", 256), 1, 16), F.col("max_seq_len").cast("string"), F.lit("20"), F.col("batch_size").cast("string"), F.lit("1234")).alias("cache_key"))


@query("""SELECT profile, array_to_string(list_filter([CASE WHEN coalesce(max_seq_len, 0) < 2 THEN 'max_seq_len' END, CASE WHEN coalesce(batch_size, 0) < 1 THEN 'batch_size' END, CASE WHEN coalesce(gradient_accumulation_steps, 0) < 1 THEN 'gradient_accumulation_steps' END,
 CASE WHEN target_dataset_passes IS NOT NULL AND target_dataset_passes <= 0 THEN 'target_dataset_passes' END, CASE WHEN max_seq_len % 256 <> 0 THEN 'multiple_of_256' END, CASE WHEN max_seq_len * batch_size > 2048 THEN 'tokens_per_batch' END], lambda x: x IS NOT NULL), ',') AS broken FROM train_profiles""")
def profile_validity(spark: SparkSession, d: str) -> DataFrame:
    """FLT-24. The rules that a training profile breaks."""
    c, zero = F.col, F.lit(0)
    rules = F.array(
        F.when(F.coalesce("max_seq_len", zero) < 2, "max_seq_len"), F.when(F.coalesce("batch_size", zero) < 1, "batch_size"), F.when(F.coalesce("gradient_accumulation_steps", zero) < 1, "gradient_accumulation_steps"),
        F.when(c("target_dataset_passes") <= 0, "target_dataset_passes"), F.when(c("max_seq_len") % 256 != 0, "multiple_of_256"), F.when(c("max_seq_len") * c("batch_size") > 2048, "tokens_per_batch"),
    )
    return table(spark, d, "train_profiles").select("profile", F.array_join(F.filter(rules, lambda x: x.isNotNull()), ",").alias("broken"))


@query("""WITH l AS (SELECT unnest(['signals', 'nodes', 'scenes', 'physics', 'input', 'ui', 'tween', 'save']) AS topic, unnest(range(0, 8)) AS i), n AS (SELECT topic, lesson, CASE WHEN lesson <= 18 THEN 'train' WHEN lesson <= 21 THEN 'val' ELSE 'test' END AS split FROM l, (SELECT unnest(range(1, 25)) AS lesson))
SELECT topic, split, count(*) AS lessons, array_to_string(list(lesson ORDER BY lesson), ',') AS numbers FROM n GROUP BY topic, split""")
def curriculum_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16, AGG-30, FN-29. Lessons by topic and split, with their numbers; a topic has twenty-four."""
    from siltworks.queries.policy_ops import curriculum_rows

    g = curriculum_rows(spark, d).groupBy("topic", "split").agg(F.count("*").alias("lessons"), F.array_sort(F.collect_list("lesson")).alias("n"))
    return g.select("topic", "split", "lessons", F.array_join(F.col("n").cast("array<string>"), ",").alias("numbers"))


@query("""WITH p AS (SELECT profile, max_seq_len * b AS tokens, b FROM train_profiles, (SELECT unnest([1, 2, 4, 6, 8]) AS b)) SELECT profile, coalesce(max(b) FILTER (tokens <= 4096), 0) AS largest_passing, coalesce(min(b) FILTER (tokens > 4096), -1) AS first_failing, coalesce(bool_and(tokens <= 4096), true) AS lower_bound FROM p GROUP BY profile""")
def probe_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26. The largest batch that passes, the first that doesn't, and whether the former is only a bound."""
    p = table(spark, d, "train_profiles", "profile", "max_seq_len").select("profile", "max_seq_len", F.explode(F.array(*map(F.lit, (1, 2, 4, 6, 8)))).alias("b"))
    ok = F.col("max_seq_len") * F.col("b") <= 4096
    return p.groupBy("profile").agg(F.coalesce(F.max(F.when(ok, F.col("b"))), F.lit(0)).alias("largest_passing"), F.coalesce(F.min(F.when(~ok, F.col("b"))), F.lit(-1)).alias("first_failing"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("lower_bound"))


QUERIES, SQL = query.queries, query.sql
