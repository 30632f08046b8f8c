"""As-of and range joins as compositions of built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.running import running


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_id: str) -> DataFrame:
    """left with the `right_id` of the last right row of the same key at or before `at`; null for none.

    Both sides are put on one time line per key and the last right id is carried forward; the line is cut into
    ranges, so the work is a sort and never a product of the sides, and no key is one task.
    """
    a = left.select(key, at, F.lit(1).alias("_side"), F.col(left_id).alias("_l"), F.lit(None).cast(right.schema[right_id].dataType).alias("_r"))
    b = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_l"), F.col(right_id).alias("_r"))
    x = running(a.unionByName(b), key, [at, "_side", "_r", "_l"], _last=("last", "_r"))
    return x.where("_side = 1").select(key, at, F.col("_l").alias(left_id), F.col("_last").alias(right_id))


def range_count(left: DataFrame, right: DataFrame, at: str, span: int, left_id: str, name: str) -> DataFrame:
    """(left_id, name): how many right rows lie within `span` before a left row, both ends included.

    The range becomes an equality: rows are keyed by their time divided by `span`, a left row looks into its
    own and the bucket before. Right rows are counted per moment first, so ties cost one row.
    """
    r = right.groupBy(F.col(at).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("_t") / span))
    x = left.select(left_id, F.col(at).alias("_at"), F.explode(F.array(F.floor(F.col(at) / span), F.floor(F.col(at) / span) - 1)).alias("_b"))
    j = x.join(r, "_b", "left").withColumn("_k", F.when((F.col("_t") <= F.col("_at")) & (F.col("_t") >= F.col("_at") - span), F.col("_n")).otherwise(0))
    return j.groupBy(left_id).agg(F.sum("_k").alias(name))
