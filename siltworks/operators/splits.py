"""Split assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.ident import hash_split


def forced(units: DataFrame) -> DataFrame:
    """units(unit) -> (unit, split): hash split; with three units or more an empty val gets the first train
    unit in hash order and an empty test the second. The two units are found by a top-two, not a full sort."""
    h = units.select("unit", hash_split(F.col("unit")).alias("h"), F.sha2("unit", 256).alias("k"))
    s = h.agg(F.count("*").alias("n"), F.count_if(F.col("h") == "val").alias("v"), F.count_if(F.col("h") == "test").alias("t"))
    two = h.where("h = 'train'").orderBy("k", "unit").limit(2).select(F.collect_list("unit").alias("two"))
    x = h.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(two))  # one row each
    first, second = F.try_element_at("two", F.lit(1)), F.try_element_at("two", F.lit(2))
    split = (
        F.when((F.col("n") >= 3) & (F.col("v") == 0) & (F.col("unit") == first), "val")
        .when((F.col("n") >= 3) & (F.col("t") == 0) & (F.col("unit") == second), "test")
        .otherwise(F.col("h"))
    )
    return x.select("unit", split.alias("split"))
