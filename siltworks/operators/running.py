"""Running aggregates over ordered groups of any size. A window holds a whole group in one task; here groups are
cut into range partitions, each is aggregated on its own, and what lies in the partitions before is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.session import stored


def ordered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df range-partitioned by group and order, with `_part`, the number of the partition; stored, so that
    the numbers stay what they are when a task is run again."""
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    x = df.repartitionByRange(n, F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    return stored(x.withColumn("_part", F.spark_partition_id()), "ordered")


def _over(kind: str, v: Column, w: W) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind](v).over(w)


def _both(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(earlier.isNotNull() | here.isNotNull(), F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0)))
    return F.coalesce(here, earlier) if kind == "last" else (F.least if kind == "min" else F.greatest)(earlier, here)


def running(df: DataFrame, group: str, order: list[str], *, keep: bool = False, **made: tuple[str, str]) -> DataFrame:
    """df with the columns `made`, name=(kind, column): the sum, min, max or last non-null value of the column over
    the rows before this one in its group; null where there are none. Rows that are equal in `order` may come
    either way; null groups are one group. A df that has `_part` from here, by `keep`, isn't ordered again."""
    x = df if "_part" in df.columns else ordered(df, group, order)
    o = [F.col(c).asc_nulls_first() for c in order]
    w = W.partitionBy(group, "_part").orderBy(*o).rowsBetween(W.unboundedPreceding, -1)
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    per = x.groupBy(group, "_part").agg(*[whole[k](c).alias(f"_e_{n}") for n, (k, c) in made.items()])
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition that has the group
    per = per.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *[_over(k, F.col(f"_e_{n}"), before).alias(f"_e_{n}") for n, (k, _) in made.items()])
    y = x.withColumns({f"_h_{n}": _over(k, F.col(c), w) for n, (k, c) in made.items()})
    j = y.join(per, y[group].eqNullSafe(F.col("_g")) & (y["_part"] == F.col("_p")))
    j = j.withColumns({n: _both(k, F.col(f"_e_{n}"), F.col(f"_h_{n}")) for n, (k, _) in made.items()})
    return j.drop(*(() if keep else ("_part",)), "_g", "_p", *[f"_{p}_{n}" for n in made for p in "eh"])
