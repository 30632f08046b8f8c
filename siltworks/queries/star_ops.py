"""Relational coverage on the star schema: joins, grouping sets, ranks, set operations, top-k, as-of and
range joins. Where a dimension is broadcast, that is left to the optimizer's size check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators.joins import as_of, range_count
from siltworks.queries.registering import Registry
from siltworks.sources.tables import table

query = Registry()


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def join_revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    li, s = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n, r = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, d, "region", "r_regionkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey").join(table(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").join(table(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT coalesce(p_partkey, l_partkey) AS partkey, count(l_partkey) AS lines, p_partkey IS NULL AS unknown FROM part FULL JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY 1, 3")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_partkey", "l_quantity")
    j = table(spark, d, "part", "p_partkey").join(li, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_quantity") > 45), "full")
    return j.groupBy(F.coalesce("p_partkey", "l_partkey").alias("partkey"), F.col("p_partkey").isNull().alias("unknown")).agg(F.count("l_partkey").alias("lines"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_nationkey", "c_acctbal").join(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in ("F", "O", "P")])


@query("SELECT p_brand, approx.n AS parts, approx.t AS types FROM (SELECT p_brand, {'n': count(*), 't': count(DISTINCT p_type)} AS approx FROM part GROUP BY p_brand)")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_brand", "p_type").groupBy("p_brand").agg(F.count("*").alias("parts"), F.countDistinct("p_type").alias("types"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)) WHERE rn <= 3")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr")).where("rn <= 3")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS before FROM orders")
def window_moving(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("before"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def setop_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def setop_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def setop_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_orders(spark: SparkSession, d: str) -> DataFrame:
    """TOP-01, TOP-10. The hundred largest orders; the limit is the feature."""
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def argmax_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS e2, user_id, ts AS t2 FROM events WHERE event_type = 'view')
SELECT a.event_id, coalesce(max_by(b.e2, struct_pack(x := b.t2, y := b.e2)), -1) AS view_id FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.t2 <= a.ts GROUP BY a.event_id""")
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    """For every purchase the user's last view before it."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of(left, right, "user_id", "ts", "event_id", "view_id").select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("""SELECT a.event_id, count(b.event_id) AS clicks FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts GROUP BY a.event_id""")
def range_clicks_before(spark: SparkSession, d: str) -> DataFrame:
    """For every purchase the clicks of anyone in the hour before."""
    e = table(spark, d, "events", "event_id", "ts", "event_type").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return range_count(e.where("event_type = 'purchase'").select("event_id", "t"), e.where("event_type = 'click'").select("t"), "t", 3600 * 1_000_000, "event_id", "clicks")


@query("SELECT label, count(*) AS n, round(avg(len(embedding)), 3) AS width, round(avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS energy FROM embeddings GROUP BY label")
def vector_profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "label", "embedding")
    energy = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 3).alias("width"), F.round(F.avg(energy), 4).alias("energy"))


QUERIES, SQL = query.queries, query.sql
