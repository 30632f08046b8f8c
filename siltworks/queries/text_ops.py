"""Queries over the whole texts of documents: leaks, shingles and byte tokens."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import grams as G
from siltworks.functions import text as T
from siltworks.queries.registering import Registry
from siltworks.session import spread
from siltworks.sources.tables import one_per_key, split_name, table

query = Registry()

#: Buckets of grams per shuffle partition; the grams to test of one bucket are held by one task at a time.
BUCKETS = 32


def texts(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """doc_id and text, a repeated doc_id with its least text."""
    return one_per_key(table(spark, d, "documents", "doc_id", "text", *cols).where("text is not null"), "doc_id", "text", *cols)


@query()
def text_leak_index(spark: SparkSession, d: str) -> DataFrame:
    """Share of a test text's distinctive 16-grams (in at most two distinct train texts) that train texts
    hold, over whole texts. Grams are compared by 128 bits. They are shuffled as pieces of text, each in the
    bucket that its grams share, so that a gram isn't written 16 times over. No SQL: DuckDB would hold every
    substring of every text; tested against brute force."""

    def plain(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["text"].map(G.normal))

    x = table(spark, d, "documents", "doc_id", "text", "split").where("doc_id is not null and text is not null").withColumn("split", split_name("split"))
    p = one_per_key(spread(x.where("split = 'test'").select("doc_id", "text")).mapInPandas(plain, "doc_id long, text string"), "doc_id", "text")
    c = spread(x.where("split = 'train'").select("text")).mapInPandas(plain, "text string").distinct()
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = p.mapInPandas(partial(G.packed, buckets=buckets, train=False), G.PACKED).unionByName(c.mapInPandas(partial(G.packed, buckets=buckets, train=True), G.PACKED))
    g = g.repartition("bucket").sortWithinPartitions("bucket", "train").mapInPandas(G.leaks, "doc_id long, present long, distinctive long")
    n = g.groupBy("doc_id").agg(F.sum("present").alias("present"), F.sum("distinctive").alias("distinctive"))
    return n.withColumn("leak", F.round(F.when(F.col("distinctive") == 0, 0.0).otherwise(F.col("present") / F.col("distinctive")), 6))


@query(f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(min(text), '{T.TOKEN}'), lambda x: lower(x)) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
 g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle FROM t WHERE len(w) > 0)
SELECT doc_id, shingle, count(*) AS n FROM g GROUP BY doc_id, shingle""")
def text_shingle_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often every shingle of five tokens occurs in each document. A text is counted in its row, so that
    no shingle is shuffled."""
    return spread(texts(spark, d)).mapInPandas(G.shingle_counts, "doc_id long, shingle string, n long")


@query()
def text_byte_token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Byte token ids of every document, structural tokens as one id. No SQL: DuckDB can't split at them in
    order; tested against a fixture."""
    return spread(texts(spark, d)).mapInPandas(G.encoded, "doc_id long, ids array<int>")


QUERIES, SQL = query.queries, query.sql
