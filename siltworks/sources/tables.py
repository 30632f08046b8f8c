"""Readers of the corpus tables, with the duplicate deliveries taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.session import ship


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """Columns `cols` of table `name` under folder `d`; all columns where none is named."""
    ship(spark)
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def one_per_key(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per non-null `key`: of several, the least in the order of `cols`. Rows that repeat
    each other give the same row; the choice never depends on partition order."""
    body = F.min(F.struct(*cols)).alias("_b")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(body).select(key, "_b.*")


def per_text(spark: SparkSession, d: str, **made: Column) -> DataFrame:
    """staged_path and the columns `made` of its text. They are computed where the text is read and only they
    are shuffled; of several texts of a path the one with the least SHA-256 counts. Null texts are left out."""
    t = table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null")
    x = t.select("staged_path", F.sha2("text", 256).alias("_sha"), *[c.alias(k) for k, c in made.items()])
    return one_per_key(x, "staged_path", "_sha", *made).drop("_sha")


#: per_text's choice as SQL.
STG = "stg AS (SELECT staged_path, arg_min(text, sha256(text)) AS text FROM staged_files WHERE staged_path IS NOT NULL AND text IS NOT NULL GROUP BY staged_path)"


def per_document(spark: SparkSession, d: str, where: str, **made: Column) -> DataFrame:
    """per_text for documents: doc_id and the columns `made` of its text, of documents for which `where` holds."""
    t = table(spark, d, "documents").where("doc_id is not null and text is not null").where(where)
    x = t.select("doc_id", F.sha2("text", 256).alias("_sha"), *[c.alias(k) for k, c in made.items()])
    return one_per_key(x, "doc_id", "_sha", *made).drop("_sha")


def doc_sql(where: str, name: str = "doc") -> str:
    """per_document's choice as SQL."""
    return f"{name} AS (SELECT doc_id, arg_min(text, sha256(text)) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND {where} GROUP BY doc_id)"


def records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """`records`, each record once however often it was delivered; null ids are left out."""
    return one_per_key(table(spark, d, "records", "record_id", *cols), "record_id", *cols)


def split_name(c: Column | str) -> Column:
    """train, val or test whatever the spelling; null for anything else."""
    s = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return (
        F.when(s.isin("train", "training", "trn"), "train")
        .when(s.isin("val", "valid", "validation", "dev", "eval"), "val")
        .when(s.isin("test", "testing", "tst"), "test")
    )


SPLIT_SQL = """CASE WHEN lower(trim({c})) IN ('train','training','trn') THEN 'train'
 WHEN lower(trim({c})) IN ('val','valid','validation','dev','eval') THEN 'val'
 WHEN lower(trim({c})) IN ('test','testing','tst') THEN 'test' END"""
