"""Every query over tables with nulls in all columns, repeated rows, empty and very long texts, clashing
extra columns, and over empty tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from siltworks.llm import catalogue

TABLES = ["records", "staged_files", "project_audits", "license_files", "skipped", "sources", "train_profiles", "split_targets", "mix_targets", "documents", "level_labels"]
CLASH = ["n", "b", "u", "v", "h", "p", "t", "e", "cls", "root", "node", "b_", "_b", "size", "tokens", "rank", "per", "base", "lo", "hi", "mark", "project", "shard", "p0", "f", "words", "de", "grade_", "cap", "rate", "valid", "best", "text_names", "allowed", "sets", "line_no", "fr", "k", "off"]
LONG = "func a():\n" + "\tvar x = 1\n" * 40_000


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    for name in TABLES:
        df = spark.read.parquet(f"{small}/{name}.parquet")
        null = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
        x = df.unionByName(df.limit(3)).unionByName(null)
        if name == "staged_files":
            extra = [("odd/empty.gd", ""), ("odd/blank.json", " \n"), ("odd/long.gd", LONG), ("odd/one-line.js", "x=1;" * 60_000), ("odd/null.gd", None), (None, "extends Node")]
            x = x.unionByName(spark.createDataFrame(extra, "staged_path string, text string"))
        if name == "documents":
            for c, k in (("", 900001), (" ", 900002), ("word " * 60_000, 900003), ("z" * 50_000, 900004)):
                x = x.unionByName(df.limit(1).withColumns({"doc_id": F.lit(k).cast("long"), "text": F.lit(c)}))
        if name == "records":
            for i, s in enumerate(("odd/empty.gd", "odd/blank.json", "odd/long.gd", "odd/one-line.js", "odd/null.gd", "odd/none.gd")):
                x = x.unionByName(df.limit(1).withColumns({"record_id": F.lit(f"odd{i}"), "staged_path": F.lit(s), "original_path": F.lit("p/" + s)}))
        have = {c.lower() for c in x.columns}
        x = x.withColumns({c: F.lit("clash") for c in CLASH if c not in have})
        x.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(small + "/*.parquet"):
        spark.read.parquet(p).limit(0).coalesce(1).write.parquet(f"{d}/{os.path.basename(p)}")
    return d


FOUND = {
    "p1_found": ["record_id_a", "record_id_b"], "p2_found": ["staged_path", "line_no"], "p3_found": ["record_id"], "p4_found": ["record_id"],
    "p5_found": ["record_id"], "p6_found": ["record_id", "finding"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_odd_rows(spark, odd, name):
    df = catalogue.queries()[name](spark, odd)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert len(rows) == len(set(rows))
        assert all(x is not None for r in rows for x in r)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_empty_tables(spark, empty, name):
    rows = catalogue.queries()[name](spark, empty).collect()
    if name.endswith("_found"):
        assert not rows


def test_extra_rows_change_nothing(spark, small, odd):
    """Nulls, repeated rows and clashing columns leave the cases of the other rows as they were."""
    for name in ("p1_found", "p2_found", "p4_found", "p6_found"):
        a = {tuple(r) for r in catalogue.queries()[name](spark, small).collect()}
        b = {tuple(r) for r in catalogue.queries()[name](spark, odd).collect()}
        assert a <= b, name
        assert all("odd" in str(x) for x in b - a), name
