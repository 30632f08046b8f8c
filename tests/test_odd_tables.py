"""Every core query over tables with rows of nulls, repeated rows, empty and long texts and extra columns with
clashing names: it must not fail, and agree with its SQL."""

import glob
import os

import pytest
from conftest import duck, rows
from pyspark.sql import functions as F

from siltworks.queries import registry

Q, S = registry.queries(), registry.oracle_sql()
CLASH = ["rn", "n", "k", "b", "g", "r", "x", "t", "m", "s", "near", "before", "found", "facts", "made", "sp", "reasons", "quality", "shard", "batch", "project", "near_duplicate_of", "first_id", "piece", "bucket", "low"]


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    for p in glob.glob(small + "/*.parquet"):
        name = os.path.basename(p)
        df = spark.read.parquet(p)
        x = df
        if name not in ("region.parquet", "nation.parquet", "customer.parquet", "supplier.parquet", "part.parquet", "orders.parquet", "lineitem.parquet", "events.parquet", "embeddings.parquet"):
            x = x.unionByName(df.limit(3)).unionByName(spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema))
        if name == "staged_files.parquet":
            more = [("odd/empty.gd", ""), ("odd/blank.gd", " \n\t"), ("odd/long.gd", "func a():\n" + "\tvar x = 1\n" * 500), ("odd/null.gd", None), (None, "extends Node"), ("odd/two.gd", "a"), ("odd/two.gd", "b")]
            x = x.unionByName(spark.createDataFrame(more, "staged_path string, text string"))
        if name == "records.parquet":
            for i, s in enumerate(("odd/empty.gd", "odd/blank.gd", "odd/long.gd", "odd/null.gd", "odd/two.gd", "odd/none.gd")):
                x = x.unionByName(df.limit(1).withColumns({"record_id": F.lit(f"odd{i}"), "staged_path": F.lit(s), "original_path": F.lit("p/" + s)}))
        x.coalesce(1).write.parquet(f"{d}/plain/{name}")
        have = {c.lower() for c in x.columns}
        x.withColumns({c: F.lit("clash") for c in CLASH if c not in have}).coalesce(1).write.parquet(f"{d}/{name}")
    return d


@pytest.mark.parametrize("name", sorted(n for n in Q if not n.startswith("stream_")))
def test_odd_tables(spark, odd, name):
    pdf = Q[name](spark, odd).toPandas()
    if name in S:
        assert rows(pdf) == duck(odd + "/plain", S[name])
