"""Coverage ranks have no ceiling: a vocabulary of any size on the workers gives the same features."""

import pytest

from siltworks.llm import level


def test_joined_ranks_are_the_same(spark, small):
    a = level.features(spark, small).toPandas().sort_values("doc_id", ignore_index=True)
    for vocabulary in (3, 40):
        b = level.features(spark, small, vocabulary).toPandas().sort_values("doc_id", ignore_index=True)
        assert list(a.doc_id) == list(b.doc_id)
        for c in level.FEATURES:
            assert a[c].to_numpy() == pytest.approx(b[c].to_numpy()), c


def test_short_prose_has_a_grade(spark, small, tmp_path):
    d = spark.read.parquet(f"{small}/documents.parquet")
    one = spark.createDataFrame([(987654321, "The stone river runs.")], "doc_id long, text string")
    d.unionByName(one, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/level_labels.parquet").write.parquet(str(tmp_path / "level_labels.parquet"))
    r = level.graded(spark, str(tmp_path)).where("doc_id = 987654321").collect()
    assert len(r) == 1 and r[0]["words"] == 4
