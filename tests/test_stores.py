"""Sources and sinks over folders."""

import zipfile

import pytest
from pyspark.sql import functions as F

from siltworks.sources import stores


def test_archives_lessons_and_listings(spark, tmp_path):
    box = tmp_path / "in"
    (box / "folder").mkdir(parents=True)
    (box / "note.txt").write_text("x")
    with zipfile.ZipFile(box / "one.zip", "w") as z:
        z.writestr("root/a.gd", "extends Node")
        z.writestr("root/b.png", "x")
        z.writestr("root/LICENSE", "MIT")
    with zipfile.ZipFile(box / "two.zip", "w") as z:
        z.writestr("r1/a.gd", "x")
        z.writestr("r2/a.gd", "x")
    assert {tuple(r) for r in stores.inbox(spark, str(box)).collect()} == {("folder", "folder"), ("one.zip", "archive"), ("two.zip", "archive")}
    assert stores.inbox(spark, str(tmp_path / "none")).count() == 0
    got = {(r["path"], r["text"]) for r in stores.archive_texts(spark, str(box), ".gd").collect()}
    assert got == {("a.gd", "extends Node"), ("LICENSE", "MIT")}
    assert all(len(r["sha256"]) == 64 for r in stores.fingerprints(spark, str(box), "*.zip").collect())
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "first.gd").write_text("extends Node\n")
    r = stores.lessons(spark, str(tmp_path / "l")).collect()
    assert len(r) == 1 and r[0]["split"] == "train" and len(r[0]["record_id"]) == 20


def test_documents_and_counts(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.json").write_text('{"format": "x", "format_version": 2, "v": 1}')
    (d / "b.json").write_text('{"format": "x", "format_version": 1}')
    (d / "c.json").write_text('{"format": "y"}')
    (d / "e.json").write_text("{no")
    got = {r["file"]: r["error"] for r in stores.documents_of(spark, str(d), "x", 2).collect()}
    assert got == {"a.json": None, "b.json": "other-version", "c.json": "other-format", "e.json": "not-json"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "t.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    rep = spark.createDataFrame([("v.jsonl", 7)], "file string, lines long")
    assert {tuple(r) for r in stores.line_counts(spark, str(tmp_path / "j"), rep).collect()} == {("t.jsonl", 2), ("v.jsonl", 7)}
    (tmp_path / "m").mkdir()
    for n in ("best.pt", "latest.pt", "step_0012.pt", "x.txt"):
        (tmp_path / "m" / n).write_text("x")
    assert {(r["kind"], r["step"]) for r in stores.artefacts(spark, str(tmp_path / "m")).collect()} == {("best", None), ("latest", None), ("step", 12), ("other", None)}


def test_swap_keeps_and_restores(spark, tmp_path):
    t = str(tmp_path / "t")
    stores.write_folder(spark.range(3), t)
    stores.write_folder(spark.range(5), t)
    assert spark.read.parquet(t).count() == 5 and spark.read.parquet(t + ".previous").count() == 3
    with pytest.raises(OSError):
        stores.swap_folder(spark, str(tmp_path / "absent"), t)
    assert spark.read.parquet(t).count() == 5
    stores.write_document(spark, str(tmp_path / "x.json"), {"a": "ä"})
    stores.write_document(spark, str(tmp_path / "x.json"), {"a": 2})
    assert stores.read_document(spark, str(tmp_path / "x.json")) == {"a": 2} and stores.read_document(spark, str(tmp_path / "y.json")) is None


def test_manifests_reports_logs_and_caches(spark, tmp_path):
    r = spark.createDataFrame([("s", "MIT", "train"), ("s", "MIT", "val"), ("t", None, "train")], "source_id string, license string, split string")
    stores.write_manifests(r, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "corpus")).count() == 3 and spark.read.json(str(tmp_path / "m" / "licenses")).count() == 2
    stores.write_report(r.agg(F.count("*").alias("files")), "Corpus", str(tmp_path / "rep"))
    assert stores.read_document(spark, str(tmp_path / "rep.json"))["summary"] == {"files": 3} and "| files | 3 |" in (tmp_path / "rep.md").read_text()
    log = str(tmp_path / "log")
    for k in range(4):
        stores.append_log(spark.createDataFrame([(f"s{k}", k, None)], "session string, ts long, note string"), log)
    assert stores.rotate(spark, log, "session", "ts", 2) == 4
    assert {x["session"] for x in spark.read.json(log).collect()} == {"s2", "s3"}
    mark = stores.write_versioned(spark, str(tmp_path / "v"), "vocab", {"a": 1})
    assert stores.read_document(spark, str(tmp_path / "v" / f"vocab_{mark}.json")) == {"a": 1}
    made = []
    for key in ("k1", "k1", "k2"):
        stores.cached(spark, str(tmp_path / "c"), key, lambda: made.append(key) or spark.range(2)).count()
    assert made == ["k1", "k2"] and [n for n, d, _ in stores.Place(spark, str(tmp_path / "c")).names() if d] == ["k2"]


def test_token_shards_round_trip(spark, tmp_path):
    rows = [("train", 0, 0, [1, 2, 3]), ("train", 0, 3, [4]), ("train", 1, 0, [5]), ("val", 0, 0, [6, 7])]
    df = spark.createDataFrame(rows, "split string, shard long, shard_offset long, ids array<int>")
    stores.write_shards(df, str(tmp_path / "s"))
    x, faults = stores.read_shards(spark, str(tmp_path / "s"))
    assert sorted((r["split"], r["shard"], r["shard_offset"], r["ids"]) for r in x.collect()) == rows and faults.count() == 0
    stores.write_shards(df.where("shard_offset != 0 or split != 'train' or shard != 0"), str(tmp_path / "s"))
    assert [tuple(r) for r in stores.read_shards(spark, str(tmp_path / "s"))[1].collect()] == [("train", 0, 3, 0)]
