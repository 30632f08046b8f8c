"""Folders as stores: archives and lessons in, manifests, reports, token shards, caches and logs out. What a
reader may see is put in place by a rename, on whatever file system the path names."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.session import ship
from siltworks.sources.files import archive_entries, archive_preflight, decoded, read_texts

#: Names of files that hold terms, kept whatever an archive is read for.
TERMS = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)[^/]*$"


class Place:
    """A path on its file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path=None) -> bool:
        return self.fs.exists(path or self.path)

    def rename(self, a, b) -> None:
        try:
            done = self.fs.rename(a, b)
        except Py4JJavaError as e:
            raise OSError(f"{a} can't be renamed to {b}") from e
        if not done:
            raise OSError(f"{a} can't be renamed to {b}")

    def names(self) -> list[tuple[str, bool, int]]:
        """(name, whether it is a folder, length) of what lies in the folder, in order."""
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self.fs.listStatus(self.path)) if self.exists() else []

    def text(self) -> str | None:
        if not self.exists():
            return None
        stream = self.fs.open(self.path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


# ---------------------------------------------------------------- in


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-11. name and kind (folder or archive) of what waits in a folder; other files are left out."""
    rows = [(n, "folder" if d else "archive") for n, d, _ in Place(spark, folder).names() if d or n.lower().endswith(".zip")]
    return spark.createDataFrame(rows, "name string, kind string")


def fingerprints(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """SRC-10. path, length and sha256 of files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def archive_texts(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """SRC-06. archive, path (below the archive's single root), text and encoding of the files with one of the
    suffixes, and of those that hold terms. Archives that break a rule or have several roots give nothing."""
    ship(spark)
    good = archive_preflight(archive_entries(spark, folder)).where("ok and roots = 1").select(F.col("archive").alias("path"))
    ends = tuple(s.lower() for s in suffixes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            for at, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for i in z.infolist():
                        name = i.filename.partition("/")[2]
                        if not i.is_dir() and (name.lower().endswith(ends) or re.search(TERMS, name)):
                            text, enc = decoded(z.read(i))
                            yield pd.DataFrame([(at, name, text, enc)], columns=["archive", "path", "text", "encoding"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return f.join(good, "path", "left_semi").mapInPandas(run, "archive string, path string, text string, encoding string")


def lessons(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-04. Lessons of users as records of the train split; they are neither shortened nor compared."""
    t = read_texts(spark, folder, "gd")
    rel = F.regexp_extract("path", r"([^/]+)$", 1)
    return t.select(F.substring(F.sha2(F.concat_ws("\x00", F.lit("user_lessons"), rel, F.sha2("text", 256)), 256), 1, 20).alias("record_id"), rel.alias("original_path"), F.lit("train").alias("split"), "text")


def line_counts(spark: SparkSession, folder: str, report: DataFrame | None = None) -> DataFrame:
    """SRC-16. file and its number of lines, as a report(file, lines) says or else as counted."""
    t = spark.read.text(folder).where(F.trim("value") != "").select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"))
    n = t.groupBy("file").agg(F.count("*").alias("counted"))
    if report is None:
        return n.withColumnRenamed("counted", "lines")
    return n.join(report, "file", "full").select("file", F.coalesce("lines", "counted").alias("lines"))


def documents_of(spark: SparkSession, folder: str, form: str, version: int) -> DataFrame:
    """SRC-22, SRC-31, SRC-32, SRC-35. file, document and error of JSON files: a document of another form or version, or one
    that can't be read, is a row with the error instead."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    v = F.try_parse_json("value")
    said = F.try_variant_get(v, "$.format", "string"), F.try_variant_get(v, "$.format_version", "int")
    error = F.when(v.isNull(), "not-json").when(~said[0].eqNullSafe(F.lit(form)), "other-format").when(~said[1].eqNullSafe(F.lit(version)), "other-version")
    return raw.select("file", F.when(error.isNull(), F.col("value")).alias("document"), error.alias("error"))


def artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-20, SRC-33. file, kind (best, latest, step or other), step and length of stored models, by their names."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")
    step = F.regexp_extract("file", r"step_?0*(\d+)", 1).try_cast("long")
    kind = F.when(F.startswith("file", F.lit("best")), "best").when(F.startswith("file", F.lit("latest")), "latest").when(step.isNotNull(), "step").otherwise("other")
    return f.select("file", kind.alias("kind"), step.alias("step"), "length")


# ---------------------------------------------------------------- out


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """SNK-01. A small JSON document that is there whole or not at all."""
    p = Place(spark, path)
    part = p.of(f"{path}.{uuid.uuid4().hex}.part")
    out = p.fs.create(part, True)
    out.write(bytearray(json.dumps(document, sort_keys=True, ensure_ascii=False, indent=1).encode()))
    out.close()
    if p.exists():
        p.fs.delete(p.path, False)
    p.rename(part, p.path)


def read_document(spark: SparkSession, path: str) -> dict | None:
    """SRC-35. The document, or None where there is none or it can't be read."""
    try:
        return json.loads(Place(spark, path).text() or "")
    except ValueError:
        return None


def swap_folder(spark: SparkSession, made: str, target: str) -> None:
    """SNK-02. Put a finished folder in the place of another, which is kept beside it as .previous. Where a step
    fails the old one is put back; what an earlier run left half done is finished first."""
    p = Place(spark, target)
    old, new = p.of(target + ".previous"), p.of(made)
    if not p.exists() and p.exists(old):
        p.rename(old, p.path)
    if p.exists(old):
        p.fs.delete(old, True)
    had = p.exists()
    if had:
        p.rename(p.path, old)
    try:
        p.rename(new, p.path)
    except OSError:
        if had and not p.exists():
            p.rename(old, p.path)
        raise


def write_folder(df: DataFrame, target: str, *partition: str) -> None:
    """SNK-02, SNK-04. df as Parquet through a folder beside the target."""
    made = f"{target}.{uuid.uuid4().hex}.part"
    w = df.write
    (w.partitionBy(*partition) if partition else w).parquet(made)
    swap_folder(df.sparkSession, made, target)


def write_manifests(records: DataFrame, folder: str) -> None:
    """SNK-05. records(source_id, license, split, ...) -> the corpus manifest and, per source and licence, the
    manifest of terms; both as JSON lines put in place by a swap."""
    for name, df in (("corpus", records), ("licenses", records.groupBy("source_id", "license").agg(F.count("*").alias("files"), F.collect_set("split").alias("splits")))):
        made = f"{folder}/{name}.{uuid.uuid4().hex}.part"
        df.write.json(made)
        swap_folder(records.sparkSession, made, f"{folder}/{name}")


def write_report(summary: DataFrame, title: str, path: str) -> None:
    """SNK-06. A summary of one row as JSON and as a Markdown table. Only that row reaches the driver."""
    row = summary.limit(1).collect()
    doc = row[0].asDict(recursive=True) if row else {}
    spark = summary.sparkSession
    write_document(spark, path + ".json", {"title": title, "summary": json.loads(json.dumps(doc, default=str))})
    lines = [f"# {title}", "", "| Figure | Value |", "|-|-|", *(f"| {k} | {str(v).replace('|', chr(92) + '|')} |" for k, v in doc.items()), ""]
    p = Place(spark, path + ".md")
    out = p.fs.create(p.path, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


def write_shards(df: DataFrame, target: str) -> None:
    """SNK-07, SNK-08. df(split, shard, shard_offset, ids, ...) as a folder per split and shard, sorted by place."""
    write_folder(df.repartition("split", "shard").sortWithinPartitions("split", "shard", "shard_offset"), target, "split", "shard")


def read_shards(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """SRC-17. (rows, faults) of token shards: a fault is a row whose place isn't where the row before it ends."""
    from pyspark.sql import Window as W

    x = spark.read.parquet(target)
    w = W.partitionBy("split", "shard").orderBy("shard_offset")
    due = F.coalesce(F.lag(F.col("shard_offset") + F.size("ids")).over(w), F.lit(0))
    return x, x.select("split", "shard", "shard_offset", due.alias("due")).where("shard_offset != due")


def append_log(df: DataFrame, path: str) -> None:
    """SNK-10. Rows added to a log of JSON lines; null fields are left out."""
    df.write.mode("append").json(path)


def rotate(spark: SparkSession, path: str, key: str, at: str, keep: int) -> int:
    """SNK-12, TOP-08. Keep the rows of the `keep` values of `key` that were written last, and say how many
    values there were. The limit is the feature."""
    x = spark.read.json(path)
    last = x.groupBy(key).agg(F.max(at).alias("_last"))
    n = last.count()
    if n > keep:
        write_json_folder(x.join(last.orderBy(F.desc("_last"), key).limit(keep).select(key), key, "left_semi"), path)
    return n


def write_json_folder(df: DataFrame, target: str) -> None:
    made = f"{target}.{uuid.uuid4().hex}.part"
    df.write.json(made)
    swap_folder(df.sparkSession, made, target)


def write_versioned(spark: SparkSession, folder: str, name: str, document: dict) -> str:
    """SNK-13. A document as the current one and under its fingerprint, which is returned."""
    import hashlib

    mark = hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()[:16]
    for at in (f"{folder}/{name}_{mark}.json", f"{folder}/{name}.json"):
        write_document(spark, at, document)
    return mark


def cached(spark: SparkSession, folder: str, fingerprint: str, make) -> DataFrame:
    """SNK-17. The table that make() gives for a fingerprint, written once; those of other fingerprints are removed."""
    p = Place(spark, folder)
    for name, is_dir, _ in p.names():
        if is_dir and name != fingerprint and not name.endswith(".part"):
            p.fs.delete(p.of(f"{folder}/{name}"), True)
    at = f"{folder}/{fingerprint}"
    if not p.exists(p.of(at)):
        write_folder(make(), at)
    return spark.read.parquet(at)
