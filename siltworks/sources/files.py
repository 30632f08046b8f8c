"""File sources and sinks: discovery, decoding, archives, JSON lines, staged text and task files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.session import ship

#: Limits of the archive check.
MOST_ENTRIES, MOST_BYTES, MOST_FILE, MOST_RATIO, RATIO_FROM = 100_000, 8 << 30, 512 << 20, 250, 8 << 20


def discover(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """SRC-01. path, length and modified of the files with one of the suffixes, whatever their case. The content
    column is pruned, so files are listed, not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return f.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([s.lower().lstrip(".") for s in suffixes]))


def decoded(raw: bytes) -> tuple[str, str]:
    """SRC-18. (text, encoding): UTF-8 with or without mark, else cp1252, else UTF-8 with replacement."""
    for enc in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(enc), "utf-8" if enc == "utf-8-sig" else enc
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "replacement"


def read_texts(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """SRC-02. path, text and encoding of text files."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [decoded(bytes(x)) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [x[0] for x in d], "encoding": [x[1] for x in d]})

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = f.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([s.lower().lstrip(".") for s in suffixes]))
    return f.select("path", "content").mapInPandas(run, "path string, text string, encoding string")


def archive_entries(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-10. archive, entry, size, compressed and the first rule an entry breaks; a broken archive is one row."""

    def rule(i: zipfile.ZipInfo) -> str | None:
        n = i.filename.replace("\\", "/")
        if n.startswith("/") or n[1:2] == ":":
            return "absolute"
        if ".." in n.split("/"):
            return "traversal"
        if i.flag_bits & 1:
            return "encrypted"
        if i.file_size > MOST_FILE:
            return "too-large"
        if i.file_size > RATIO_FROM and i.file_size > MOST_RATIO * max(1, i.compress_size):
            return "ratio"
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        rows += [(path, i.filename, i.file_size, i.compress_size, rule(i)) for i in z.infolist()]
                except zipfile.BadZipFile:
                    rows.append((path, None, 0, 0, "not-an-archive"))
            yield pd.DataFrame(rows, columns=["archive", "entry", "size", "compressed", "problem"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder)
    return f.select("path", "content").mapInPandas(run, "archive string, entry string, size long, compressed long, problem string")


def archive_preflight(entries: DataFrame) -> DataFrame:
    """SRC-05, AGG-10. Per archive: entries, bytes, roots, problems and whether it may be unpacked."""
    g = entries.groupBy("archive").agg(
        F.count("entry").alias("entries"), F.sum("size").alias("bytes"), F.countDistinct(F.split("entry", "/")[0]).alias("roots"), F.count("problem").alias("problems")
    )
    return g.withColumn("ok", (F.col("problems") == 0) & (F.col("entries") <= MOST_ENTRIES) & (F.col("bytes") <= MOST_BYTES))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-15, SRC-35. (rows, broken lines) of JSON lines under an explicit schema; blank lines are neither."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    p = raw.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return p.where("r._bad is null").select("r.*").drop("_bad"), p.where("r._bad is not null").select("value")


def write_json_lines(df: DataFrame, path: str, *partition: str, mode: str = "overwrite") -> None:
    """SNK-09, SNK-10. JSON lines, a folder per value of the partition columns."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).json(path)


def with_header(df: DataFrame) -> DataFrame:
    """SNK-03. df(source_id, original_path, license, text, ...) with the provenance header before the text."""
    h = F.format_string("# source: %s\n# path: %s\n# license: %s\n\n", F.coalesce("source_id", F.lit("")), F.coalesce("original_path", F.lit("")), F.coalesce("license", F.lit("")))
    return df.withColumn("text", F.concat(h, "text"))


def write_split_folders(df: DataFrame, path: str) -> None:
    """SNK-04. Accepted records as Parquet, a folder per split and source."""
    df.write.mode("overwrite").partitionBy("split", "source_id").parquet(path)
