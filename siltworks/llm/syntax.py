"""Source files that do not parse.

Every text is parsed where it is read against all grammars a record can claim; where none of them or
only another than its file's own accepts it, the foreign grammars follow in the order in which their
tokens rank. What a foreign grammar accepts has a wrong extension, what none accepts is corrupt. Only
verdicts are shuffled, never texts.

Defined cases: null, empty and blank texts are no text and no case; a byte order mark and the kind of
line end are no faults; a record whose path claims no known language (.env, say) has no verdict; of
repeated rows of one path the least verdict is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import canonical_path
from siltworks.llm import grammars as G
from siltworks.session import spread
from siltworks.sources.tables import records, table

#: The languages a path can claim.
CLAIMS = ("gdscript", "javascript", "json", "godot_cfg")
_SUFFIX = {"gd": "gdscript", "js": "javascript", "json": "json", "cfg": "godot_cfg"}


def claimed(path: Column) -> Column:
    """The language that original_path names; null for none."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"#gdscript-\d+$"), "gdscript")
        .when(p.rlike(r"\.gd$"), "gdscript")
        .when(p.rlike(r"\.(?:js|mjs|cjs)$"), "javascript")
        .when(p.rlike(r"\.json$"), "json")
        .when(p.rlike(r"\.(?:cfg|ini|godot|import)$"), "godot_cfg")
    )


def verdict(text: str, own: str | None) -> tuple[list[str], str | None, dict[str, str]]:
    """(grammars of CLAIMS that accept the text, the best language or None, faults by grammar)."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    valid, faults = [], {}
    for k in CLAIMS:
        f = G.GRAMMARS[k](text)
        if f is None:
            valid.append(k)
        else:
            faults[k] = f"{f[0]}: {f[1]}"
    if own in valid:
        return valid, own, faults
    for k in G.ranked(text):
        if k in valid or k not in CLAIMS and G.GRAMMARS[k](text) is None:
            return valid, k, faults
    return valid, None, faults


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["staged_path"], pdf["text"]):
            own = _SUFFIX.get(path.rpartition(".")[2].lower())
            valid, best, faults = verdict(text, own)
            rows.append((path, ",".join(valid), best, [faults.get(k) for k in CLAIMS]))
        yield pd.DataFrame(rows, columns=["staged_path", "valid", "best", "faults"])


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """One row per staged path with text: the grammars that accept it, the language found, the faults."""
    src = table(spark, d, "staged_files", "staged_path", "text").where(F.col("staged_path").isNotNull() & F.col("text").rlike(r"[^\s﻿]"))
    out = spread(src).mapInPandas(_parse, "staged_path string, valid string, best string, faults array<string>")
    return out.groupBy("staged_path").agg(F.min(F.struct("valid", "best", "faults")).alias("v")).select("staged_path", "v.*")


def judged(spark: SparkSession, d: str) -> DataFrame:
    """record_id, project, language, ok, kind (wrong_extension or corrupt where not ok), found, line and
    fault of every record with text that claims a language."""
    r = records(spark, d, "original_path", "staged_path", "project_root", "validation_status").withColumn("language", claimed(F.col("original_path")))
    j = r.where("language is not null").join(verdicts(spark, d), "staged_path")
    ok = F.array_contains(F.split("valid", ","), F.col("language"))
    fault = F.element_at("faults", F.array_position(F.array(*map(F.lit, CLAIMS)), F.col("language")).cast("int"))
    return j.select(
        "record_id",
        canonical_path(F.col("project_root")).alias("project"),
        "language",
        ok.alias("ok"),
        F.when(~ok, F.when(F.col("best").isNotNull() & (F.col("best") != F.col("language")), "wrong_extension").otherwise("corrupt")).alias("kind"),
        F.when(~ok, F.col("best")).alias("found"),
        F.when(~ok, F.substring_index(fault, ":", 1).cast("long")).alias("line"),
        F.when(~ok, F.regexp_replace(fault, r"^\d+: ", "")).alias("fault"),
        F.lower(F.trim("validation_status")).alias("old_status"),
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text is not valid in the language of their path."""
    return judged(spark, d).where("not ok").select("record_id")


def faults(spark: SparkSession, d: str) -> DataFrame:
    """The invalid records with language, kind of defect, language found instead, line and fault."""
    return judged(spark, d).where("not ok").drop("ok", "old_status")


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Per project and language: files, invalid ones by kind, the rate, and how many the old validator
    had as failed."""
    return (
        judged(spark, d)
        .groupBy("project", "language")
        .agg(
            F.count("*").alias("files"),
            F.count_if(~F.col("ok")).alias("invalid"),
            F.count_if(F.col("kind") == "wrong_extension").alias("wrong_extension"),
            F.count_if(F.col("kind") == "corrupt").alias("corrupt"),
            F.round(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)), 6).alias("rate"),
            F.count_if(F.col("old_status") == "failed").alias("failed_before"),
        )
    )


QUERIES = {"p4_found": found, "p4_faults": faults, "p4_rates": rates}
SQL: dict[str, str] = {}
