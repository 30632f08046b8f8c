"""Scripts, completions, prompts and token rows over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import grams as G
from siltworks.functions import scripts as P
from siltworks.functions import subwords
from siltworks.operators import audit
from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.session import spread
from siltworks.sources.tables import STG, one_per_key, per_text, table

query = Registry()
#: Tokens of a completion at most, of a prompt's window, and of a training window, as parameters of the queries here.
COMPLETION, WINDOW, ROW = 256, 1024, 256


def each(spark: SparkSession, d: str, make: Callable[[str], list[tuple]], schema: str, scripts: bool = True) -> DataFrame:
    """staged_path and the rows that `make` gives for its text, of scripts only where `scripts` is set. Of
    several texts of a path the one with the least hash counts; only what is made of a text moves."""
    names = [x.split()[0] for x in schema.split(", ")]
    t = table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null")
    t = t.where(F.col("staged_path").endswith(".gd")) if scripts else t

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, h, [dict(zip(names, r)) for r in make(x)]) for p, h, x in zip(pdf["staged_path"], pdf["sha"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["staged_path", "sha", "made"])

    inner = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in schema.split(", "))
    x = spread(t.withColumn("sha", F.sha2("text", 256))).mapInPandas(run, f"staged_path string, sha string, made array<struct<{inner}>>")
    return one_per_key(x, "staged_path", "sha", "made").select("staged_path", F.explode("made").alias("m")).select("staged_path", "m.*")


@query()
def static_warnings(spark: SparkSession, d: str) -> DataFrame:
    """FN-34, STR-02, FN-04. Warnings of the static scan of scripts, with lines. No SQL: brackets need a stack;
    tested on fixtures."""
    return each(spark, d, P.static_warnings, "code string, line long")


@query(f"""WITH {STG}, n AS (SELECT staged_path, regexp_extract_all({audit.masked_sql("text")}, '(?m)^func\\s+([A-Za-z_]\\w*)\\s*\\(', 1) AS names FROM stg WHERE ends_with(staged_path, '.gd'))
SELECT staged_path, array_to_string(list_sort(list_filter(list_distinct(names), lambda x: x <> '_init' AND len(list_filter(names, lambda y: y = x)) > 1)), ',') AS doubled, len(names) AS functions FROM n WHERE len(names) > 0""")
def function_names(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14. Functions at the top level of a script, and the names that occur twice."""
    names = F.regexp_extract_all(audit.masked(F.col("text")), F.lit(r"(?m)^func\s+([A-Za-z_]\w*)\s*\("), F.lit(1))
    x = per_text(spark, d, names=names).where(F.col("staged_path").endswith(".gd") & (F.size("names") > 0))
    twice = F.filter(F.array_distinct("names"), lambda n: (n != "_init") & (F.size(F.filter("names", lambda m: m == n)) > 1))
    return x.select("staged_path", F.array_join(F.array_sort(twice), ",").alias("doubled"), F.size("names").cast("long").alias("functions"))


@query()
def cut_repetitions(spark: SparkSession, d: str) -> DataFrame:
    """FN-09. Lines and characters of every text that stay when it is cut where it runs into a loop. No SQL: the
    search goes over blocks of lines; tested against brute force."""

    def make(x: str) -> list[tuple]:
        y = P.cut_repetition(x)
        return [(y.count("\n") + 1, len(y), len(x))]

    return each(spark, d, make, "lines long, kept long, chars long", scripts=False)


@query()
def last_functions(spark: SparkSession, d: str) -> DataFrame:
    """FN-46. The completion task made of a script's last function that fits. No SQL: a walk over lines."""
    return each(spark, d, lambda x: [r for r in [P.last_function(x, COMPLETION)] if r], "prompt string, completion string, tokens long")


@query()
def mutation_variants(spark: SparkSession, d: str) -> DataFrame:
    """FN-48, UDF-06. Variants of every function block that mean the same. No SQL: tested on fixtures."""
    return each(spark, d, lambda x: [(i, *v) for i, b in enumerate(P.blocks(x.replace("\r\n", "\n"))) for v in P.mutations(b)], "block long, kind string, variant string")


@query()
def byte_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """FN-22, FN-23. Byte tokens of every text, and whether decoding gives the text back. No SQL: an exact round
    trip is the test."""

    def make(x: str) -> list[tuple]:
        ids = G.byte_ids(x)
        return [(len(ids), P.decoded_bytes(ids.tolist()) == x)]

    return each(spark, d, make, "tokens long, same boolean", scripts=False)


@query()
def subword_counts(spark: SparkSession, d: str) -> DataFrame:
    """FN-25, UDF-01. Subwords of every text under a public vocabulary, whose folder is a parameter, its characters
    and whether decoding gives the text back. No SQL: an exact round trip is the test."""
    at = subwords.folder(spark)

    def make(x: str) -> list[tuple]:
        tok = subwords.Subwords(subwords.byte_bpe(at))
        ids = tok.encode(x)
        return [(len(ids), len(x), tok.decode(ids) == x)]

    return each(spark, d, make, "subwords long, chars long, same boolean", scripts=False)


@query()
def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    """FN-50, FN-51, FN-70, STR-04. A prompt of a fixed header, a text and a fixed tail in the window: tokens,
    dropped tokens and share of each part. No SQL: a cut falls between characters; tested on fixtures."""

    def make(x: str) -> list[tuple]:
        parts = P.composed([("task_header", "# Task: complete the script\n", True), ("user_prompt", x, False), ("task_tail", "\n", True)], WINDOW)
        total = sum(n for _, _, n, _ in parts)
        return [(k, n, lost, round(100.0 * n / max(1, total), 4)) for k, _, n, lost in parts]

    return each(spark, d, make, "part string, tokens long, dropped long, share double", scripts=False)


@query()
def shifted_windows(spark: SparkSession, d: str) -> DataFrame:
    """FN-63. Training rows of byte tokens and the same shifted by one, window after window. No SQL: tested by
    putting the windows together again."""

    def make(x: str) -> list[tuple]:
        ids = G.byte_ids(x)
        return [(a, ids[a : a + ROW].tolist(), ids[a + 1 : a + 1 + ROW].tolist()) for a in range(0, len(ids) - ROW, ROW)]

    return each(spark, d, make, "start long, x array<int>, y array<int>", scripts=False)


@query(f"""WITH {REC}, {STG}, c AS (SELECT r.record_id, regexp_extract(r.original_path, '([^/]+)/[^/]*$', 1) AS folder, s.text FROM rec r JOIN stg s USING (staged_path) WHERE regexp_matches(r.original_path, '[.](?:cfg|godot)$'))
SELECT record_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^config/name\\s*=\\s*"([^"]+)"', 1)), ''), folder) AS name, array_to_string(regexp_extract_all(regexp_extract(text, '(?ms)PackedStringArray\\((.*?)\\)', 1), '"([^"]+)"', 1), ',') AS features,
 CASE WHEN regexp_matches(regexp_extract(text, '(?ms)config/features\\s*=\\s*PackedStringArray\\((.*?)\\)', 1), '["'']4(?:[.]|["''])') THEN 'godot4' WHEN TRY_CAST(regexp_extract(text, '(?m)^\\s*config_version\\s*=\\s*(\\d+)', 1) AS BIGINT) >= 5 THEN 'godot4'
 WHEN TRY_CAST(regexp_extract(text, '(?m)^\\s*config_version\\s*=\\s*(\\d+)', 1) AS BIGINT) <= 4 THEN 'godot3' ELSE 'unknown' END AS generation FROM c""")
def project_config(spark: SparkSession, d: str) -> DataFrame:
    """FN-30, FN-31. Name, first list of features and engine generation that a configuration tells."""
    t = F.col("text")
    version = F.regexp_extract(t, r"(?m)^\s*config_version\s*=\s*(\d+)", 1).try_cast("long")
    generation = (
        F.when(F.regexp_extract(t, r"(?ms)config/features\s*=\s*PackedStringArray\((.*?)\)", 1).rlike("[\"']4(?:[.]|[\"'])"), "godot4").when(version >= 5, "godot4").when(version <= 4, "godot3").otherwise("unknown")
    )
    listed = F.array_join(F.regexp_extract_all(F.regexp_extract(t, r"(?ms)PackedStringArray\((.*?)\)", 1), F.lit('"([^"]+)"'), F.lit(1)), ",")
    facts = per_text(spark, d, name=F.nullif(F.trim(F.regexp_extract(t, r'(?m)^config/name\s*=\s*"([^"]+)"', 1)), F.lit("")), features=listed, generation=generation)
    r = plain_records(spark, d, "original_path", "staged_path").where(F.col("original_path").rlike("[.](?:cfg|godot)$"))
    return r.join(facts, "staged_path").select("record_id", F.coalesce("name", F.regexp_extract("original_path", "([^/]+)/[^/]*$", 1)).alias("name"), "features", "generation")


@query(f"""WITH {STG}, h AS (SELECT staged_path, text, string_split(text, chr(10))[1] || chr(10) AS prompt FROM stg) SELECT staged_path, length(prompt) AS prompt_chars, CASE WHEN starts_with(text, prompt) THEN length(text) - length(prompt) ELSE length(text) END AS suffix_chars, sha256(CASE WHEN starts_with(text, prompt) THEN substr(text, length(prompt) + 1) ELSE text END) AS suffix_sha FROM h""")
def completion_suffix(spark: SparkSession, d: str) -> DataFrame:
    """AGG-37. A result without the prompt that it begins with; the prompt here is the first line."""
    prompt = F.concat(F.substring_index("text", "\n", 1), F.lit("\n"))
    rest = F.when(F.startswith("text", prompt), F.substr("text", F.length(prompt) + 1)).otherwise(F.col("text"))
    return per_text(spark, d, prompt_chars=F.length(prompt).cast("long"), suffix_chars=F.length(rest).cast("long"), suffix_sha=F.sha2(rest, 256))


QUERIES, SQL = query.queries, query.sql
