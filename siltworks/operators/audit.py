"""Quality audit: reasons, status, escalation, summary and leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import stripped

#: Licences that are admitted, and reasons that quarantine a record.
ALLOWED = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-3.0", "LicenseRef-User-Owned-Private"]
HARD = ["unknown_or_disallowed_license", "godot_validation_failed", "encoding_damage", "non_gdscript_fragment", "unbalanced_delimiters", "missing_staged_file"]
#: Fixed value: what begins the code of another language.
FOREIGN = r"(?m)^\s*(?:using System|namespace |public class )"
#: Strings and comments of a script; an open one-line string ends with its line, a long one with the text.
_MASKED = r'"""[\s\S]*?(?:"""|\z)|' + r"'''[\s\S]*?(?:'''|\z)|" + r'"(?:[^"\\\n]|\\[^\n])*"?|' + r"'(?:[^'\\\n]|\\[^\n])*'?|#[^\n]*"
_HEADER = r"^(?:@\w+|extends\b|class_name\b|func\b|pass$)"
_TRIM = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def masked(text: Column) -> Column:
    """The code of a script, strings and comments as a blank."""
    return F.regexp_replace(text, _MASKED, " ")


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def masked_sql(c: str) -> str:
    return f"regexp_replace({c}, {_q(_MASKED)}, ' ', 'g')"


def fragment_reasons(text: Column) -> Column:
    """Sorted reasons against a text by itself. The code and its lines are made once, as the elements of
    one-element arrays."""

    def judge(code: Column) -> Column:
        lines = F.filter(F.transform(F.split(code, "\n"), stripped), lambda x: x != "")
        n = lambda x: F.length(code) - F.length(F.replace(code, F.lit(x), F.lit("")))
        return F.transform(F.array(lines), lambda ls: _kept(
            F.when(F.contains(text, F.lit("\x00")) | F.contains(text, F.lit("�")), "encoding_damage"),
            F.when(code.rlike(FOREIGN), "non_gdscript_fragment"),
            F.when(F.array_contains(ls, "pass") & (F.size(ls) <= 12) & ~F.exists(ls, lambda x: ~x.rlike(_HEADER) & ~x.endswith(":")), "pass_only_stub"),
            F.when(F.array_contains(ls, "..."), "placeholder_ellipsis"),
            F.when(F.length(stripped(text)) < 24, "too_short"),
            F.when((n("(") != n(")")) | (n("[") != n("]")) | (n("{") != n("}")), "unbalanced_delimiters"),
        ))[0]

    return F.transform(F.array(masked(text)), judge)[0]


def fragments_sql(text: str, code: str) -> str:
    """fragment_reasons in DuckDB's SQL, over a text and its masked code."""
    lines = f"list_filter(list_transform(string_split({code}, chr(10)), lambda x: regexp_replace(x, {_q(_TRIM)}, '', 'g')), lambda x: x <> '')"
    n = lambda x: f"length({code}) - length(replace({code}, '{x}', ''))"
    return f"""list_filter([CASE WHEN contains({text}, chr(0)) OR contains({text}, chr(65533)) THEN 'encoding_damage' END, CASE WHEN regexp_matches({code}, '{FOREIGN}') THEN 'non_gdscript_fragment' END,
  CASE WHEN list_contains({lines}, 'pass') AND len({lines}) <= 12 AND len(list_filter({lines}, lambda x: NOT regexp_matches(x, '{_HEADER}') AND NOT ends_with(x, ':'))) = 0 THEN 'pass_only_stub' END,
  CASE WHEN list_contains({lines}, '...') THEN 'placeholder_ellipsis' END, CASE WHEN length(regexp_replace({text}, {_q(_TRIM)}, '', 'g')) < 24 THEN 'too_short' END,
  CASE WHEN {n('(')} <> {n(')')} OR {n('[')} <> {n(']')} OR {n('{')} <> {n('}')} THEN 'unbalanced_delimiters' END], lambda x: x IS NOT NULL)"""


def _kept(*reasons: Column) -> Column:
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())


def judged(df: DataFrame) -> DataFrame:
    """df(license, declared, validation_status, found, ...) with `reasons` and `quality`: quarantine for a hard
    reason, warning for any other, else accepted. The source's licence stands in for an empty one; a null
    status is pending; a null `found` is a missing file."""
    lic = F.coalesce(F.nullif("license", F.lit("")), F.nullif("declared", F.lit("")), F.lit("UNKNOWN"))
    status = F.lower(F.trim("validation_status"))
    own = _kept(
        F.when(~lic.isin(ALLOWED), "unknown_or_disallowed_license"),
        F.when(status == "failed", "godot_validation_failed"),
        F.when(status.isNull() | (status == "pending"), "validation_pending"),
        F.when(F.col("found").isNull(), "missing_staged_file"),
    )
    return df.withColumn("reasons", F.concat(own, F.coalesce("found", F.array().cast("array<string>")))).withColumn("quality", _quality(F.col("reasons")))


def _quality(reasons: Column) -> Column:
    hard = F.array(*[F.lit(x) for x in HARD])
    return F.when(F.arrays_overlap(reasons, hard), "quarantine").when(F.size(reasons) > 0, "warning").otherwise("accepted")


def reasons_sql() -> str:
    allowed = "(" + ", ".join(_q(x) for x in ALLOWED) + ")"
    return f"""list_concat(list_filter([CASE WHEN lic NOT IN {allowed} THEN 'unknown_or_disallowed_license' END, CASE WHEN lower(trim(validation_status)) = 'failed' THEN 'godot_validation_failed' END,
  CASE WHEN validation_status IS NULL OR lower(trim(validation_status)) = 'pending' THEN 'validation_pending' END, CASE WHEN found IS NULL THEN 'missing_staged_file' END], lambda x: x IS NOT NULL), coalesce(found, []))"""


def quality_sql(reasons: str) -> str:
    return f"CASE WHEN list_has_any({reasons}, [{', '.join(_q(x) for x in HARD)}]) THEN 'quarantine' WHEN len({reasons}) > 0 THEN 'warning' ELSE 'accepted' END"


def escalated(df: DataFrame) -> DataFrame:
    """df(record_id, reasons, quality, first_id, near_duplicate_of, text_leaks, group_leaks, ...) with both
    raised: copies and leaks are quarantined, a near duplicate is a warning where the record was accepted."""
    no = F.lit(False)
    copy = F.coalesce(F.col("first_id") != F.col("record_id"), no)
    leak = F.coalesce("text_leaks", no) | F.coalesce("group_leaks", no)
    near = F.col("near_duplicate_of").isNotNull()
    more = _kept(F.when(copy, "normalized_exact_duplicate"), F.when(near, "near_duplicate"), F.when(leak, "split_leakage"))
    q = F.when(copy | leak, "quarantine").when(near & (F.col("quality") == "accepted"), "warning").otherwise(F.col("quality"))
    return df.withColumns({"reasons": F.array_sort(F.array_distinct(F.concat("reasons", more))), "quality": q, "leaking": leak})


def summary(a: DataFrame) -> DataFrame:
    """One row of counters over audited records with `sp`."""
    q, s, v = F.col("quality"), F.col("sp"), F.lower(F.trim("validation_status"))
    rate = F.count_if(v == "passed") / F.nullif(F.count_if(v.isin("passed", "failed")), F.lit(0))
    return a.agg(
        F.count("*").alias("records"),
        F.count_if(q == "accepted").alias("accepted"),
        F.count_if(q == "warning").alias("warning"),
        F.count_if(q == "quarantine").alias("quarantined"),
        F.count_if(s == "train").alias("train"),
        F.count_if(s == "val").alias("val"),
        F.count_if(s == "test").alias("test"),
        F.countDistinct(F.when(s == "train", F.col("group_id"))).alias("train_groups"),
        F.sum(F.coalesce(F.col("bytes"), F.lit(0))).cast("long").alias("bytes"),
        F.round(F.coalesce(rate, F.lit(1.0)), 6).alias("parser_rate"),
    )


def leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys found in more than one split, with the sorted splits. The set of splits of a key is at most
    as long as there are splits, so hot keys stay small."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    return g.select(key, F.array_join("s", ",").alias("splits"))
