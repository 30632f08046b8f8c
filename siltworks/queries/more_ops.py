"""Validation decisions, cache joins, suffix joins, prompts and completions: queries with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.sources.tables import STG, per_text, table

query = Registry()


@query("""WITH c AS (SELECT DISTINCT lower(content_sha256) AS sha, 1 AS hit FROM records WHERE lower(trim(validation_status)) = 'passed' AND content_sha256 IS NOT NULL),
 r AS (SELECT DISTINCT record_id, coalesce(nullif(trim(project_root), ''), 'none') AS project, lower(content_sha256) AS sha FROM records WHERE record_id IS NOT NULL)
SELECT project, count(*) AS records, count(hit) AS hits, count(hit) = count(*) AS whole_project FROM r LEFT JOIN c USING (sha) GROUP BY project""")
def validation_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-06, SRC-31. Records whose content was validated before, and projects of which every record was: the for-all is an
    aggregate, not a window."""
    x = table(spark, d, "records", "record_id", "project_root", "content_sha256", "validation_status")
    c = x.where("lower(trim(validation_status)) = 'passed' and content_sha256 is not null").select(F.lower("content_sha256").alias("sha")).distinct().withColumn("hit", F.lit(1))
    r = x.where("record_id is not null").select("record_id", F.coalesce(F.nullif(F.trim("project_root"), F.lit("")), F.lit("none")).alias("project"), F.lower("content_sha256").alias("sha")).distinct()
    g = r.join(c, "sha", "left").groupBy("project").agg(F.count("*").alias("records"), F.count("hit").alias("hits"))
    return g.withColumn("whole_project", F.col("hits") == F.col("records"))


@query(f"""WITH {REC}, p AS (SELECT project_root, unnest(parser_failed_files) AS failed FROM project_audits), f AS (SELECT DISTINCT failed FROM p WHERE failed IS NOT NULL),
 m AS (SELECT r.record_id, f.failed FROM rec r JOIN f ON r.original_path = f.failed OR ends_with(r.original_path, '/' || f.failed))
SELECT record_id, min(failed) AS failed FROM m GROUP BY record_id HAVING count(*) = 1""")
def failed_path_matches(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-07. Records that exactly one failed path names, whole or as a suffix. A suffix match is an equality with
    one of the record path's suffixes, so nothing is compared pairwise."""
    f = table(spark, d, "project_audits", "parser_failed_files").select(F.explode("parser_failed_files").alias("failed")).where("failed is not null").distinct()
    parts = F.split("original_path", "/")
    suffixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    r = plain_records(spark, d, "original_path").where("original_path is not null").select("record_id", suffixes.alias("failed"))
    return r.join(f, "failed").groupBy("record_id").agg(F.min("failed").alias("failed"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH {REC}, x AS (SELECT *, lower(trim(validation_status)) AS s, validation_error AS err FROM rec)
SELECT record_id, CASE WHEN kind = 'rst_gdscript' THEN 'not_required' WHEN s = 'passed' AND err IS NOT NULL THEN 'passed_with_context' WHEN s = 'passed' THEN 'passed' WHEN s = 'failed' AND regexp_matches(lower(err), 'missing resource|autoload|not known|could not be resolved') THEN 'context_only'
 WHEN s = 'failed' AND regexp_matches(lower(err), 'timeout') THEN 'retry' WHEN s = 'failed' THEN 'rejected' ELSE 'pending' END AS decision FROM x""")
def validation_decision(spark: SparkSession, d: str) -> DataFrame:
    """POL-03. The decision table over kind, status and message."""
    r = plain_records(spark, d, "kind", "validation_status", "validation_error").withColumnRenamed("validation_error", "err")
    s, m = F.lower(F.trim("validation_status")), F.lower("err")
    k = (
        F.when(F.col("kind") == "rst_gdscript", "not_required").when((s == "passed") & F.col("err").isNotNull(), "passed_with_context").when(s == "passed", "passed")
        .when((s == "failed") & m.rlike("missing resource|autoload|not known|could not be resolved"), "context_only").when((s == "failed") & m.rlike("timeout"), "retry")
        .when(s == "failed", "rejected").otherwise("pending")
    )
    return r.select("record_id", k.alias("decision"))


@query(f"""WITH {STG}, l AS (SELECT staged_path, text, string_split(text, chr(10)) AS ls FROM stg WHERE text IS NOT NULL)
SELECT staged_path, CAST(len(list_filter(ls, lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#'))) AS BIGINT) AS code_lines, round(least(1.0, len(list_filter(ls, lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#'))) / 3.0), 6) AS substance,
 len(list_filter(ls, lambda x: trim(x) NOT IN ('', 'pass', 'return') AND NOT starts_with(ltrim(x), '#'))) = 0 AS is_trivial FROM l""")
def completion_substance(spark: SparkSession, d: str) -> DataFrame:
    """FN-47, AGG-19. Code lines, substance score and triviality of a text taken as a completion."""
    code = F.filter(F.split("text", "\n"), lambda s: (F.trim(s) != "") & ~F.ltrim(s).startswith("#"))
    facts = F.transform(F.array(code), lambda c: F.struct(F.size(c).alias("n"), F.size(F.filter(c, lambda s: ~F.trim(s).isin("pass", "return"))).alias("real")))[0]
    x = per_text(spark, d, f=facts).select("staged_path", "f.*")
    return x.select("staged_path", F.col("n").cast("long").alias("code_lines"), F.round(F.least(F.lit(1.0), F.col("n") / 3.0), 6).alias("substance"), (F.col("real") == 0).alias("is_trivial"))


@query(r"""WITH t AS (SELECT source, min_by(text, struct_pack(a := doc_id, b := text)) AS a, max_by(text, struct_pack(a := doc_id, b := text)) AS b FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source),
 w AS (SELECT source, regexp_split_to_array(a, '[ \t\n\r\f\x0B]+') AS x, regexp_split_to_array(b, '[ \t\n\r\f\x0B]+') AS y FROM t)
SELECT source, CAST(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i])) AS BIGINT) AS same, round(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i])) / len(y), 6) AS ratio FROM w""")
def positional_match_ratio(spark: SparkSession, d: str) -> DataFrame:
    """FN-49. Share of a reference's tokens that stand at the same place in a generated row; here the last
    against the first whole text of every source. The two are found by aggregates with map-side combining."""
    o = F.struct("doc_id", "text")
    t = table(spark, d, "documents", "source", "text", "doc_id").where("text is not null and source is not null and doc_id is not null").groupBy("source").agg(F.min_by("text", o).alias("a"), F.max_by("text", o).alias("b"))
    x, y = F.split("a", r"[ \t\n\r\f\x0B]+"), F.split("b", r"[ \t\n\r\f\x0B]+")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda z: z))
    return t.select("source", same.cast("long").alias("same"), F.round(same / F.size(y), 6).alias("ratio"))


@query("""WITH x AS (SELECT doc_id, max(strlen(coalesce(text, ''))) AS body, max(strlen(coalesce(title, ''))) AS title, max(strlen(coalesce(source, ''))) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), y AS (SELECT *, 1023 - title - source AS room FROM x)
SELECT doc_id, title + source + body AS total, least(body, greatest(room, 0)) AS kept, body - least(body, greatest(room, 0)) AS dropped, title + source + body <= 1023 AS fits FROM y""")
def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    """FN-51, STR-04. A prompt of fixed parts and a body trimmed to what the window leaves."""
    n = lambda c: F.max(F.octet_length(F.coalesce(c, F.lit("")))).cast("long").alias(c)
    x = table(spark, d, "documents", "doc_id", "text", "title", "source").where("doc_id is not null").groupBy("doc_id").agg(n("text"), n("title"), n("source"))
    fixed = F.col("title") + F.col("source")
    kept = F.least("text", F.greatest(1023 - fixed, F.lit(0)))
    return x.select("doc_id", (fixed + F.col("text")).alias("total"), kept.alias("kept"), (F.col("text") - kept).alias("dropped"), (fixed + F.col("text") <= 1023).alias("fits"))


@query(f"""WITH {REC}, x AS (SELECT record_id, regexp_extract(original_path, '[.]([a-z]+)(#.*)?$', 1) AS ext, lower(regexp_extract(original_path, '([^/]*)$', 1)) AS name FROM rec WHERE original_path IS NOT NULL)
SELECT ext, count(*) AS files, count(*) FILTER (regexp_matches(name, 'secret|credential|password|[.]env|[.]pem|[.]key')) AS secret_named, count(*) FILTER (regexp_matches(name, '[.](exe|dll|so|dylib|bat|cmd|ps1|sh)$')) AS executable, count(*) FILTER (contains(name, '#gdscript-')) AS snippets FROM x GROUP BY ext""")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08. Files by ending, with those whose names tell secrets or executables."""
    name = F.lower(F.regexp_extract("original_path", "([^/]*)$", 1))
    x = plain_records(spark, d, "original_path").where("original_path is not null").select(F.regexp_extract("original_path", "[.]([a-z]+)(#.*)?$", 1).alias("ext"), name.alias("name"))
    c = F.col("name")
    return x.groupBy("ext").agg(
        F.count("*").alias("files"),
        F.count_if(c.rlike("secret|credential|password|[.]env|[.]pem|[.]key")).alias("secret_named"),
        F.count_if(c.rlike("[.](exe|dll|so|dylib|bat|cmd|ps1|sh)$")).alias("executable"),
        F.count_if(c.contains("#gdscript-")).alias("snippets"),
    )


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM (SELECT doc_id, min(text) AS text FROM documents WHERE doc_kind = 'log' AND text IS NOT NULL GROUP BY doc_id)), e AS (SELECT doc_id, i, array_to_string(ls[greatest(i - 1, 1):i + 2], ' ') AS block FROM l, unnest(range(1, len(ls) + 1)) AS u(i) WHERE regexp_matches(lower(ls[i]), 'error|failed|warn'))
SELECT doc_id, count(*) AS lines, min(i) AS first_line, min_by(substr(block, 1, 700), i) AS first_block FROM e GROUP BY doc_id""")
def error_blocks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06. The error lines of a log: how many, the first, and it with the line before and the two after,
    700 characters of them at most, as the report has it. Made within the row: no line is exploded."""
    t = table(spark, d, "documents", "doc_id", "text", "doc_kind").where("doc_kind = 'log' and text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    at = F.filter(F.transform("ls", lambda x, i: F.when(F.lower(x).rlike("error|failed|warn"), i + 1)), lambda i: i.isNotNull())
    x = t.select("doc_id", F.split("text", "\n").alias("ls")).select("doc_id", "ls", at.alias("at")).where(F.size("at") > 0)
    i = F.col("at")[0]
    block = F.array_join(F.slice("ls", F.greatest(i - 1, F.lit(1)), F.when(i > 1, 4).otherwise(3)), " ")
    return x.select("doc_id", F.size("at").cast("long").alias("lines"), i.cast("long").alias("first_line"), F.substring(block, 1, 700).alias("first_block"))


@query(f"""WITH {REC}, n AS (SELECT source_id, coalesce(nullif(trim(project_root), ''), 'none') AS project, count(*) AS records FROM rec GROUP BY 1, 2)
SELECT source_id, project, records, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY records DESC, project) AS rn FROM n) WHERE rn <= 2""")
def largest_projects(spark: SparkSession, d: str) -> DataFrame:
    """The two largest projects of every source; the rank is the feature."""
    n = plain_records(spark, d, "source_id", "project_root").groupBy("source_id", F.coalesce(F.nullif(F.trim("project_root"), F.lit("")), F.lit("none")).alias("project")).agg(F.count("*").alias("records"))
    return n.withColumn("rn", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("records"), "project")).cast("long")).where("rn <= 2")


@query("""WITH r AS (SELECT source, reason, split_part(reason, ':', 1) AS class FROM skipped WHERE reason IS NOT NULL) SELECT class, count(*) AS n, count(DISTINCT source) AS sources FROM r GROUP BY class ORDER BY n DESC, class LIMIT 5""")
def top_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """AGG-29, TOP-05. The five most frequent reasons to skip; the limit is the feature."""
    r = table(spark, d, "skipped", "source", "reason").where("reason is not null").select("source", F.substring_index("reason", ":", 1).alias("class"))
    return r.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).orderBy(F.desc("n"), "class").limit(5)


@query(f"""WITH {REC}, {STG} SELECT coalesce(source_id, 'none') AS source_id, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS stated, CAST(sum(coalesce(real, 0)) AS BIGINT) AS real, count(*) FILTER (coalesce(bytes, 0) <> coalesce(real, 0)) AS differing FROM rec LEFT JOIN (SELECT staged_path AS sp, strlen(text) AS real FROM stg) ON sp = staged_path GROUP BY 1""")
def stated_bytes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27. Stated against real sizes per source."""
    r = plain_records(spark, d, "source_id", "bytes", "staged_path").join(per_text(spark, d, real=F.octet_length("text")), "staged_path", "left")
    b, x = F.coalesce("bytes", F.lit(0)), F.coalesce("real", F.lit(0))
    return r.groupBy(F.coalesce("source_id", F.lit("none")).alias("source_id")).agg(F.sum(b).alias("stated"), F.sum(x).cast("long").alias("real"), F.count_if(b != x).alias("differing"))


QUERIES, SQL = query.queries, query.sql
