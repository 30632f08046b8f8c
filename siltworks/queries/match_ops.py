"""Joins, sets, retention and file rules over records, audits and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions import ident as I
from siltworks.functions import text as T
from siltworks.functions.paths import canonical_path, trimmed
from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.sources.tables import SPLIT_SQL, STG, per_text, split_name, table

query = Registry()
_STATUS = "lower(trim(validation_status))"
_ROOT = r"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || trim({c}), '[\\/]+', '/', 'g'), '(/\.)+(/|$)', '/', 'g'), '/[^/]+/\.\.(/|$)', '/', 'g'), '^/+|/+$', '', 'g'), '')"""
#: One row per audited project: the latest audit.
_AUDIT = f"aud AS (SELECT * FROM (SELECT *, {_ROOT.format(c='project_root')} AS project, row_number() OVER (PARTITION BY {_ROOT.format(c='project_root')} ORDER BY audited_at DESC NULLS LAST, source_sha256 DESC NULLS LAST) AS rn FROM project_audits) WHERE rn = 1 AND project IS NOT NULL)"


def audits(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """project and `cols` of its latest audit."""
    a = table(spark, d, "project_audits", "project_root", "audited_at", "source_sha256", *cols).withColumn("project", canonical_path(F.col("project_root"))).where("project is not null")
    return a.groupBy("project").agg(F.max_by(F.struct(*cols), F.struct("audited_at", "source_sha256")).alias("a")).select("project", "a.*")


def _folders(path: str):
    """The folders above a path, deepest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


@query(f"""WITH {REC}, p AS (SELECT record_id, source_id, original_path, string_split(regexp_replace(original_path, '#.*$', ''), '/') AS parts FROM rec WHERE original_path IS NOT NULL AND source_id IS NOT NULL),
 m AS (SELECT DISTINCT source_id, array_to_string(parts[1:len(parts) - 1], '/') AS folder FROM p WHERE ends_with(original_path, '.cfg') AND len(parts) > 1), u AS (SELECT record_id, source_id, array_to_string(parts[1:i], '/') AS folder, i FROM p, unnest(range(1, len(parts))) AS t(i)),
 b AS (SELECT record_id, max_by(folder, i) AS near FROM u JOIN m USING (source_id, folder) GROUP BY record_id) SELECT p.record_id, p.source_id || '::' || coalesce(near, nullif(array_to_string(parts[1:len(parts) - 1], '/'), ''), 'root') AS group_key, near IS NOT NULL AS in_project FROM p LEFT JOIN b USING (record_id)""")
def group_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN-59, JOIN-19. The group of a record: the nearest folder above it that holds a configuration, else its
    own folder, else the root. Every folder above a path is looked up by equality."""
    p = plain_records(spark, d, "source_id", "original_path").where("original_path is not null and source_id is not null").withColumn("path", F.substring_index("original_path", "#", 1))
    up = _folders("path")
    own = F.get(up, F.lit(0))
    m = p.where(F.col("original_path").endswith(".cfg") & own.isNotNull()).select("source_id", own.alias("folder")).distinct()
    u = p.select("record_id", "source_id", F.explode(up).alias("folder"))
    b = u.join(m, ["source_id", "folder"]).groupBy("record_id").agg(F.max_by("folder", F.size(F.split("folder", "/"))).alias("near"))
    key = F.concat("source_id", F.lit("::"), F.coalesce("near", F.nullif(own, F.lit("")), F.lit("root")))
    return p.join(b, "record_id", "left").select("record_id", key.alias("group_key"), F.col("near").isNotNull().alias("in_project"))


@query(f"""WITH {REC}, f AS (SELECT DISTINCT original_path AS path, {I.stable_fraction_sql('original_path')} < 0.15 AS low FROM rec WHERE original_path IS NOT NULL), k AS (SELECT count(*) FILTER (low) AS v, count(*) FILTER (NOT low) AS t, max(path) AS last, min(path) AS first FROM f)
SELECT path, CASE WHEN v = 0 AND path = last THEN 'val' WHEN t = 0 AND path = first THEN 'train' WHEN low THEN 'val' ELSE 'train' END AS split FROM f, k""")
def path_split(spark: SparkSession, d: str) -> DataFrame:
    """FN-62. Files to train and val by the stable fraction of their path; where one would be empty, the last or
    the first file in path order fills it."""
    f = plain_records(spark, d, "original_path").where("original_path is not null").select(F.col("original_path").alias("path")).distinct().withColumn("low", I.stable_fraction(F.col("path")) < 0.15)
    k = f.agg(F.count_if("low").alias("v"), F.count_if(~F.col("low")).alias("t"), F.max("path").alias("last"), F.min("path").alias("first"))
    c = F.col
    split = F.when((c("v") == 0) & (c("path") == c("last")), "val").when((c("t") == 0) & (c("path") == c("first")), "train").when(c("low"), "val").otherwise("train")
    return f.crossJoin(F.broadcast(k)).select("path", split.alias("split"))  # one row


@query(f"""WITH {REC} SELECT record_id, CASE WHEN lower(split_policy) IN ('train', 'val', 'test') THEN lower(split_policy) WHEN rec.kind = 'user_lessons' THEN 'train' ELSE {I.hash_split_sql("coalesce(source_id, '') || '::' || coalesce(nullif(trim(group_id), ''), record_id)")} END AS split FROM rec LEFT JOIN sources ON id = source_id""")
def policy_split(spark: SparkSession, d: str) -> DataFrame:
    """FN-28, SRC-04, SET-01. A source's own split goes first, lessons of users are training data, and the rest
    is split by the hash of source and group."""
    s = table(spark, d, "sources", "id", "split_policy").select(F.col("id").alias("source_id"), F.lower("split_policy").alias("policy"))
    r = plain_records(spark, d, "source_id", "group_id", "kind").join(F.broadcast(s), "source_id", "left")  # sources is a fixed list
    u = F.concat(F.coalesce("source_id", F.lit("")), F.lit("::"), F.coalesce(trimmed(F.col("group_id")), F.col("record_id")))
    return r.select("record_id", F.when(F.col("policy").isin("train", "val", "test"), F.col("policy")).when(F.col("kind") == "user_lessons", "train").otherwise(I.hash_split(u)).alias("split"))


@query(f"""WITH {REC} SELECT source_id, count(*) AS records, count(*) FILTER ({_STATUS} = 'passed') AS passed, count(*) FILTER (kind = 'rst_gdscript') AS not_required, count(*) FILTER ({_STATUS} = 'passed' OR kind = 'rst_gdscript') AS prepared, count(*) FILTER ({_STATUS} = 'passed' OR kind = 'rst_gdscript') >= 10 AS enough FROM rec GROUP BY source_id""")
def prepared_counts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, POL-06. What a source's validation lets through, and whether that is the least number of files."""
    ok, doc = F.lower(F.trim("validation_status")) == "passed", F.col("kind") == "rst_gdscript"
    g = plain_records(spark, d, "source_id", "validation_status", "kind").groupBy("source_id").agg(F.count("*").alias("records"), F.count_if(ok).alias("passed"), F.count_if(doc).alias("not_required"), F.count_if(ok | doc).alias("prepared"))
    return g.withColumn("enough", F.col("prepared") >= 10)


@query(f"""WITH {REC}, h AS (SELECT record_id, source_id, {SPLIT_SQL.format(c='split')} AS split FROM rec WHERE {_STATUS} = 'passed' AND ends_with(original_path, '.gd')) SELECT source_id, split, record_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, split ORDER BY record_id) AS rn FROM h WHERE split IN ('val', 'test')) WHERE rn <= 8""")
def heldout_cases(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16, SRC-28, TOP-06. Up to eight passed scripts of a source's val and test split, in the order of their
    ids, by a rank with partial limits; the eight are the feature."""
    h = plain_records(spark, d, "source_id", "split", "validation_status", "original_path").where((F.lower(F.trim("validation_status")) == "passed") & F.col("original_path").endswith(".gd"))
    h = h.select("source_id", split_name("split").alias("split"), "record_id").where("split in ('val', 'test')")
    return h.withColumn("rn", F.row_number().over(W.partitionBy("source_id", "split").orderBy("record_id"))).where("rn <= 8").drop("rn")


@query(f"""WITH {REC} SELECT record_id, kind, original_path FROM rec WHERE kind = 'local_projects' AND {SPLIT_SQL.format(c='split')} = 'train' AND (contains(lower(original_path), 'enemy') OR contains(lower(license), 'apache'))""")
def file_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17, FLT-18. Files of one kind and split whose path or licence holds a text, whatever its case."""
    r = plain_records(spark, d, "kind", "original_path", "license", "split")
    hit = F.contains(F.lower("original_path"), F.lit("enemy")) | F.contains(F.lower("license"), F.lit("apache"))
    return r.where((F.col("kind") == "local_projects") & (split_name("split") == "train") & hit).select("record_id", "kind", "original_path")


@query("SELECT id, regexp_full_match(id, '[A-Za-z0-9_-]{8,64}') AS session_ok, regexp_full_match(id, '[a-f0-9]{12}') AS job_ok FROM sources")
def id_patterns(spark: SparkSession, d: str) -> DataFrame:
    """FLT-22, FLT-26. Whether an id may name a session or a job."""
    return table(spark, d, "sources", "id").select("id", F.col("id").rlike("^[A-Za-z0-9_-]{8,64}$").alias("session_ok"), F.col("id").rlike("^[a-f0-9]{12}$").alias("job_ok"))


@query(r"""WITH p AS (SELECT DISTINCT project_root AS path, list_filter(string_split(regexp_replace(trim(project_root), '[\\/]+', '/', 'g'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM records WHERE project_root IS NOT NULL)
SELECT path, starts_with(trim(path), '/') OR len(list_filter(range(1, len(parts) + 1), lambda i: len(list_filter(parts[1:i], lambda x: x = '..')) > len(list_filter(parts[1:i], lambda x: x <> '..')))) > 0 AS escapes, len(parts) AS depth FROM p""")
def path_escapes(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11. Whether a path that is taken from a root leaves it at any point."""
    p = table(spark, d, "records", "project_root").where("project_root is not null").distinct().select(F.col("project_root").alias("path"))
    parts = F.filter(F.split(F.regexp_replace(F.trim("path"), r"[\\/]+", "/"), "/"), lambda x: ~x.isin("", "."))
    step = F.transform(parts, lambda x: F.when(x == "..", -1).otherwise(1))
    low = F.aggregate(step, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.least(a["low"], a["at"] + x).alias("low")), lambda a: a["low"])
    return p.select("path", (F.startswith(F.trim("path"), F.lit("/")) | (low < 0)).alias("escapes"), F.size(parts).cast("long").alias("depth"))


_SHORT = """CASE WHEN length(p) <= 40 THEN p WHEN length(tail) >= 38 THEN lead || '…' || substr(name, CAST(greatest(length(name) - greatest(8, 40 - length(parent) - 3) + 1, 1) AS BIGINT)) ELSE substr(p, 1, CAST(greatest(8, 40 - length(tail) - 3) AS BIGINT)) || '…/' || tail END"""


@query(f"""WITH {REC}, a AS (SELECT record_id, original_path AS p, string_split(original_path, '/') AS s FROM rec WHERE original_path IS NOT NULL), b AS (SELECT record_id, p, s[-1] AS name, coalesce(s[-2], '') AS parent FROM a),
 c AS (SELECT *, CASE WHEN parent <> '' THEN parent || '/' || name ELSE name END AS tail, CASE WHEN parent <> '' THEN parent || '/' ELSE '' END AS lead FROM b) SELECT record_id, {_SHORT} AS shown FROM c""")
def shown_paths(spark: SparkSession, d: str) -> DataFrame:
    """FN-11. Paths as they are shown, with about forty characters."""
    return plain_records(spark, d, "original_path").where("original_path is not null").select("record_id", T.short_path(F.col("original_path"), 40).alias("shown"))


@query(r"""WITH n AS (SELECT DISTINCT source_item AS item, regexp_replace(regexp_replace(regexp_extract(source_item, '([^/\\]*)$', 1), '[^A-Za-z0-9._ -]+', '-', 'g'), '^[ .-]+|[ .-]+$', '', 'g') AS name FROM project_audits WHERE source_item IS NOT NULL)
SELECT item, coalesce(nullif(regexp_replace(substr(regexp_replace(name, '(?i)[.]zip$', ''), 1, 96), '^[ .-]+|[ .-]+$', '', 'g'), ''), 'remote-project') || '.zip' AS safe FROM n""")
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """FN-10, SRC-10. The safe file name of an archive: its last part, plain characters, 96 of the stem."""
    edge = r"^[ .-]+|[ .-]+$"
    n = table(spark, d, "project_audits", "source_item").where("source_item is not null").distinct()
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract("source_item", r"([^/\\]*)$", 1), r"[^A-Za-z0-9._ -]+", "-"), edge, "")
    stem = F.regexp_replace(F.substring(F.regexp_replace(name, "(?i)[.]zip$", ""), 1, 96), edge, "")
    return n.select(F.col("source_item").alias("item"), F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("remote-project")), F.lit(".zip")).alias("safe"))


@query("""WITH m AS (SELECT max(audited_at) AS now FROM project_audits) SELECT project_root, count(*) AS audits, count(*) FILTER (epoch(now) - epoch(audited_at) <= 30 * 86400) AS valid, CAST(floor(min(epoch(now) - epoch(audited_at)) / 86400) AS BIGINT) AS age_days FROM project_audits, m GROUP BY project_root""")
def audit_age(spark: SparkSession, d: str) -> DataFrame:
    """FN-73. Verdicts not older than thirty days, counted from the newest."""
    a = table(spark, d, "project_audits", "project_root", "audited_at")
    x = a.crossJoin(F.broadcast(a.agg(F.max("audited_at").alias("now"))))  # one row
    age = (F.unix_micros("now") - F.unix_micros("audited_at")) / 1e6
    return x.groupBy("project_root").agg(F.count("*").alias("audits"), F.count_if(age <= 30 * 86400).alias("valid"), F.floor(F.min(age) / 86400).alias("age_days"))


@query(f"""WITH {REC}, {_AUDIT}, f AS (SELECT DISTINCT unnest(parser_failed_files) AS path FROM aud), r AS (SELECT record_id, source_id, original_path, {_ROOT.format(c='project_root')} AS project, {_STATUS} AS s FROM rec),
 x AS (SELECT r.*, f.path IS NOT NULL AS failed, a.project IS NOT NULL AS checked FROM r LEFT JOIN f ON f.path = r.original_path LEFT JOIN aud a ON a.project = r.project)
SELECT source_id, count(*) FILTER (checked AND NOT failed) AS checker_passed, count(*) FILTER (checked AND failed) AS checker_failed, count(*) FILTER (NOT checked) AS unchecked, count(*) FILTER (checked AND failed AND s = 'passed') AS contradicted FROM x GROUP BY source_id""")
def checker_sets(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-08. Records against the sets that a project's checker passed, failed or never saw."""
    a = audits(spark, d, "parser_failed_files")
    f = a.select(F.explode("parser_failed_files").alias("original_path")).distinct().withColumn("failed", F.lit(True))
    r = plain_records(spark, d, "source_id", "original_path", "project_root", "validation_status").withColumn("project", canonical_path(F.col("project_root")))
    x = r.join(f, "original_path", "left").join(a.select("project", F.lit(True).alias("checked")), "project", "left")
    failed, checked = F.coalesce("failed", F.lit(False)), F.coalesce("checked", F.lit(False))
    return x.groupBy("source_id").agg(
        F.count_if(checked & ~failed).alias("checker_passed"), F.count_if(checked & failed).alias("checker_failed"), F.count_if(~checked).alias("unchecked"), F.count_if(checked & failed & (F.lower(F.trim("validation_status")) == "passed")).alias("contradicted")
    )


@query(f"""WITH {REC}, {STG}, a AS (SELECT DISTINCT sha256(text) AS sha FROM stg), r AS (SELECT source_id, lower(content_sha256) AS sha FROM rec) SELECT source_id, count(*) AS checkpoints, count(r.sha) AS with_fingerprint, count(a.sha) AS loadable, count(r.sha) - count(a.sha) AS stale FROM r LEFT JOIN a ON a.sha = r.sha GROUP BY source_id""")
def artefact_drift(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-15, SRC-21, AGG-34. Fingerprints whose artefact is there, and those whose artefact is gone."""
    a = per_text(spark, d, sha=F.sha2("text", 256)).select("sha").distinct().withColumn("there", F.lit(1))
    r = plain_records(spark, d, "source_id", "content_sha256").select("source_id", F.lower("content_sha256").alias("sha"))
    return r.join(a, "sha", "left").groupBy("source_id").agg(F.count("*").alias("checkpoints"), F.count("sha").alias("with_fingerprint"), F.count("there").alias("loadable"), (F.count("sha") - F.count("there")).alias("stale"))


@query(f"""WITH {REC}, {_AUDIT}, r AS (SELECT {_ROOT.format(c='project_root')} AS project, count(*) AS files, count(*) FILTER (ends_with(original_path, '.gd')) AS scripts FROM rec GROUP BY 1)
SELECT coalesce(r.project, a.project) AS project, coalesce(files, 0) AS files, coalesce(scripts, 0) AS scripts, a.gd_files AS audited_scripts, CASE WHEN a.project IS NULL THEN 'not-audited' WHEN r.project IS NULL THEN 'not-staged' WHEN scripts = a.gd_files THEN 'agree' ELSE 'differ' END AS state FROM (SELECT * FROM r WHERE project IS NOT NULL) r FULL JOIN aud a ON a.project = r.project""")
def project_merge(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17. Projects of the records and of the audits side by side."""
    r = plain_records(spark, d, "project_root", "original_path").withColumn("project", canonical_path(F.col("project_root"))).where("project is not null")
    r = r.groupBy("project").agg(F.count("*").alias("files"), F.count_if(F.col("original_path").endswith(".gd")).alias("scripts"))
    a = audits(spark, d, "gd_files").select(F.col("project").alias("ap"), F.col("gd_files").alias("audited_scripts"))
    state = F.when(F.col("ap").isNull(), "not-audited").when(F.col("project").isNull(), "not-staged").when(F.col("scripts") == F.col("audited_scripts"), "agree").otherwise("differ")
    j = r.join(a, F.col("project") == F.col("ap"), "full")
    return j.select(F.coalesce("project", "ap").alias("project"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("scripts", F.lit(0)).alias("scripts"), "audited_scripts", state.alias("state"))


@query(f"""WITH {REC}, {STG}, x AS (SELECT {_ROOT.format(c='project_root')} AS project, strlen(text) AS size, regexp_matches(original_path, '/addons/') AS addon, regexp_matches(original_path, '/(?:build|dist|exported|[.]godot|vendor|thirdparty|third_party|node_modules)/') AS made FROM rec JOIN stg USING (staged_path) WHERE ends_with(original_path, '.gd'))
SELECT project, count(*) AS scripts, count(*) FILTER (NOT addon AND NOT made) AS own, count(*) FILTER (NOT addon AND NOT made AND size <= 4194304) AS eligible, CAST(sum(size) FILTER (NOT addon AND NOT made) AS BIGINT) AS own_bytes FROM x GROUP BY project""")
def script_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-33, AGG-11, FLT-28. Scripts of a project, those that are its own, and those that can be validated."""
    r = plain_records(spark, d, "project_root", "original_path", "staged_path").where(F.col("original_path").endswith(".gd"))
    x = r.join(per_text(spark, d, size=F.octet_length("text")), "staged_path").withColumn("project", canonical_path(F.col("project_root")))
    own = ~F.col("original_path").rlike("/addons/") & ~F.col("original_path").rlike("/(?:build|dist|exported|[.]godot|vendor|thirdparty|third_party|node_modules)/")
    return x.groupBy("project").agg(F.count("*").alias("scripts"), F.count_if(own).alias("own"), F.count_if(own & (F.col("size") <= 4 * 1024 * 1024)).alias("eligible"), F.sum(F.when(own, F.col("size"))).cast("long").alias("own_bytes"))


@query("""WITH t AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) SELECT sha, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS documents FROM t GROUP BY sha HAVING count(DISTINCT doc_id) > 1""")
def repeated_prompts(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11. Texts that occur under several ids, and the least of those; only hashes move."""
    t = table(spark, d, "documents", "doc_id", "text").where("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    return t.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("documents")).where("documents > 1")


@query(f"""WITH {REC}, n AS (SELECT record_id, project_root, original_path, TRY_CAST(regexp_extract(original_path, '_([0-9]+)[.][a-z]+$', 1) AS BIGINT) AS step FROM rec WHERE project_root IS NOT NULL)
SELECT record_id, step, rn <= 3 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY project_root ORDER BY step DESC, original_path DESC, record_id DESC) AS rn FROM n WHERE step IS NOT NULL)""")
def step_retention(spark: SparkSession, d: str) -> DataFrame:
    """TOP-07, SRC-20. Numbered files of a folder: the three highest numbers stay, the others may go."""
    n = plain_records(spark, d, "project_root", "original_path").where("project_root is not null").withColumn("step", F.regexp_extract("original_path", "_([0-9]+)[.][a-z]+$", 1).try_cast("long")).where("step is not null")
    rn = F.row_number().over(W.partitionBy("project_root").orderBy(F.desc("step"), F.desc("original_path"), F.desc("record_id")))
    return n.select("record_id", "step", (rn <= 3).alias("kept"))


@query(f"""WITH {REC}, c AS (SELECT source_id, count(*) AS records, count(*) FILTER ({_STATUS} = 'failed') AS failed FROM rec WHERE source_id IS NOT NULL GROUP BY source_id), s AS (SELECT source_id, {_STATUS} AS st, count(*) AS n FROM rec WHERE source_id IS NOT NULL AND validation_status IS NOT NULL GROUP BY 1, 2)
SELECT source_id, records, failed, row_number() OVER (ORDER BY records DESC, source_id) AS place, (SELECT array_to_string(list(st || '=' || n ORDER BY st), ';') FROM s WHERE s.source_id = c.source_id) AS statuses FROM c""")
def validation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03, TOP-09. Sources by their number of records, with a list of statuses and counts; as many rows as
    there are sources, ranked after the aggregation."""
    r = plain_records(spark, d, "source_id", "validation_status").where("source_id is not null").withColumn("st", F.lower(F.trim("validation_status")))
    s = r.groupBy("source_id", "st").agg(F.count("*").alias("n"))
    g = s.groupBy("source_id").agg(
        F.sum("n").alias("records"),
        F.coalesce(F.sum(F.when(F.col("st") == "failed", F.col("n"))), F.lit(0)).alias("failed"),
        F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("st").isNotNull(), F.concat("st", F.lit("="), F.col("n").cast("string"))))), ";"), F.lit("")).alias("statuses"),
    )
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc("records"), "source_id")).cast("long"))


@query("""WITH w AS (SELECT project_root, i, static_warnings[i].code AS code FROM project_audits, unnest(range(1, len(static_warnings) + 1)) AS u(i)), f AS (SELECT project_root, code, min(i) AS first FROM w GROUP BY project_root, code) SELECT project_root, code, place FROM (SELECT *, row_number() OVER (PARTITION BY project_root ORDER BY first, code) AS place FROM f) WHERE place <= 3""")
def first_warnings(spark: SparkSession, d: str) -> DataFrame:
    """TOP-05. The first three different warnings of a project in the order in which they came; three are the
    feature."""
    w = table(spark, d, "project_audits", "project_root", "static_warnings").select("project_root", F.posexplode("static_warnings").alias("i", "s")).select("project_root", "i", F.col("s.code").alias("code"))
    f = w.groupBy("project_root", "code").agg(F.min("i").alias("first"))
    return f.withColumn("place", F.row_number().over(W.partitionBy("project_root").orderBy("first", "code")).cast("long")).where("place <= 3").drop("first")


@query("""WITH u AS (SELECT id, upper(title) AS title, true AS replaced FROM sources WHERE kind = 'local_projects'), k AS (SELECT id, title, false AS replaced FROM sources WHERE kind IS DISTINCT FROM 'local_projects') SELECT id, title, replaced FROM k UNION ALL SELECT * FROM u""")
def registry_replace(spark: SparkSession, d: str) -> DataFrame:
    """SET-07. A registry in which the local rows are replaced by new ones and the others stay."""
    s = table(spark, d, "sources", "id", "title", "kind")
    local = F.col("kind").eqNullSafe(F.lit("local_projects"))
    return s.where(~local).select("id", "title", F.lit(False).alias("replaced")).unionByName(s.where(local).select("id", F.upper("title").alias("title"), F.lit(True).alias("replaced")))


@query("""WITH p AS (SELECT id, list_concat(coalesce(exclude_paths, []), coalesce(include_paths, []), coalesce(exclude_paths, [])) AS l FROM sources) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS ordered, len(l) AS given FROM p""")
def ordered_paths(spark: SparkSession, d: str) -> DataFrame:
    """SET-08. Paths in the order in which they were given, each once."""
    none = F.array().cast("array<string>")
    x, i = F.coalesce("exclude_paths", none), F.coalesce("include_paths", none)
    p = table(spark, d, "sources", "id", "exclude_paths", "include_paths").select("id", F.concat(x, i, x).alias("l"))
    return p.select("id", F.array_join(F.array_distinct("l"), "|").alias("ordered"), F.size("l").cast("long").alias("given"))


_CHANGE = "record_id || ':' || coalesce(original_path, '') || ':' || coalesce(lower(content_sha256), '')"


@query(f"""WITH x AS (SELECT record_id, source_id, original_path, content_sha256, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at NULLS FIRST) AS rn, count(*) OVER (PARTITION BY record_id) AS n FROM records WHERE record_id IS NOT NULL)
SELECT source_id, {I.multiset_fingerprint_sql(_CHANGE)} AS revision, count(*) AS records, count(*) FILTER (n > 1) AS delivered_again FROM x WHERE rn = 1 GROUP BY source_id""")
def catalog_revisions(spark: SparkSession, d: str) -> DataFrame:
    """STM-10, FN-26. A revision per source that changes with any file of it, for a reader that polls."""
    n = table(spark, d, "records", "record_id").where("record_id is not null").groupBy("record_id").agg(F.count("*").alias("n"))
    r = plain_records(spark, d, "source_id", "original_path", "content_sha256").join(n, "record_id")
    line = F.concat("record_id", F.lit(":"), F.coalesce("original_path", F.lit("")), F.lit(":"), F.coalesce(F.lower("content_sha256"), F.lit("")))
    return r.withColumn("line", line).groupBy("source_id").agg(I.multiset_fingerprint(F.col("line")).alias("revision"), F.count("*").alias("records"), F.count_if(F.col("n") > 1).alias("delivered_again"))


@query(f"""WITH {REC} SELECT record_id, '{{' || concat_ws(',', '"record_id":"' || record_id || '"', '"kind":"' || kind || '"', '"split":"' || {SPLIT_SQL.format(c='split')} || '"', '"bytes":' || bytes) || '}}' AS line FROM rec""")
def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """FN-66, SNK-10. Records as JSON lines in which null fields don't appear."""
    r = plain_records(spark, d, "kind", "split", "bytes").withColumn("split", split_name("split"))
    return r.select("record_id", F.to_json(F.struct("record_id", "kind", "split", "bytes")).alias("line"))


@query(f"""WITH {REC}, x AS (SELECT DISTINCT ON (source_id) source_id, nullif(trim(source_commit), '') AS head, nullif(trim(source_ref), '') AS ref FROM records WHERE source_id IS NOT NULL ORDER BY source_id, ingested_at NULLS FIRST, record_id NULLS FIRST, source_commit NULLS FIRST, source_ref NULLS FIRST)
SELECT id, coalesce(head, ref, nullif(trim(s.ref), ''), branch) AS revision, head IS NOT NULL AS pinned, coalesce(x.ref, '') IS DISTINCT FROM coalesce(s.ref, branch, '') AS ref_differs FROM sources s LEFT JOIN x ON x.source_id = s.id""".replace("coalesce(head, ref, nullif", "coalesce(head, x.ref, nullif"))
def source_revisions(spark: SparkSession, d: str) -> DataFrame:
    """SRC-30, JOIN-04. The revision a source was taken at: its commit, else what was asked for."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = table(spark, d, "records", "source_id", "source_commit", "source_ref", "ingested_at", "record_id").where("source_id is not null")
    x = r.groupBy("source_id").agg(F.min_by(F.struct(blank("source_commit").alias("head"), blank("source_ref").alias("fref")), F.struct("ingested_at", "record_id", "source_commit", "source_ref")).alias("b")).select("source_id", "b.*")
    s = table(spark, d, "sources", "id", "ref", "branch").join(x, F.col("id") == F.col("source_id"), "left")
    return s.select(
        "id", F.coalesce("head", "fref", blank("ref"), "branch").alias("revision"), F.col("head").isNotNull().alias("pinned"), (F.coalesce("fref", F.lit("")) != F.coalesce("ref", "branch", F.lit(""))).alias("ref_differs")
    )


@query(f"""WITH {REC}, x AS (SELECT record_id, lower(content_sha256) AS sha, CASE WHEN kind = 'rst_gdscript' THEN 'v1' ELSE 'v2' END AS validator, {_STATUS} AS s FROM rec), c AS (SELECT sha, max(s) AS s FROM x WHERE validator = 'v2' AND s IN ('passed', 'failed') AND sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT s) = 1)
SELECT x.record_id, c.s AS cached, x.s IS NULL OR x.s NOT IN ('passed', 'failed') AS was_open FROM x JOIN c USING (sha)""")
def current_cache(spark: SparkSession, d: str) -> DataFrame:
    """SRC-31, JOIN-06. Verdicts of the present validator by content, where they don't contradict each other."""
    x = plain_records(spark, d, "content_sha256", "kind", "validation_status").select("record_id", F.lower("content_sha256").alias("sha"), F.when(F.col("kind") == "rst_gdscript", "v1").otherwise("v2").alias("validator"), F.lower(F.trim("validation_status")).alias("s"))
    c = x.where("validator = 'v2' and s in ('passed', 'failed') and sha is not null").groupBy("sha").agg(F.max("s").alias("cached"), F.min("s").alias("low")).where("cached = low").drop("low")
    return x.join(c, "sha").select("record_id", "cached", (F.col("s").isNull() | ~F.col("s").isin("passed", "failed")).alias("was_open"))


_RATE = "count(*) FILTER (s = 'passed') / nullif(count(*), 0)"


@query(f"""WITH {REC}, {STG}, c AS (SELECT staged_path, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS n, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) NOT IN ('', 'pass') AND NOT starts_with(trim(x), '#'))) AS real FROM stg),
 r AS (SELECT source_id, {_STATUS} AS s, n, real FROM rec JOIN c USING (staged_path) WHERE source_id IS NOT NULL), g AS (SELECT source_id, coalesce({_RATE}, 0) AS rate, coalesce(avg(CASE WHEN real = 0 THEN 1.0 ELSE 0.0 END) FILTER (s = 'passed'), 0) AS hollow, coalesce(avg(least(1.0, CASE WHEN real = 0 THEN 0 ELSE n / 3.0 END)) FILTER (s = 'passed'), 0) AS substance FROM r GROUP BY source_id),
 b AS (SELECT avg(rate) AS rate, avg(rate * (1 - hollow)) AS real FROM g)
SELECT source_id, round(g.rate, 6) AS pass_rate, round(hollow, 6) AS hollow, round(substance, 6) AS substance, CASE WHEN g.rate < 0.5 THEN 'FALSIFIED' WHEN g.rate > b.rate AND g.rate * (1 - hollow) <= b.real THEN 'FALSIFIED' WHEN hollow > 0.5 THEN 'FALSIFIED' ELSE 'VERIFIED' END AS verdict FROM g, b""")
def pass_checks(spark: SparkSession, d: str) -> DataFrame:
    """POL-11, AGG-19, FN-47. Whether a source's passes are worth something: the claimed rate of one half, its
    lead over the mean without hollow passes, and the share of those."""
    lines = lambda out: F.size(F.filter(F.split("text", "\n"), lambda x: ~F.trim(x).isin(*out) & ~F.startswith(F.trim(x), F.lit("#"))))
    c = per_text(spark, d, n=lines([""]), real=lines(["", "pass"]))
    r = plain_records(spark, d, "source_id", "staged_path", "validation_status").where("source_id is not null").join(c, "staged_path").withColumn("ok", F.coalesce(F.lower(F.trim("validation_status")) == "passed", F.lit(False)))
    worth = F.least(F.lit(1.0), F.when(F.col("real") == 0, 0.0).otherwise(F.col("n") / 3.0))
    zero = F.lit(0.0)
    g = r.groupBy("source_id").agg(
        F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("rate"), F.coalesce(F.avg(F.when(F.col("ok"), F.when(F.col("real") == 0, 1.0).otherwise(0.0))), zero).alias("hollow"), F.coalesce(F.avg(F.when(F.col("ok"), worth)), zero).alias("substance")
    )
    b = g.agg(F.avg("rate").alias("mean"), F.avg(F.col("rate") * (1 - F.col("hollow"))).alias("mean_real"))
    fake = (F.col("rate") < 0.5) | ((F.col("rate") > F.col("mean")) & (F.col("rate") * (1 - F.col("hollow")) <= F.col("mean_real"))) | (F.col("hollow") > 0.5)
    return g.crossJoin(F.broadcast(b)).select("source_id", F.round("rate", 6).alias("pass_rate"), F.round("hollow", 6).alias("hollow"), F.round("substance", 6).alias("substance"), F.when(fake, "FALSIFIED").otherwise("VERIFIED").alias("verdict"))  # one row


QUERIES, SQL = query.queries, query.sql
