"""Source registry, paths, licences by markers, secrets by patterns, addresses: queries with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import masking as M
from siltworks.functions import text as T
from siltworks.functions.paths import canonical_path
from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.sources.tables import STG, per_text, table

query = Registry()

#: Hosts that files are fetched from.
HOSTS = ["github.com", "codeload.github.com", "gitlab.com", "bitbucket.org"]
#: Folder names a scan leaves out (addons unless the source allows it), in SQL and Spark.
EXCLUDED = [".git", ".godot", ".import", "node_modules", "thirdparty", "third_party", "vendor", "build", "dist", "bin", "obj", "coverage", "__pycache__", "addons"]
_EX = "[" + ", ".join(f"'{x}'" for x in EXCLUDED) + "]"


@query(f"""WITH {REC}, p AS (SELECT record_id, allow_addons, list_transform(string_split(original_path, '/')[1:-2], lambda x: lower(x)) AS parts FROM rec LEFT JOIN sources ON id = source_id WHERE original_path IS NOT NULL)
SELECT record_id, len(list_filter(parts, lambda x: x = 'addons' AND NOT coalesce(allow_addons, false) OR x <> 'addons' AND list_contains({_EX}, x) OR x LIKE '.%' AND x NOT IN ('.', '..'))) > 0 AS excluded FROM p""")
def path_excluded(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, SET-03. Whether a folder of the path is in the excluded set or hidden; addons is admitted per source."""
    s = table(spark, d, "sources", "id", "allow_addons")
    r = plain_records(spark, d, "original_path", "source_id").where("original_path is not null").join(F.broadcast(s), F.col("source_id") == F.col("id"), "left")  # sources is a fixed list
    parts = F.transform(F.split("original_path", "/"), F.lower)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    names = [x for x in EXCLUDED if x != "addons"]
    hit = F.exists(parts, lambda x: x.isin(names) | (x.startswith(".") & ~x.isin(".", "..")) | ((x == "addons") & ~F.coalesce("allow_addons", F.lit(False))))
    return r.select("record_id", hit.alias("excluded"))


@query(f"""WITH {REC}, p AS (SELECT r.record_id, regexp_replace(original_path, '^[^/]*/', '') AS path, include_paths AS inc, exclude_paths AS exc FROM rec r JOIN sources ON id = source_id WHERE original_path IS NOT NULL)
SELECT record_id, (coalesce(len(inc), 0) = 0 OR len(list_filter(inc, lambda x: path = x OR starts_with(path, x || '/'))) > 0) AND len(list_filter(coalesce(exc, []), lambda x: path = x OR starts_with(path, x || '/'))) = 0 AS included FROM p""")
def path_included(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02. Whether the path below the project lies under the source's include prefixes and under no exclude."""
    s = table(spark, d, "sources", "id", "include_paths", "exclude_paths")
    r = plain_records(spark, d, "original_path", "source_id").where("original_path is not null").join(F.broadcast(s), F.col("source_id") == F.col("id"))
    path = F.regexp_replace("original_path", "^[^/]*/", "")
    under = lambda x: (path == x) | F.startswith(path, F.concat(x, F.lit("/")))
    empty = F.array().cast("array<string>")
    inc, exc = F.coalesce("include_paths", empty), F.coalesce("exclude_paths", empty)
    return r.select("record_id", (((F.size(inc) == 0) | F.exists(inc, under)) & ~F.exists(exc, under)).alias("included"))


#: Bytes of a script that a scan reads, and that training takes.
SCAN_BYTES, TRAIN_BYTES = 256 * 1024, 4 * 1024 * 1024


@query(f"WITH {STG} SELECT staged_path, CAST(strlen(text) AS BIGINT) AS bytes, strlen(text) > 262144 AS not_scanned, strlen(text) > 4194304 AS not_trained, CAST(round_even(strlen(text) / 3.11, 0) AS BIGINT) AS estimated_tokens FROM stg")
def size_limits(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03, FN-27. Bytes, whether they pass the limits, and the token estimate (bytes / 3.11, half to even)."""
    b = F.col("bytes")
    return per_text(spark, d, bytes=F.octet_length("text").cast("long")).select(
        "staged_path", "bytes", (b > SCAN_BYTES).alias("not_scanned"), (b > TRAIN_BYTES).alias("not_trained"), F.bround(b / F.lit(3.11), 0).cast("long").alias("estimated_tokens")
    )


@query("""SELECT id, regexp_matches(id, '^[a-z0-9][a-z0-9._-]{1,63}$') AS id_ok, count(*) OVER (PARTITION BY id) = 1 AS unique_id, coalesce(kind IN ('godot_projects', 'rst_gdscript', 'local_projects', 'user_lessons'), false) AS kind_ok,
 coalesce(kind IN ('local_projects', 'user_lessons') OR regexp_matches(url, '^https://[^@ ]+[.]git$'), false) AS url_ok, NOT coalesce(regexp_matches(coalesce(ref, branch), '[ \\t\\n]'), false) AS ref_ok FROM sources""")
def registry_validity(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07. Checks of every registry row."""
    from pyspark.sql import Window as W

    s = table(spark, d, "sources")
    local = F.col("kind").isin("local_projects", "user_lessons")
    return s.select(
        "id",
        F.col("id").rlike(r"^[a-z0-9][a-z0-9._-]{1,63}$").alias("id_ok"),
        (F.count("*").over(W.partitionBy("id")) == 1).alias("unique_id"),
        F.coalesce(F.col("kind").isin("godot_projects", "rst_gdscript", "local_projects", "user_lessons"), F.lit(False)).alias("kind_ok"),
        F.coalesce(local | F.col("url").rlike(r"^https://[^@ ]+[.]git$"), F.lit(False)).alias("url_ok"),
        (~F.coalesce(F.coalesce("ref", "branch").rlike(r"[ \t\n]"), F.lit(False))).alias("ref_ok"),
    )


@query("""WITH preset AS (SELECT id, title, license, enabled FROM sources WHERE catalog_tier IS NOT NULL), mine AS (SELECT id, title AS t2, enabled AS e2 FROM sources WHERE enabled)
SELECT coalesce(p.id, m.id) AS id, coalesce(p.title, m.t2) AS title, coalesce(m.e2, false) AS enabled, m.id IS NULL AS added FROM preset p FULL JOIN mine m ON p.id = m.id""")
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13, JOIN-02, JOIN-03. Presets merged into a user's registry: what is missing is added disabled, titles are refreshed, the
    user's choice to enable stays."""
    s = table(spark, d, "sources", "id", "title", "enabled", "catalog_tier")
    preset = s.where("catalog_tier is not null").select(F.col("id").alias("pid"), F.col("title").alias("pt"))
    mine = s.where("enabled").select(F.col("id").alias("mid"), F.col("title").alias("mt"), F.col("enabled").alias("me"))
    j = preset.join(mine, F.col("pid") == F.col("mid"), "full")
    return j.select(F.coalesce("pid", "mid").alias("id"), F.coalesce("pt", "mt").alias("title"), F.coalesce("me", F.lit(False)).alias("enabled"), F.col("mid").isNull().alias("added"))


@query(f"""WITH {REC}, n AS (SELECT source_id, count(*) AS records, count(DISTINCT nullif(trim(project_root), '')) AS roots FROM rec GROUP BY source_id)
SELECT id, enabled, verified, coalesce(records, 0) AS records, coalesce(roots, 0) AS roots, CASE WHEN NOT enabled THEN 'disabled' WHEN records IS NULL THEN 'not-fetched' WHEN verified THEN 'ready' ELSE 'unverified' END AS status FROM sources LEFT JOIN n ON source_id = id""")
def source_status(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08, FLT-05, JOIN-01, JOIN-04. Registry rows with what was fetched for them."""
    n = plain_records(spark, d, "source_id", "project_root").groupBy("source_id").agg(F.count("*").alias("records"), F.countDistinct(F.nullif(F.trim("project_root"), F.lit(""))).alias("roots"))
    s = table(spark, d, "sources", "id", "enabled", "verified").join(n, F.col("source_id") == F.col("id"), "left")
    status = F.when(~F.col("enabled"), "disabled").when(F.col("records").isNull(), "not-fetched").when(F.col("verified"), "ready").otherwise("unverified")
    return s.select("id", "enabled", "verified", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("roots", F.lit(0)).alias("roots"), status.alias("status"))


@query("""SELECT DISTINCT lower(trim(expansion_tier)) AS tier, count(*) AS sources, count(*) FILTER (verified) AS verified, CAST(sum(coalesce(estimated_unique_tokens, 0)) AS BIGINT) AS tokens FROM sources GROUP BY 1""")
def tier_token_sums(spark: SparkSession, d: str) -> DataFrame:
    """FLT-20, AGG-28. Sources and estimated tokens per expansion tier."""
    s = table(spark, d, "sources", "expansion_tier", "verified", "estimated_unique_tokens")
    return s.groupBy(F.lower(F.trim("expansion_tier")).alias("tier")).agg(
        F.count("*").alias("sources"), F.count_if("verified").alias("verified"), F.sum(F.coalesce(F.col("estimated_unique_tokens"), F.lit(0))).cast("long").alias("tokens")
    )


#: A licence is told by all of its markers.
MARKERS = {"MIT": ["mit", "license"], "Apache-2.0": ["apache", "2.0"], "BSD-3-Clause": ["bsd", "3"], "BSD-2-Clause": ["bsd", "2"], "CC-BY-3.0": ["cc", "3.0"], "MPL-2.0": ["mpl", "2.0"]}
_MK = "(VALUES " + ", ".join(f"('{k}', '{m}')" for k, v in MARKERS.items() for m in v) + ") AS mk(license, marker)"


@query(f"""WITH f AS (SELECT DISTINCT repo, file_name, lower(text) AS t FROM license_files WHERE text IS NOT NULL)
SELECT license, count(*) AS files, count(DISTINCT repo) AS repos FROM (SELECT repo, file_name, license, bool_and(contains(t, marker)) AS ok FROM f, {_MK} GROUP BY repo, file_name, t, license) WHERE ok GROUP BY license""")
def license_markers(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-05. License files that hold all markers of a licence."""
    f = table(spark, d, "license_files", "repo", "file_name", "text").where("text is not null").select("repo", "file_name", F.lower("text").alias("t")).distinct()
    hit = F.filter(F.array(*[F.when(F.forall(F.array(*[F.lit(m) for m in v]), lambda m: F.contains(F.col("t"), m)), k) for k, v in MARKERS.items()]), lambda x: x.isNotNull())
    return f.select("repo", F.explode(hit).alias("license")).groupBy("license").agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"))


_KS = " UNION ALL ".join(f"SELECT '{k}' AS kind, staged_path, text, '{p.replace(chr(39), chr(39) * 2)}' AS pat FROM stg" for k, p in M.KINDS.items())


@query(f"""WITH {STG}, x AS ({_KS}) SELECT kind, count(*) AS files, CAST(sum(n) AS BIGINT) AS hits, CAST(sum(first_line) AS BIGINT) AS first_lines FROM (
 SELECT kind, len(regexp_extract_all(text, pat)) AS n, length(string_split(text, regexp_extract(text, pat))[1]) - length(replace(string_split(text, regexp_extract(text, pat))[1], chr(10), '')) + 1 AS first_line FROM x WHERE regexp_matches(text, pat)) GROUP BY kind""")
def secret_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09. Files and hits of each pattern of the plain secret scan, and the sum of their first lines.
    Texts are scanned where they are read; only hits move."""
    text = F.col("text")

    def hit(kind: str, pat: str):
        head = F.substr(text, F.lit(1), F.regexp_instr(text, F.lit(pat)) - 1)
        line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
        return F.when(text.rlike(pat), F.struct(F.lit(kind).alias("kind"), F.regexp_count(text, F.lit(pat)).alias("n"), line.alias("line")))

    found = F.filter(F.array(*[hit(k, p) for k, p in M.KINDS.items()]), lambda x: x.isNotNull())
    x = per_text(spark, d, found=found).select(F.explode("found").alias("f")).select("f.*")
    return x.groupBy("kind").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("hits"), F.sum("line").cast("long").alias("first_lines"))


@query(f"WITH {STG}, m AS (SELECT staged_path, text, {M.masked_sql('text')} AS masked FROM stg) SELECT staged_path, masked FROM m WHERE masked <> text")
def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    """FN-39. Texts that the masking of secrets changes, masked; the others don't move."""
    m = M.masked(F.col("text"))
    changed = F.transform(F.array(m), lambda x: F.when(x != F.col("text"), x))[0]
    return per_text(spark, d, masked=F.when(F.col("text").rlike(M.NEEDED), changed)).where("masked is not null")


@query("""SELECT id, CASE WHEN url IS NULL THEN 'missing' WHEN length(url) > 2048 THEN 'too-long' WHEN NOT starts_with(url, 'https://') THEN 'not-https' WHEN contains(regexp_extract(url, '^https://([^/]*)', 1), '@') THEN 'credentials'
 WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' WHEN regexp_matches(regexp_extract(url, '^https://([^/]*)', 1), ':[0-9]+$') AND NOT regexp_matches(url, '^https://[^/]*:443(/|$)') THEN 'port'
 WHEN lower(regexp_extract(url, '^https://([^/:]*)', 1)) NOT IN ('github.com', 'codeload.github.com', 'gitlab.com', 'bitbucket.org') THEN 'host' ELSE 'ok' END AS policy,
 regexp_extract(url, '^https://(?:[^/@]*@)?([^/:]*)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS shown FROM sources""")
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    """FLT-12, FN-42. Which rule an address breaks, its host, and the address as it may be logged."""
    u = F.col("url")
    host = F.regexp_extract(u, "^https://([^/]*)", 1)
    policy = (
        F.when(u.isNull(), "missing").when(F.length(u) > 2048, "too-long").when(~u.startswith("https://"), "not-https").when(F.contains(host, F.lit("@")), "credentials")
        .when(F.contains(u, F.lit("?")), "query").when(F.contains(u, F.lit("#")), "fragment")
        .when(host.rlike(":[0-9]+$") & ~u.rlike("^https://[^/]*:443(/|$)"), "port")
        .when(~F.lower(F.regexp_extract(u, "^https://([^/:]*)", 1)).isin(HOSTS), "host").otherwise("ok")
    )
    return table(spark, d, "sources", "id", "url").select("id", policy.alias("policy"), F.regexp_extract(u, "^https://(?:[^/@]*@)?([^/:]*)", 1).alias("host"), F.regexp_replace(u, "[?#].*$", "").alias("shown"))


@query("""WITH b AS (SELECT id, regexp_replace(url, '[.]git$', '') AS base, coalesce(ref, branch, 'main') AS r FROM sources WHERE url IS NOT NULL)
SELECT id, unnest([0, 1]) AS place, unnest([base || '/archive/refs/heads/' || r || '.zip', base || '/archive/' || r || '.zip']) AS candidate FROM b""")
def archive_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FN-33. The archive addresses to try for a source, in order."""
    b = table(spark, d, "sources", "id", "url", "ref", "branch").where("url is not null")
    base, r = F.regexp_replace("url", "[.]git$", ""), F.coalesce("ref", "branch", F.lit("main"))
    c = F.array(F.concat(base, F.lit("/archive/refs/heads/"), r, F.lit(".zip")), F.concat(base, F.lit("/archive/"), r, F.lit(".zip")))
    return b.select("id", F.posexplode(c).alias("place", "candidate"))


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 42), '-+$', ''), ''), 'item') AS slug FROM documents WHERE title IS NOT NULL""")
def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    """FN-06. Slugs of titles."""
    return table(spark, d, "documents", "doc_id", "title").where("title is not null").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query(r"""WITH p AS (SELECT DISTINCT project_root AS raw FROM records WHERE project_root IS NOT NULL), c AS (SELECT raw, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || trim(raw), '[\\/]+', '/', 'g'), '(/\.)+(/|$)', '/', 'g'), '/[^/]+/\.\.(/|$)', '/', 'g'), '^/+|/+$', '', 'g'), '') AS root FROM p)
SELECT c.root, count(*) AS spellings, bool_or(o.root IS NOT NULL) AS nested FROM c LEFT JOIN (SELECT DISTINCT root FROM c) o ON starts_with(c.root, o.root || '/') GROUP BY c.root""")
def project_roots(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12, JOIN-19. Project folders with the number of their spellings, and whether one lies in another: every ancestor
    of a folder is looked up by equality instead of comparing all prefixes."""
    p = table(spark, d, "records", "project_root").where("project_root is not null").distinct().select(canonical_path(F.col("project_root")).alias("root"))
    c = p.groupBy("root").agg(F.count("*").alias("spellings"))
    parts = F.split("root", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    inside = c.where(F.size(parts) > 1).select("root", up.alias("above")).join(c.select(F.col("root").alias("above")), "above").select("root").distinct().withColumn("nested", F.lit(True))
    return c.join(inside, "root", "left").select("root", "spellings", F.coalesce("nested", F.lit(False)).alias("nested"))


@query("""SELECT project_root, len(secret_hits) AS secrets, len(static_warnings) AS warnings, len(oversized_gd_files) AS oversized, CASE WHEN NOT ownership_confirmed THEN 'owner-missing' WHEN len(secret_hits) > 0 THEN 'secrets'
 WHEN validation_status NOT IN ('passed', 'passed_with_warnings') THEN 'not-validated' WHEN gd_files - len(oversized_gd_files) <= 0 THEN 'nothing-trainable' ELSE 'enabled' END AS decision FROM (SELECT DISTINCT ON (project_root) * FROM project_audits ORDER BY project_root, audited_at DESC, source_sha256 DESC)""")
def import_enablement(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, POL-07. Whether a project may be imported, by its latest audit, and why not."""
    a = table(spark, d, "project_audits", "project_root", "ownership_confirmed", "secret_hits", "static_warnings", "oversized_gd_files", "validation_status", "gd_files", "audited_at", "source_sha256")
    x = a.groupBy("project_root").agg(F.max_by(F.struct("ownership_confirmed", "secret_hits", "static_warnings", "oversized_gd_files", "validation_status", "gd_files"), F.struct("audited_at", "source_sha256")).alias("a")).select("project_root", "a.*")
    n = F.col("gd_files") - F.size("oversized_gd_files")
    dec = (
        F.when(~F.col("ownership_confirmed"), "owner-missing").when(F.size("secret_hits") > 0, "secrets")
        .when(~F.col("validation_status").isin("passed", "passed_with_warnings"), "not-validated").when(n <= 0, "nothing-trainable").otherwise("enabled")
    )
    return x.select("project_root", F.size("secret_hits").cast("long").alias("secrets"), F.size("static_warnings").cast("long").alias("warnings"), F.size("oversized_gd_files").cast("long").alias("oversized"), dec.alias("decision"))


@query("""WITH w AS (SELECT unnest(static_warnings) AS s FROM project_audits) SELECT s.code AS code, count(*) AS n, count(DISTINCT s.path) AS files FROM w GROUP BY s.code""")
def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    """Static warnings by code."""
    w = table(spark, d, "project_audits", "static_warnings").select(F.explode("static_warnings").alias("s"))
    return w.groupBy(F.col("s.code").alias("code")).agg(F.count("*").alias("n"), F.countDistinct("s.path").alias("files"))


@query("""SELECT validation_mode, validation_status, count(*) AS projects, CAST(sum(gd_files) AS BIGINT) AS gd_files, CAST(sum(gd_bytes) AS BIGINT) AS gd_bytes, CAST(sum(len(parser_failed_files)) AS BIGINT) AS parser_failed FROM project_audits GROUP BY GROUPING SETS ((validation_mode, validation_status), (validation_mode), ())""")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12. Sums over project audits by validation mode and status, with subtotals."""
    a = table(spark, d, "project_audits", "validation_mode", "validation_status", "gd_files", "gd_bytes", "parser_failed_files")
    return a.rollup("validation_mode", "validation_status").agg(
        F.count("*").alias("projects"), F.sum("gd_files").alias("gd_files"), F.sum("gd_bytes").alias("gd_bytes"), F.sum(F.size("parser_failed_files")).alias("parser_failed")
    )


QUERIES, SQL = query.queries, query.sql
