"""Corpus records, staged texts, registry and audit: queries with the SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import ident as I
from siltworks.functions import scan as S
from siltworks.functions import text as T
from siltworks.functions.paths import trimmed
from siltworks.operators import audit, dedup, splits
from siltworks.session import discard, stored
from siltworks.sources.tables import SPLIT_SQL, STG, one_per_key, per_text, split_name, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RECORD_COLUMNS = ("source_id", "group_id", "kind", "original_path", "staged_path", "split", "license", "project_root", "validation_status", "validation_error", "content_sha256", "bytes")
#: plain_records as SQL.
REC = (
    f"rec AS (SELECT record_id, {', '.join(RECORD_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at NULLS FIRST, "
    f"{', '.join(c + ' NULLS FIRST' for c in RECORD_COLUMNS)}) AS rn FROM records WHERE record_id IS NOT NULL) WHERE rn = 1)"
)


def plain_records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """record_id and `cols` of each record: of its deliveries the earliest, and of several at the same time the
    least in the order of the columns."""
    cols = cols or RECORD_COLUMNS
    return one_per_key(table(spark, d, "records", "record_id", "ingested_at", *cols), "record_id", "ingested_at", *cols).drop("ingested_at")


_N = T.normalize_code_sql("text")


@query(f"""WITH {STG}, n AS (SELECT staged_path, {_N} AS t FROM stg WHERE text IS NOT NULL)
SELECT staged_path, length(t) AS chars, CAST(strlen(t) AS BIGINT) AS bytes, length(t) - length(replace(t, chr(10), '')) AS lines, sha256(t) AS sha256 FROM n""")
def normalize_text_stats(spark: SparkSession, d: str) -> DataFrame:
    """FN-01. Length, bytes, lines and hash of every normalised staged text."""
    t = T.normalize_code(F.col("text"))
    facts = F.transform(F.array(t), lambda t: F.struct(  # the text is normalised once for all four
        F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("lines"), F.sha2(t, 256).alias("sha256"),
    ))[0]
    return per_text(spark, d, f=facts).select("staged_path", "f.*")


@query(f"""WITH {REC} SELECT record_id, coalesce(nullif(trim(group_id), ''), record_id) AS unit,
 round({I.stable_fraction_sql("coalesce(nullif(trim(group_id), ''), record_id)")}, 9) AS fraction,
 {I.hash_split_sql("coalesce(nullif(trim(group_id), ''), record_id)")} AS split FROM rec""")
def stable_split_by_group(spark: SparkSession, d: str) -> DataFrame:
    """FN-16, FN-28. Hash split of every record by its group, else by itself."""
    u = F.coalesce(trimmed(F.col("group_id")), F.col("record_id"))
    return plain_records(spark, d, "group_id").select("record_id", u.alias("unit")).withColumns({"fraction": F.round(I.stable_fraction(F.col("unit")), 9), "split": I.hash_split(F.col("unit"))})


@query(f"""WITH {REC}, u AS (SELECT DISTINCT coalesce(nullif(trim(source_id), ''), 'none') AS unit FROM rec),
 s AS (SELECT unit, {I.hash_split_sql("unit")} AS h, row_number() OVER (PARTITION BY {I.hash_split_sql("unit")} ORDER BY sha256(unit), unit) AS rn FROM u),
 k AS (SELECT count(*) n, count(*) FILTER (h = 'val') v, count(*) FILTER (h = 'test') t FROM s)
SELECT unit, CASE WHEN h = 'train' AND n >= 3 AND v = 0 AND rn = 1 THEN 'val' WHEN h = 'train' AND n >= 3 AND t = 0 AND rn = 2 THEN 'test' ELSE h END AS split FROM s, k""")
def forced_split(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08, FN-62. Hash split of sources; where a split stays empty and there are three units or more, the first unit
    in hash order goes to val, the second to test."""
    u = plain_records(spark, d, "source_id").select(F.coalesce(trimmed(F.col("source_id")), F.lit("none")).alias("unit")).distinct()
    return splits.forced(u)


_DUP = f"""WITH {REC}, {STG}, n AS (SELECT r.record_id, r.source_id, r.original_path, sha256({_N}) AS h
  FROM rec r JOIN stg s ON r.staged_path = s.staged_path WHERE s.text IS NOT NULL),
 k AS (SELECT *, row_number() OVER w AS rn, first_value(record_id) OVER w AS first_id FROM n WINDOW w AS (PARTITION BY h ORDER BY source_id NULLS FIRST, original_path NULLS FIRST, record_id))"""


@query(_DUP + " SELECT record_id, h AS content_hash, first_id, rn > 1 AS duplicate FROM k")
def exact_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01, WIN-02. The first record of every normalised text, in the order of source, path and id; the others point to it."""
    return dedup.first_wins(_hashed(spark, d), "content_hash", ["source_id", "original_path", "record_id"], "record_id").select(
        "record_id", "content_hash", "first_id", "duplicate"
    )


def _hashed(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Records with text: source_id, original_path, `cols` and the hash of the normalised text, made where
    the text is read."""
    h = per_text(spark, d, content_hash=F.sha2(T.normalize_code(F.col("text")), 256))
    return plain_records(spark, d, "source_id", "original_path", "staged_path", *cols).join(h, "staged_path")


@query(_DUP + ", c AS (SELECT h, count(*) AS size, min(first_id) AS first_id, count(DISTINCT source_id) AS sources FROM k GROUP BY h) SELECT h AS content_hash, size, first_id, sources FROM c WHERE size > 1")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once: how often, the first record, in how many sources."""
    x = dedup.first_wins(_hashed(spark, d), "content_hash", ["source_id", "original_path", "record_id"], "record_id")
    return x.groupBy("content_hash").agg(F.count("*").alias("size"), F.min("first_id").alias("first_id"), F.countDistinct("source_id").alias("sources")).where("size > 1")


@query(_DUP + f""", short AS (SELECT r.source_id AS source, r.original_path AS path, 'too-short' AS reason FROM rec r JOIN stg s ON r.staged_path = s.staged_path
   WHERE s.text IS NOT NULL AND length(regexp_replace(s.text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')) < 20),
 dup AS (SELECT k.source_id, k.original_path, 'duplicate:' || coalesce(f.source_id, '') || ':' || coalesce(f.original_path, '') FROM k JOIN rec f ON f.record_id = k.first_id WHERE rn > 1)
SELECT source, path, reason FROM short UNION ALL SELECT * FROM dup UNION ALL SELECT source, path, reason FROM skipped""")
def skip_ledger(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, SET-01. Everything left out, with the reason: too short, duplicate of, and what the scan had skipped."""
    r = plain_records(spark, d, "source_id", "original_path", "staged_path")
    s = per_text(spark, d, short=F.length(T.stripped(F.col("text"))) < 20).where("short")
    short = r.join(s, "staged_path").select(F.col("source_id").alias("source"), F.col("original_path").alias("path"), F.lit("too-short").alias("reason"))
    x = dedup.first_wins(_hashed(spark, d), "content_hash", ["source_id", "original_path", "record_id"], "record_id").where("duplicate")
    first = r.select(F.col("record_id").alias("first_id"), F.coalesce("source_id", F.lit("")).alias("fs"), F.coalesce("original_path", F.lit("")).alias("fp"))
    dup = x.join(first, "first_id").select(F.col("source_id").alias("source"), F.col("original_path").alias("path"), F.concat(F.lit("duplicate:"), "fs", F.lit(":"), "fp").alias("reason"))
    return short.unionByName(dup).unionByName(table(spark, d, "skipped", "source", "path", "reason"))


@query("""WITH r AS (SELECT DISTINCT source_id, original_path, lower(content_sha256) AS sha FROM records WHERE record_id IS NOT NULL AND content_sha256 IS NOT NULL)
SELECT source_id, original_path, substr(sha256(concat_ws(chr(0), source_id, original_path, sha)), 1, 20) AS content_id FROM r""")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """FN-17. Content-addressed id of source, path and delivered hash."""
    r = table(spark, d, "records", "record_id", "source_id", "original_path", "content_sha256").where("record_id is not null and content_sha256 is not null")
    r = r.select("source_id", "original_path", F.lower("content_sha256").alias("sha")).distinct()
    return r.select("source_id", "original_path", I.record_id(F.col("source_id"), F.col("original_path"), F.col("sha")).alias("content_id"))


@query(f"""WITH {REC}, {STG} SELECT count(*) AS records, count(*) FILTER (h IS NULL) AS without_hash, count(*) FILTER (lower(h) = sha256(text)) AS fresh,
 count(*) FILTER (h IS NOT NULL AND lower(h) <> sha256(text)) AS stale FROM (SELECT r.record_id, r.content_sha256 AS h, s.text FROM rec r JOIN stg s ON s.staged_path = r.staged_path)""")
def hash_freshness(spark: SparkSession, d: str) -> DataFrame:
    """How many delivered hashes are those of the staged text, stale or missing."""
    r = plain_records(spark, d, "staged_path", "content_sha256").withColumnRenamed("content_sha256", "h")
    x = r.join(per_text(spark, d, now=F.sha2("text", 256)), "staged_path")
    same = F.lower("h") == F.col("now")
    return x.agg(F.count("*").alias("records"), F.count_if(F.col("h").isNull()).alias("without_hash"), F.count_if(same).alias("fresh"), F.count_if(~same).alias("stale"))


# ---------------------------------------------------------------- audit


@query(f"""WITH {STG} SELECT staged_path, CAST(len(regexp_extract_all(text, '{T.TOKEN}')) AS BIGINT) AS tokens,
 CAST(len(list_distinct(list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda x: lower(x)))) AS BIGINT) AS distinct_tokens FROM stg WHERE text IS NOT NULL""")
def lexical_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """FN-05. Lexical tokens and distinct ones of every staged text."""
    x = S.lexical(table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null"), "staged_path", "text")
    return one_per_key(x, "staged_path", "sha", "tokens", "distinct_tokens").drop("sha")


_BITS = ", ".join(f"sum(w * (2 * CAST((h >> {b}) & 1 AS BIGINT) - 1)) >= 0 AS b{b}" for b in range(64))
_NUMBER = " + ".join(f"CASE WHEN b{b} THEN {1 << b}::UBIGINT ELSE 0 END" for b in range(64))
#: The duplicate-search form of every staged text, its tokens and its SimHash, as SQL.
_SIM = f"""form AS (SELECT staged_path, array_to_string(list_filter(list_transform(string_split({S.uncommented_sql("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), lambda x: x <> ''), chr(10)) AS form FROM stg),
 tok AS (SELECT staged_path, sha256(form) AS form_hash, list_transform(regexp_extract_all(form, '{T.TOKEN}'), lambda x: lower(x)) AS w FROM form),
 gram AS (SELECT staged_path, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM tok WHERE len(w) > 0),
 wt AS (SELECT staged_path, CAST('0x' || substr(sha256(g), 1, 16) AS UBIGINT) AS h, count(*) AS w FROM gram GROUP BY staged_path, g),
 votes AS (SELECT staged_path, {_BITS} FROM wt GROUP BY staged_path), sk AS (SELECT staged_path, {_NUMBER} AS h FROM votes),
 key AS (SELECT r.record_id, t.staged_path, t.form_hash, len(t.w) AS n, sk.h FROM rec r JOIN tok t USING (staged_path) LEFT JOIN sk USING (staged_path)),
 near AS (SELECT a.record_id, min(b.record_id) AS near_duplicate_of FROM key a JOIN key b ON xor(a.h >> 48, CAST(floor(log2(a.n)) AS UBIGINT)) = xor(b.h >> 48, CAST(floor(log2(b.n)) AS UBIGINT)) AND b.record_id < a.record_id AND bit_count(xor(a.h, b.h)) <= 3 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) WHERE a.n > 0 AND b.n > 0 GROUP BY a.record_id)"""


@query(f"WITH {REC}, {STG}, {_SIM} SELECT record_id, near_duplicate_of FROM near")
def simhash_near_first_match(spark: SparkSession, d: str) -> DataFrame:
    """FN-18, FN-19, JOIN-09, AGG-09. For every record the first earlier one whose SimHash lies within three bits in its bucket and whose
    token count is within a fifth. Features are hashed by SHA-256, which both engines have."""
    s = table(spark, d, "staged_files", "staged_path", "text").where(F.col("staged_path").isNotNull() & F.col("text").rlike(r"\S"))
    k = S.lexical(s, "staged_path", "text", form=True, sketch=True).where("tokens > 0")
    k = one_per_key(k, "staged_path", "sha", "tokens", "simhash")
    r = plain_records(spark, d, "staged_path").join(k, "staged_path").select("record_id", "tokens", "simhash")
    return dedup.near_first_match(r, "record_id")


_AUD = f"""{REC}, {STG}, code AS (SELECT staged_path, text, {audit.masked_sql("text")} AS c FROM stg), frag AS (SELECT staged_path, strlen(text) AS bytes, {audit.fragments_sql("text", "c")} AS found FROM code),
 src AS (SELECT id, max(license) AS declared FROM sources GROUP BY id), q AS (SELECT r.* EXCLUDE (bytes), f.bytes, f.found, coalesce(nullif(r.license, ''), nullif(src.declared, ''), 'UNKNOWN') AS lic FROM rec r LEFT JOIN frag f ON f.staged_path = r.staged_path LEFT JOIN src ON src.id = r.source_id),
 a AS (SELECT *, {audit.quality_sql("reasons")} AS quality FROM (SELECT *, {audit.reasons_sql()} AS reasons, {SPLIT_SQL.format(c="split")} AS sp FROM q))"""


def _audited(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Records with reasons, quality, sp (their split in one spelling) and the bytes of their text."""
    r = plain_records(spark, d, "source_id", "staged_path", "split", "license", "validation_status", *cols).withColumn("sp", split_name("split"))
    s = table(spark, d, "sources", "id", "license").groupBy(F.col("id").alias("source_id")).agg(F.max("license").alias("declared"))
    facts = per_text(spark, d, found=audit.fragment_reasons(F.col("text")), bytes=F.octet_length("text"))
    return audit.judged(r.join(F.broadcast(s), "source_id", "left").join(facts, "staged_path", "left"))  # sources is a fixed list


@query(f"WITH {_AUD} SELECT staged_path, array_to_string(found, ', ') AS reasons FROM frag")
def fragment_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against a text by itself: placeholders, stubs, damage, length, brackets, another language."""
    return per_text(spark, d, reasons=F.array_join(audit.fragment_reasons(F.col("text")), ", "))


@query(f"WITH {_AUD} SELECT record_id, quality, array_to_string(list_sort(reasons), ', ') AS reasons FROM a")
def quality_status(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06, FN-32, SET-06, POL-01. Quality status and sorted reasons of every record."""
    return _audited(spark, d).select("record_id", "quality", F.array_join(F.array_sort("reasons"), ", ").alias("reasons"))


@query(f"""WITH {_AUD} SELECT count(*) AS records, count(*) FILTER (quality = 'accepted') AS accepted, count(*) FILTER (quality = 'warning') AS warning, count(*) FILTER (quality = 'quarantine') AS quarantined,
 count(*) FILTER (sp = 'train') AS train, count(*) FILTER (sp = 'val') AS val, count(*) FILTER (sp = 'test') AS test, count(DISTINCT CASE WHEN sp = 'train' THEN group_id END) AS train_groups,
 CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes, round(coalesce(count(*) FILTER (lower(trim(validation_status)) = 'passed') * 1.0 / nullif(count(*) FILTER (lower(trim(validation_status)) IN ('passed', 'failed')), 0), 1.0), 6) AS parser_rate FROM a""")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04. Counters by status and split, groups, bytes and the rate at which the validator passed."""
    return audit.summary(_audited(spark, d, "group_id"))


@query(f"""WITH {_AUD} SELECT source_id, count(*) AS records, count(*) FILTER (quality = 'accepted') AS accepted, count(*) FILTER (quality = 'warning') AS warning, count(*) FILTER (quality = 'quarantine') AS quarantined FROM a GROUP BY source_id""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06. Counts by quality per source."""
    q = F.col("quality")
    return _audited(spark, d).groupBy("source_id").agg(
        F.count("*").alias("records"), F.count_if(q == "accepted").alias("accepted"), F.count_if(q == "warning").alias("warning"), F.count_if(q == "quarantine").alias("quarantined")
    )


@query(f"WITH {_AUD}, x AS (SELECT unnest(reasons) AS reason FROM a) SELECT reason, count(*) AS n FROM x GROUP BY reason")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05. Records per reason."""
    return _audited(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _final(spark: SparkSession, d: str) -> DataFrame:
    """Audited records with what the whole corpus says of them: `first_id` of their normalised text,
    `near_duplicate_of`, `leaking`, and the quality and reasons that follow."""
    base = stored(_audited(spark, d, "group_id", "original_path"), "audited")
    keys = S.lexical(table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null"), "staged_path", "text", form=True, sketch=True)
    keys = one_per_key(keys, "staged_path", "sha", "form_hash", "tokens", "simhash")
    x = stored(base.join(keys, "staged_path", "left"), "sketched")
    discard(base)
    order = [F.struct(F.col(c).isNotNull(), F.col(c)) for c in ("source_id", "original_path", "record_id")]
    by_text = x.where("form_hash is not null").groupBy("form_hash").agg(F.min_by("record_id", F.struct(*order)).alias("first_id"), (F.count_distinct("sp") > 1).alias("text_leaks"))
    by_group = x.withColumn("g", trimmed(F.col("group_id"))).where("g is not null").groupBy("g").agg((F.count_distinct("sp") > 1).alias("group_leaks")).where("group_leaks")
    near = dedup.near_first_match(x.where("tokens > 0").select("record_id", "tokens", "simhash"), "record_id")
    y = x.join(by_text, "form_hash", "left").join(by_group, trimmed(x["group_id"]) == F.col("g"), "left").join(near, "record_id", "left")
    return audit.escalated(y)


_AUD_REST = _AUD.replace(f"{REC}, {STG}, ", "")


@query(f"""WITH {REC}, {STG}, {_SIM}, {_AUD_REST}, j AS (SELECT a.*, k.form_hash FROM a LEFT JOIN key k USING (record_id)),
 ft AS (SELECT form_hash, min_by(record_id, rn) AS first_id, count(DISTINCT sp) > 1 AS text_leaks FROM (SELECT *, row_number() OVER (ORDER BY source_id NULLS FIRST, original_path NULLS FIRST, record_id) AS rn FROM j WHERE form_hash IS NOT NULL) GROUP BY form_hash),
 gl AS (SELECT trim(group_id) AS g, count(DISTINCT sp) > 1 AS group_leaks FROM j WHERE nullif(trim(group_id), '') IS NOT NULL GROUP BY 1),
 z AS (SELECT j.record_id, j.quality, j.reasons, coalesce(first_id <> j.record_id, false) AS copy, coalesce(text_leaks, false) OR coalesce(group_leaks, false) AS leak, first_id, near_duplicate_of FROM j LEFT JOIN ft USING (form_hash) LEFT JOIN gl ON gl.g = trim(j.group_id) LEFT JOIN near n ON n.record_id = j.record_id)
SELECT record_id, CASE WHEN copy OR leak THEN 'quarantine' WHEN near_duplicate_of IS NOT NULL AND quality = 'accepted' THEN 'warning' ELSE quality END AS quality,
 array_to_string(list_sort(list_distinct(list_concat(reasons, list_filter([CASE WHEN copy THEN 'normalized_exact_duplicate' END, CASE WHEN near_duplicate_of IS NOT NULL THEN 'near_duplicate' END, CASE WHEN leak THEN 'split_leakage' END], lambda x: x IS NOT NULL)))), ', ') AS reasons,
 CASE WHEN copy THEN first_id END AS duplicate_of, near_duplicate_of FROM z""")
def audit_status_final(spark: SparkSession, d: str) -> DataFrame:
    """Quality and reasons after duplicates and leaks: a later copy of a normalised text and whatever leaks
    between splits are quarantined, a near duplicate is warned of where nothing else was. Of equal texts the
    first by source, path and id stays."""
    return _final(spark, d).select("record_id", "quality", F.array_join("reasons", ", ").alias("reasons"), F.when(F.col("first_id") != F.col("record_id"), F.col("first_id")).alias("duplicate_of"), "near_duplicate_of")


@query(f"""WITH {REC}, g AS (SELECT trim(group_id) AS group_id, {SPLIT_SQL.format(c="split")} AS sp FROM rec WHERE nullif(trim(group_id), '') IS NOT NULL)
SELECT group_id, array_to_string(list_sort(list(DISTINCT sp)), ',') AS splits FROM g WHERE sp IS NOT NULL GROUP BY group_id HAVING count(DISTINCT sp) > 1""")
def group_leaks(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-10, AGG-07. Groups that lie in more than one split."""
    g = plain_records(spark, d, "group_id", "split").select(trimmed(F.col("group_id")).alias("group_id"), split_name("split").alias("sp")).where("group_id is not null and sp is not null")
    return audit.leaks(g, "group_id", "sp")


@query(_DUP.replace("SELECT r.record_id, r.source_id", f"SELECT r.record_id, {SPLIT_SQL.format(c='r.split')} AS sp, r.source_id") + " SELECT h AS content_hash, array_to_string(list_sort(list(DISTINCT sp)), ',') AS splits FROM n WHERE sp IS NOT NULL GROUP BY h HAVING count(DISTINCT sp) > 1")
def content_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Normalised texts that lie in more than one split."""
    x = _hashed(spark, d, "split").select("content_hash", split_name("split").alias("sp")).where("sp is not null")
    return audit.leaks(x, "content_hash", "sp")


_LINE = f"record_id || ':' || coalesce({SPLIT_SQL.format(c='split')}, '') || ':' || coalesce(license, '')"


@query(f"WITH {REC} SELECT {I.multiset_fingerprint_sql(_LINE)} AS fingerprint, count(*) AS records FROM rec")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """FN-26. Fingerprint of the lines record:split:license, whatever their order."""
    r = plain_records(spark, d, "split", "license").select(F.concat_ws(":", F.col("record_id"), F.coalesce(split_name("split"), F.lit("")), F.coalesce("license", F.lit(""))).alias("line"))
    return r.agg(I.multiset_fingerprint(F.col("line")).alias("fingerprint"), F.count("*").alias("records"))


@query(f"""WITH {REC} SELECT source_id, coalesce(lower(trim(validation_status)), 'unknown') AS status, count(*) AS n FROM rec GROUP BY 1, 2""")
def validation_status_by_source(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14, AGG-02, AGG-03. Validation statuses per source."""
    r = plain_records(spark, d, "source_id", "validation_status").select("source_id", F.coalesce(F.lower(F.trim("validation_status")), F.lit("unknown")).alias("status"))
    return r.groupBy("source_id", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {REC}, c AS (SELECT coalesce(nullif(trim(group_id), ''), record_id) AS unit, * FROM rec), {STG},
 n AS (SELECT c.*, sha256({_N}) AS h, strlen(text) AS size FROM c JOIN stg s ON s.staged_path = c.staged_path WHERE text IS NOT NULL),
 u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY source_id NULLS FIRST, original_path NULLS FIRST, record_id) AS rn FROM n)
SELECT source_id, {I.hash_split_sql("unit")} AS split, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM u WHERE rn = 1 GROUP BY 1, 2""")
def flagship_corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01. Unique records and bytes per source and split: normalise, drop exact duplicates, split by group."""
    h = per_text(spark, d, content_hash=F.sha2(T.normalize_code(F.col("text")), 256), size=F.octet_length("text"))
    x = plain_records(spark, d, "source_id", "group_id", "original_path", "staged_path").join(h, "staged_path")
    first = dedup.first_wins(x, "content_hash", ["source_id", "original_path", "record_id"], "record_id").where("not duplicate")
    u = F.coalesce(trimmed(F.col("group_id")), F.col("record_id"))
    return first.groupBy("source_id", I.hash_split(u).alias("split")).agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query()
def admitted_records(spark: SparkSession, d: str) -> DataFrame:
    """FLT-15, AGG-04, JOIN-10. What the final audit lets into training: records, groups and bytes by split, and what it
    held back. The rows are those of audit_status_final, which has SQL."""
    a = _final(spark, d)
    ok = F.col("quality").isin("accepted", "warning")
    g = trimmed(F.col("group_id"))
    return a.groupBy("sp").agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("held_back"), F.count_distinct(F.when(ok, g)).alias("groups"), F.sum(F.when(ok, F.col("bytes"))).cast("long").alias("bytes"), F.count_if("leaking").alias("leaking"))


@query()
def unbalanced_scripts(spark: SparkSession, d: str) -> DataFrame:
    """STR-02, STR-03. Scripts whose brackets outside strings and comments do not pair up. No SQL: it needs a state machine."""
    s = table(spark, d, "staged_files", "staged_path", "text").where(F.col("staged_path").endswith(".gd") & F.col("text").isNotNull())
    return s.where(S.unbalanced_udf("text")).select("staged_path").distinct()
