"""Logs and validator output: lines, losses, phases, errors, failure kinds; every text within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import text as T
from siltworks.operators.running import running
from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.sources.tables import doc_sql, per_document, table

query = Registry()
_LOG = doc_sql("doc_kind = 'log'", "log")
_LOSS = "loss=([0-9]+[.][0-9]+) step=([0-9]+) tok/s=([0-9]+)"
_FILE = "^\\[ *([0-9]+)%\\] phase=([a-z]+) file=([0-9]+)/([0-9]+)"


def logs(spark: SparkSession, d: str, **made: Column) -> DataFrame:
    return per_document(spark, d, "doc_kind = 'log'", **made)


def _all(pat: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(pat), F.lit(group))


@query(f"""WITH {_LOG}, x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_LOSS}', 1), lambda x: CAST(x AS DOUBLE)) AS l, list_transform(regexp_extract_all(text, '{_LOSS}', 2), lambda x: CAST(x AS BIGINT)) AS s, list_transform(regexp_extract_all(text, '{_LOSS}', 3), lambda x: CAST(x AS BIGINT)) AS r FROM log)
SELECT doc_id, len(l) AS steps, round(list_sum(l) / len(l), 6) AS mean_loss, list_min(l) AS least_loss, list_max(s) AS last_step, round(list_sum(r) / len(r), 4) AS tokens_per_second FROM x WHERE len(l) > 0""")
def training_log(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24, STM-07. Losses and rates of a training log: their means, the least loss and the last step."""
    x = logs(spark, d, l=_all(_LOSS, 1).cast("array<double>"), s=_all(_LOSS, 2).cast("array<bigint>"), r=_all(_LOSS, 3).cast("array<bigint>")).where(F.size("l") > 0)
    total = lambda c, t: F.aggregate(c, F.lit(0).cast(t), lambda a, v: a + v) / F.size(c)
    return x.select(
        "doc_id",
        F.size("l").cast("long").alias("steps"),
        F.round(total("l", "double"), 6).alias("mean_loss"),
        F.array_min("l").alias("least_loss"),
        F.array_max("s").alias("last_step"),
        F.round(total("r", "bigint"), 4).alias("tokens_per_second"),
    )


@query(f"""WITH {_LOG}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM log), p AS (SELECT doc_id, regexp_extract(line, '{_FILE}', 2) AS phase, CAST(regexp_extract(line, '{_FILE}', 1) AS BIGINT) AS pct, CAST(regexp_extract(line, '{_FILE}', 3) AS BIGINT) AS done, CAST(regexp_extract(line, '{_FILE}', 4) AS BIGINT) AS total FROM l WHERE regexp_matches(line, '{_FILE}'))
SELECT doc_id, phase, count(*) AS lines, max(pct) AS percent, max(done) AS done, max(total) AS total, round(least(1.0, max(done) / max(total)), 6) AS progress FROM p GROUP BY doc_id, phase""")
def phase_progress(spark: SparkSession, d: str) -> DataFrame:
    """FN-57, STM-07. How far every phase of a log has come."""
    line = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(_FILE), F.struct(
        F.regexp_extract(x, _FILE, 2).alias("phase"), F.regexp_extract(x, _FILE, 1).cast("long").alias("pct"), F.regexp_extract(x, _FILE, 3).cast("long").alias("done"), F.regexp_extract(x, _FILE, 4).cast("long").alias("total"))))
    p = logs(spark, d, p=F.filter(line, lambda x: x.isNotNull())).select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")
    g = p.groupBy("doc_id", "phase").agg(F.count("*").alias("lines"), F.max("pct").alias("percent"), F.max("done").alias("done"), F.max("total").alias("total"))
    return g.withColumn("progress", F.round(F.least(F.lit(1.0), F.col("done") / F.col("total")), 6))


@query(f"""WITH {_LOG}, x AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\x1b\\[[0-9;?]*[A-Za-z]', '', 'g'), '\r', '', 'g'), '\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g') AS c FROM log)
SELECT doc_id, length(text) AS chars, length(c) AS kept, sha256(c) AS sha256 FROM x""")
def clean_logs(spark: SparkSession, d: str) -> DataFrame:
    """FN-07, FN-08. Logs without terminal escapes, carriage returns and runs of blank lines: length before and
    after, and the hash."""
    facts = F.transform(F.array(T.collapse_blank_lines(T.without_ansi(F.col("text")))), lambda c: F.struct(F.length(c).cast("long").alias("kept"), F.sha2(c, 256).alias("sha256")))[0]
    return logs(spark, d, chars=F.length("text").cast("long"), c=facts).select("doc_id", "chars", "c.*")


#: What tells an error line of the validator, one that only lacks its surroundings, and a hard one.
ERROR, CONTEXT = "parse error|script error|^ *(?:warning|error):|could not|parser", "could not find type|could not resolve|could not be resolved|preload|autoload|missing resource|failed to load|not found|not known|cyclic reference|timeout"
HARD = "expected |unexpected |unterminated|unclosed|invalid indentation|mixed use of tabs|parser bug|tokenizer error|could not parse"
_PATH = "((?:res://)?[A-Za-z0-9_./-]+[.](?:gd|tscn))"
_OUT = f"""{_LOG}, l AS (SELECT doc_id, ls, i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM log), unnest(range(1, len(ls) + 1)) AS u(i) WHERE regexp_matches(lower(ls[i]), '{ERROR}')),
 e AS (SELECT doc_id, i, lower(ls[i]) AS line, substr(trim(array_to_string(ls[greatest(i - 1, 1):i + 2], ' ')), 1, 700) AS block, list_distinct(list_transform(regexp_extract_all(array_to_string(ls[greatest(i - 2, 1):i + 3], chr(10)), '{_PATH}', 1), lambda x: lower(replace(x, 'res://', '')))) AS paths FROM l)"""


@query(f"""WITH {_OUT}, k AS (SELECT doc_id, i, block, CASE WHEN regexp_matches(line, '{HARD}') AND NOT regexp_matches(line, '{CONTEXT}') THEN 'hard' ELSE 'context' END AS kind, paths FROM e),
 p AS (SELECT doc_id, i, block, kind, unnest(CASE WHEN len(paths) = 0 OR kind = 'context' THEN [''] ELSE paths END) AS path FROM k) SELECT doc_id, kind, path, min_by(block, i) AS message, count(*) AS lines FROM p GROUP BY doc_id, kind, path""")
def parser_output(spark: SparkSession, d: str) -> DataFrame:
    """FN-35, WIN-06. Error lines of a log as hard or context, the former with the paths near them; per path the
    first message, which is the line with its neighbours (700 characters of them, as the report has it)."""
    low = F.transform("ls", F.lower)
    at = F.filter(F.transform(low, lambda x, i: F.when(x.rlike(ERROR), F.struct((i + 1).alias("i"), x.alias("line")))), lambda x: x.isNotNull())
    slice_ = lambda i, a, b: F.slice(F.col("ls"), F.greatest(i - a, F.lit(1)), i + b - F.greatest(i - a, F.lit(1)) + 1)
    e = F.transform(at, lambda x: F.struct(
        x["i"].alias("i"), F.when(x["line"].rlike(HARD) & ~x["line"].rlike(CONTEXT), "hard").otherwise("context").alias("kind"), F.substring(F.trim(F.array_join(slice_(x["i"], 1, 2), " ")), 1, 700).alias("block"),
        F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(slice_(x["i"], 2, 3), "\n"), F.lit(_PATH), F.lit(1)), lambda p: F.lower(F.replace(p, F.lit("res://"), F.lit(""))))).alias("paths")))
    x = logs(spark, d, ls=F.split("text", "\n")).select("doc_id", F.explode(e).alias("e")).select("doc_id", "e.*")
    path = F.explode(F.when((F.size("paths") == 0) | (F.col("kind") == "context"), F.array(F.lit(""))).otherwise(F.col("paths")))
    return x.select("doc_id", "kind", "i", "block", path.alias("path")).groupBy("doc_id", "kind", "path").agg(F.min_by("block", "i").alias("message"), F.count("*").alias("lines"))


#: Failure kinds of a process by markers, and of a check, the first that applies.
PROCESS = [
    ("parse_error", "script error:|parse error:|parser error:|syntax error|expected end of|expected an expression|expected expression|expected identifier|expected statement|expected [\"']|unexpected token"),
    ("runtime_error", "error: |invalid call|invalid get index|trying to assign value of type|cannot call method|signal '|does not exist in the current scope"),
    ("permission_error", "permission denied|access is denied|eacces|cannot open"),
    ("environment_error", "no such file or directory|could not find|unable to find"),
    ("infrastructure_error", "out of memory|oom|taskkill"),
    ("timeout", "timeout|timed out"),
]
CHECK = [("indentation", "tab character|indent"), ("unresolved_symbol", "not declared|not found in base self"), ("delimiter", "opening counterpart|closing|parenth"), ("ellipsis", "found [\"'][.][.][.][\"']")]


def _case(e: Column, kinds: list[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for k, p in reversed(kinds):
        out = F.when(e.rlike(p), k).otherwise(out)
    return F.when(e.isNotNull(), out)


def _case_sql(c: str, kinds: list[tuple[str, str]], other: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in kinds)
    return f"CASE WHEN {c} IS NULL THEN NULL {whens} ELSE '{other}' END"


@query(f"""WITH {REC}, e AS (SELECT record_id, lower(substr(validation_error, 1, 10000)) AS e, lower(validation_error) AS w FROM rec) SELECT record_id, {_case_sql('e', PROCESS, 'unknown_error')} AS process_kind, {_case_sql('w', CHECK, 'syntax_or_static_check')} AS check_kind FROM e WHERE e IS NOT NULL""")
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    """FN-37, FN-38. The kind of a failure by ordered families of markers, among the first 10,000 characters as
    the rule says, and by the ordered keywords of a check."""
    r = plain_records(spark, d, "validation_error").where("validation_error is not null")
    return r.select("record_id", _case(F.lower(F.substring("validation_error", 1, 10000)), PROCESS, "unknown_error").alias("process_kind"), _case(F.lower("validation_error"), CHECK, "syntax_or_static_check").alias("check_kind"))


@query(f"""WITH {_LOG}, f AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM log),
 e AS (SELECT doc_id, ls, list_filter(ls, lambda x: regexp_matches(x, '(?i)parse error|script error|^(?:error|warning):')) AS es FROM f)
SELECT doc_id, CASE WHEN len(es) > 0 THEN 'error' WHEN len(ls) > 0 THEN 'first-line' ELSE 'none' END AS told_by, substr(CASE WHEN len(es) > 0 THEN es[1] ELSE ls[1] END, 1, 600) AS line, len(es) AS errors FROM e""")
def first_error_line(spark: SparkSession, d: str) -> DataFrame:
    """FN-14, FLT-23. The first error line of a log, else its first line that is not blank."""
    ls = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    x = logs(spark, d, ls=ls).withColumn("es", F.filter("ls", lambda s: s.rlike("(?i)parse error|script error|^(?:error|warning):")))
    told = F.when(F.size("es") > 0, "error").when(F.size("ls") > 0, "first-line").otherwise("none")
    first = F.when(F.size("es") > 0, F.get("es", F.lit(0))).otherwise(F.get("ls", F.lit(0)))
    return x.select("doc_id", told.alias("told_by"), F.substring(first, 1, 600).alias("line"), F.size("es").cast("long").alias("errors"))


@query(f"""WITH {_LOG}, n AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'parse error|parser')) AS p, len(regexp_extract_all(lower(text), 'warning')) AS w, len(regexp_extract_all(lower(text), '(?:^|\n)passed ')) AS ok FROM log)
SELECT count(*) AS logs, count(*) FILTER (p = 0 AND w = 0) AS clean, count(*) FILTER (p > 0) AS with_parse_errors, count(*) FILTER (w > 0) AS with_warnings, CAST(sum(ok) AS BIGINT) AS passed FROM n""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, SRC-19. Logs by what is in them."""
    n = lambda p: F.regexp_count(F.lower("text"), F.lit(p))
    x = logs(spark, d, p=n("parse error|parser"), w=n("warning"), ok=n("(?:^|\n)passed "))
    return x.agg(
        F.count("*").alias("logs"), F.count_if((F.col("p") == 0) & (F.col("w") == 0)).alias("clean"), F.count_if(F.col("p") > 0).alias("with_parse_errors"), F.count_if(F.col("w") > 0).alias("with_warnings"), F.sum("ok").cast("long").alias("passed")
    )


@query("""WITH g AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events), w AS (SELECT user_id, CAST(round_even(max(s), 0) AS BIGINT) AS t FROM g WHERE s IS NOT NULL GROUP BY user_id)
SELECT user_id, t AS seconds, CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%02d:%02d', t // 60, t % 60) END AS shown FROM w""")
def longest_silence(spark: SparkSession, d: str) -> DataFrame:
    """FN-12, STM-02. The longest silence of a user, in seconds and as it is shown."""
    from siltworks.queries.events_ops import events, micros

    e = running(events(spark, d).select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], at=("last", "ts"))
    w = e.select("user_id", ((micros("ts") - micros("at")) / 1e6).alias("s")).where("s is not null").groupBy("user_id").agg(F.bround(F.max("s"), 0).cast("long").alias("seconds"))
    return w.withColumn("shown", T.duration(F.col("seconds")))


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(max(value), 4) AS peak, round(avg(value), 3) AS mean, round(sum(value) / nullif(epoch(max(ts)) - epoch(min(ts)), 0) * 86400, 3) AS per_day FROM events GROUP BY user_id""")
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25. Totals, averages, peaks and rates of a run."""
    from siltworks.queries.events_ops import events, micros

    span = (F.max(micros("ts")) - F.min(micros("ts"))) / 1e6
    return events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.max("value"), 4).alias("peak"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.sum("value") / F.nullif(span, F.lit(0)) * 86400, 3).alias("per_day")
    )


@query("""WITH j AS (SELECT user_id, min(ts) AS started, max(ts) AS touched, max_by(event_type, struct_pack(a := ts, b := event_id)) AS last, count(*) AS steps FROM events GROUP BY user_id)
SELECT user_id, started, CASE WHEN last IN ('view', 'click') THEN 'failed' ELSE 'finished' END AS state, round(least(1.0, steps / 100.0), 6) AS progress, round(greatest(0, epoch(touched) - epoch(started)), 3) AS elapsed FROM j ORDER BY started DESC, user_id LIMIT 20""")
def job_recovery(spark: SparkSession, d: str) -> DataFrame:
    """SRC-29, SRC-34, FN-72, TOP-10. The twenty jobs begun last as a restart finds them: one that was still
    running has failed. The limit is the feature."""
    from siltworks.queries.events_ops import events, micros

    j = events(spark, d).groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("touched"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("steps"))
    j = j.orderBy(F.desc("started"), "user_id").limit(20)
    return j.select(
        "user_id",
        "started",
        F.when(F.col("last").isin("view", "click"), "failed").otherwise("finished").alias("state"),
        F.round(F.least(F.lit(1.0), F.col("steps") / 100.0), 6).alias("progress"),
        F.round(F.greatest(F.lit(0), (micros("touched") - micros("started")) / 1e6), 3).alias("elapsed"),
    )


@query("""WITH t AS (SELECT doc_id, string_split(title, ' ') AS w FROM (SELECT doc_id, min(title) AS title FROM documents WHERE doc_id IS NOT NULL AND title IS NOT NULL GROUP BY doc_id)), s AS (SELECT doc_id, i, array_to_string(w[1:i], ' ') AS text FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
 d AS (SELECT doc_id, i, text, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM s) SELECT doc_id, i, substr(text, length(before) + 1) AS delta FROM d WHERE starts_with(text, before) AND length(text) > length(before)""")
def text_deltas(spark: SparkSession, d: str) -> DataFrame:
    """STM-09. Of a text that grows step by step only what is new in each, where the step before is its prefix;
    here the titles, word by word."""
    from pyspark.sql import Window as W

    t = table(spark, d, "documents", "doc_id", "title").where("doc_id is not null and title is not null").groupBy("doc_id").agg(F.min("title").alias("title")).select("doc_id", F.split("title", " ").alias("w"))
    s = t.select("doc_id", F.explode(F.transform("w", lambda x, i: F.struct((i + 1).cast("long").alias("i"), F.array_join(F.slice(F.col("w"), 1, i + 1), " ").alias("text")))).alias("s")).select("doc_id", "s.*")
    x = s.withColumn("before", F.coalesce(F.lag("text").over(W.partitionBy("doc_id").orderBy("i")), F.lit("")))
    return x.where(F.startswith("text", F.col("before")) & (F.length("text") > F.length("before"))).select("doc_id", "i", F.substr("text", F.length("before") + 1).alias("delta"))


QUERIES, SQL = query.queries, query.sql
