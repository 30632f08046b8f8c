"""Policies, evaluation, tasks and generators: queries with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import scan as S
from siltworks.functions.ident import record_id
from siltworks.queries import corpus as C
from siltworks.queries.corpus import REC, plain_records
from siltworks.queries.registering import Registry
from siltworks.session import spread
from siltworks.sources.tables import SPLIT_SQL, STG, one_per_key, per_text, split_name, table

query = Registry()


#: Least groups of a split, parser rate, near duplicates (at least, and as a share), training tokens.
GROUPS, PARSER_RATE, NEAR, NEAR_SHARE, TOKENS = {"train": 10, "val": 2, "test": 2}, 0.65, 25, 0.20, 500_000
_SP = SPLIT_SQL.format(c="split")
_RULES = f"""{REC}, {STG}, {C._SIM}, n AS (SELECT sha256({C._N}) AS h, {_SP} AS sp FROM rec JOIN stg USING (staged_path)), p AS (SELECT *, {_SP} AS sp, lower(trim(validation_status)) AS v FROM rec),
 a AS (SELECT count(*) AS n, count(DISTINCT CASE WHEN sp = 'train' THEN group_id END) AS train, count(DISTINCT CASE WHEN sp = 'val' THEN group_id END) AS val, count(DISTINCT CASE WHEN sp = 'test' THEN group_id END) AS test,
  coalesce(count(*) FILTER (v = 'passed') / nullif(count(*) FILTER (v IN ('passed', 'failed')), 0), 1) AS rate FROM p),
 gl AS (SELECT count(*) AS n FROM (SELECT 1 FROM p WHERE nullif(trim(group_id), '') IS NOT NULL AND sp IS NOT NULL GROUP BY trim(group_id) HAVING count(DISTINCT sp) > 1)), cl AS (SELECT count(*) AS n FROM (SELECT 1 FROM n WHERE sp IS NOT NULL GROUP BY h HAVING count(DISTINCT sp) > 1)),
 nd AS (SELECT count(*) AS n FROM near), tk AS (SELECT {", ".join(f"coalesce(sum(strlen(text) + strlen(original_path) + 13) FILTER (sp = '{k}'), 0) AS {k}" for k in ("train", "val", "test"))} FROM p JOIN stg USING (staged_path) WHERE original_path IS NOT NULL),
 fr AS (SELECT coalesce((SELECT max(staged_at) FROM records) > (SELECT max(audited_at) FROM project_audits) + INTERVAL 1 MILLISECOND, false) AS stale),
 r AS (SELECT unnest(['no-records', 'few-groups', 'group-leaks', 'content-leaks', 'parser-rate', 'near-duplicates', 'train-tokens', 'val-tokens', 'test-tokens', 'stale-audit']) AS rule, unnest(['blocker', 'blocker', 'blocker', 'warning', 'warning', 'warning', 'blocker', 'blocker', 'warning', 'blocker']) AS kind,
  unnest([a.n = 0, a.train < 10 OR a.val < 2 OR a.test < 2, gl.n > 0, cl.n > 0 AND gl.n = 0, rate < 0.65, nd.n > greatest(25, 0.20 * a.n), tk.train < 500000, tk.val <= 0, tk.test <= 0, stale]) AS broken FROM a, gl, cl, nd, tk, fr)"""


@query(f"WITH {_RULES} SELECT rule, kind, broken FROM r")
def preflight_rules(spark: SparkSession, d: str) -> DataFrame:
    """POL-08, FRS-01. The rules that a training run must meet, each with its kind and whether it is broken: groups and
    tokens of the splits, leaks, parser rate, near duplicates and the age of the audit. Every figure is an
    aggregate of one row."""
    r = plain_records(spark, d, "group_id", "split", "validation_status", "staged_path", "original_path").withColumns({"sp": split_name("split"), "v": F.lower(F.trim("validation_status"))})
    c = F.col
    groups = [F.countDistinct(F.when(c("sp") == k, c("group_id"))).alias(k) for k in GROUPS]
    rate = F.coalesce(F.count_if(c("v") == "passed") / F.nullif(F.count_if(c("v").isin("passed", "failed")), F.lit(0)), F.lit(1.0))
    a = r.agg(F.count("*").alias("n"), *groups, rate.alias("rate"))
    t = r.where("original_path is not null").join(per_text(spark, d, bytes=F.octet_length("text")), "staged_path")
    tokens = t.agg(*[F.coalesce(F.sum(F.when(c("sp") == k, c("bytes") + F.octet_length("original_path") + 13)), F.lit(0)).alias(f"t_{k}") for k in GROUPS])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    newest = table(spark, d, "records", "staged_at").agg(F.max("staged_at").alias("staged"))
    audited = table(spark, d, "project_audits", "audited_at").agg(F.max("audited_at").alias("audited"))
    x = a
    for one in (tokens, count(C.group_leaks(spark, d), "gl"), count(C.content_leaks(spark, d), "cl"), count(C.simhash_near_first_match(spark, d), "nd"), newest, audited):
        x = x.crossJoin(F.broadcast(one))  # one row each
    few = (c("train") < GROUPS["train"]) | (c("val") < GROUPS["val"]) | (c("test") < GROUPS["test"])
    stale = F.coalesce(c("staged") > c("audited") + F.expr("INTERVAL '0.001' SECOND"), F.lit(False))
    rules = [
        ("no-records", "blocker", c("n") == 0), ("few-groups", "blocker", few), ("group-leaks", "blocker", c("gl") > 0), ("content-leaks", "warning", (c("cl") > 0) & (c("gl") == 0)), ("parser-rate", "warning", c("rate") < PARSER_RATE),
        ("near-duplicates", "warning", c("nd") > F.greatest(F.lit(float(NEAR)), NEAR_SHARE * c("n"))), ("train-tokens", "blocker", c("t_train") < TOKENS), ("val-tokens", "blocker", c("t_val") <= 0), ("test-tokens", "warning", c("t_test") <= 0), ("stale-audit", "blocker", stale),
    ]
    return x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"), b.alias("broken")) for n, k, b in rules])).alias("r")).select("r.*")


@query(f"WITH {_RULES} SELECT count(*) FILTER (broken AND kind = 'blocker') AS blockers, count(*) FILTER (broken AND kind = 'warning') AS warnings, CASE WHEN count(*) FILTER (broken AND kind = 'blocker') > 0 THEN 'red' WHEN count(*) FILTER (broken AND kind = 'warning') > 0 THEN 'yellow' ELSE 'green' END AS light FROM r")
def preflight_lights(spark: SparkSession, d: str) -> DataFrame:
    """AGG-32, POL-08. Blockers, warnings and the light they give."""
    n = lambda k: F.count_if(F.col("broken") & (F.col("kind") == k))
    x = preflight_rules(spark, d).agg(n("blocker").alias("blockers"), n("warning").alias("warnings"))
    return x.withColumn("light", F.when(F.col("blockers") > 0, "red").when(F.col("warnings") > 0, "yellow").otherwise("green"))


@query("""WITH s AS (SELECT source_id, max(staged_at) AS newest FROM records GROUP BY source_id), a AS (SELECT max(audited_at) AS done FROM project_audits)
SELECT source_id, newest > done + INTERVAL 1 MILLISECOND AS stale FROM s, a""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-18, FRS-01. Whether a source's newest staged file is newer than the newest audit."""
    s = table(spark, d, "records", "source_id", "staged_at").groupBy("source_id").agg(F.max("staged_at").alias("newest"))
    a = table(spark, d, "project_audits", "audited_at").agg(F.max("audited_at").alias("done"))
    return s.crossJoin(F.broadcast(a)).select("source_id", (F.col("newest") > F.col("done") + F.expr("INTERVAL '0.001' SECOND")).alias("stale"))  # one row


@query(f"""WITH {REC}, t AS (SELECT staged_path, 'training' AS kind FROM rec WHERE staged_path IS NOT NULL), f AS (SELECT DISTINCT staged_path FROM staged_files WHERE staged_path IS NOT NULL)
SELECT kind, status, count(*) AS n FROM (SELECT t.kind, CASE WHEN f.staged_path IS NULL THEN 'missing' ELSE 'ready' END AS status FROM t LEFT JOIN f USING (staged_path)
 UNION ALL SELECT 'raw', 'unlisted' FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.staged_path = f.staged_path) UNION ALL SELECT 'skipped', coalesce(split_part(reason, ':', 1), 'unknown') FROM skipped) GROUP BY kind, status""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11, JOIN-12, AGG-22, SET-02, SET-04. Listed, missing, unlisted and skipped files, counted by kind and status."""
    t = plain_records(spark, d, "staged_path").where("staged_path is not null").select("staged_path")
    f = table(spark, d, "staged_files", "staged_path").where("staged_path is not null").distinct()
    a = t.join(f.withColumn("there", F.lit(1)), "staged_path", "left").select(F.lit("training").alias("kind"), F.when(F.col("there").isNull(), "missing").otherwise("ready").alias("status"))
    b = f.join(t, "staged_path", "left_anti").select(F.lit("raw").alias("kind"), F.lit("unlisted").alias("status"))
    c = table(spark, d, "skipped", "reason").select(F.lit("skipped").alias("kind"), F.coalesce(F.substring_index("reason", ":", 1), F.lit("unknown")).alias("status"))
    return a.unionByName(b).unionByName(c).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {REC}, x AS (SELECT kind AS tier, lower(trim(validation_status)) AS s FROM rec) SELECT tier, count(*) AS cases, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'failed') AS failed, round(count(*) FILTER (s = 'passed') / count(*), 6) AS rate FROM x GROUP BY ROLLUP (tier)""")
def benchmark_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, AGG-36. Cases, passes and rates per tier and overall."""
    x = plain_records(spark, d, "kind", "validation_status").select(F.col("kind").alias("tier"), F.lower(F.trim("validation_status")).alias("s"))
    p = F.count_if(F.col("s") == "passed")
    return x.rollup("tier").agg(F.count("*").alias("cases"), p.alias("passed"), F.count_if(F.col("s") == "failed").alias("failed"), F.round(p / F.count("*"), 6).alias("rate"))


@query(f"""WITH {REC}, c AS (SELECT source_id, lower(trim(validation_status)) AS s FROM rec), v AS (SELECT source_id, CASE WHEN count(*) FILTER (s = 'failed') > 0.1 * count(*) THEN 'FALSIFIED' WHEN count(*) FILTER (s = 'passed') = 0 THEN 'UNRESOLVED' ELSE 'VERIFIED' END AS verdict FROM c GROUP BY source_id)
SELECT count(*) AS checks, count(*) FILTER (verdict = 'FALSIFIED') AS falsified, CASE WHEN bool_or(verdict = 'FALSIFIED') THEN 'FALSIFIED' WHEN bool_or(verdict = 'UNRESOLVED') AND NOT bool_or(verdict = 'VERIFIED') THEN 'UNRESOLVED' ELSE 'VERIFIED' END AS overall FROM v""")
def overall_verdict(spark: SparkSession, d: str) -> DataFrame:
    """AGG-31. A verdict per source and the one over all."""
    c = plain_records(spark, d, "source_id", "validation_status").select("source_id", F.lower(F.trim("validation_status")).alias("s"))
    g = c.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("s") == "failed").alias("f"), F.count_if(F.col("s") == "passed").alias("p"))
    v = g.select(F.when(F.col("f") > F.col("n") * 0.1, "FALSIFIED").when(F.col("p") == 0, "UNRESOLVED").otherwise("VERIFIED").alias("v"))
    has = lambda x: F.bool_or(F.col("v") == x)
    return v.agg(F.count("*").alias("checks"), F.count_if(F.col("v") == "FALSIFIED").alias("falsified"), F.when(has("FALSIFIED"), "FALSIFIED").when(has("UNRESOLVED") & ~has("VERIFIED"), "UNRESOLVED").otherwise("VERIFIED").alias("overall"))


@query(f"""WITH {REC} SELECT record_id, CASE WHEN validation_error IS NULL THEN 'none' WHEN regexp_matches(lower(validation_error), 'timeout') THEN 'timeout' WHEN regexp_matches(lower(validation_error), 'missing resource|autoload|not known|could not be resolved') THEN 'context' WHEN regexp_matches(lower(validation_error), 'unexpected|expected|parse|syntax|unterminated|parser') THEN 'syntax' ELSE 'other' END AS class,
 coalesce(TRY_CAST(regexp_extract(validation_error, '(?:line |at |:)([0-9]+)', 1) AS BIGINT), -1) AS line FROM rec""")
def parser_error_classes(spark: SparkSession, d: str) -> DataFrame:
    """FN-35. The class of a validator's message and the line it names."""
    r = plain_records(spark, d, "validation_error").withColumnRenamed("validation_error", "e")
    x = F.lower("e")
    k = (
        F.when(F.col("e").isNull(), "none").when(x.rlike("timeout"), "timeout").when(x.rlike("missing resource|autoload|not known|could not be resolved"), "context")
        .when(x.rlike("unexpected|expected|parse|syntax|unterminated|parser"), "syntax").otherwise("other")
    )
    return r.select("record_id", k.alias("class"), F.coalesce(F.regexp_extract("e", "(?:line |at |:)([0-9]+)", 1).try_cast("long"), F.lit(-1)).alias("line"))


@query()
def instruction_tasks(spark: SparkSession, d: str) -> DataFrame:
    """FN-43, FN-44, FN-45, WIN-13, UDF-06. Completion and repair tasks of function blocks, two per file at most, the cap being the feature. No
    SQL: blocks are told by indentation; tested against fixtures."""
    r = plain_records(spark, d, "split", "staged_path", "original_path").select(split_name("split").alias("split"), "staged_path", "original_path").where("split is not null")
    s = table(spark, d, "staged_files", "staged_path", "text").where(F.col("staged_path").endswith(".gd") & F.col("text").isNotNull())

    def tasks(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["staged_path"], pdf["text"]):
                made = []
                for k, code in S.function_blocks(text.replace("\r\n", "\n")):
                    lines = code.split("\n")
                    if len(lines) >= 4:
                        cut = max(2, min(len(lines) - 1, len(lines) // 2))
                        made.append((path, k, "completion", "\n".join(lines[:cut]), "\n".join(lines[cut:])))
                    broken = code.replace(":\n", "\n", 1)
                    if broken != code:
                        made.append((path, k, "repair", broken, code))
                rows += [(path, S._sha(text), made[:2])]
            yield pd.DataFrame(rows, columns=["staged_path", "sha", "made"])

    one = "struct<staged_path:string,block:int,task_type:string,input:string,output:string>"
    t = one_per_key(spread(s).mapInPandas(tasks, f"staged_path string, sha string, made array<{one}>"), "staged_path", "sha", "made")
    t = t.select(F.explode("made").alias("m")).select("m.*")
    j = t.join(r, "staged_path")
    return j.select(record_id(F.col("split"), F.col("task_type"), F.col("input")).alias("task_id"), "split", "task_type", "original_path", "block", "input", "output")


@query()
def documentation_snippets(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, FN-20, WIN-14. Script blocks of documentation pages, numbered per page. No SQL: indentation decides."""
    t = table(spark, d, "documents", "doc_id", "text").where(F.col("text").contains("gdscript")).groupBy("doc_id").agg(F.min("text").alias("text"))

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(k, n, c) for k, x in zip(pdf["doc_id"], pdf["text"]) for n, c in S.rst_snippets(x.replace("\r\n", "\n"))], columns=["doc_id", "snippet", "code"])

    return spread(t).mapInPandas(cut, "doc_id long, snippet int, code string")


@query("""WITH t AS (SELECT unnest(['signals', 'nodes', 'scenes', 'physics', 'input', 'ui', 'tween', 'save']) AS topic), n AS (SELECT unnest(range(1, 25)) AS lesson)
SELECT topic, lesson, 'lessons/' || topic || '/' || lpad(CAST(lesson AS VARCHAR), 2, '0') || '.gd' AS path, CASE WHEN lesson <= 18 THEN 'train' WHEN lesson <= 21 THEN 'val' ELSE 'test' END AS split FROM t, n""")
def curriculum_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-24, FN-29, UDF-05. Generated rows: eight topics of twenty-four lessons with their split."""
    t = spark.createDataFrame([(x,) for x in ("signals", "nodes", "scenes", "physics", "input", "ui", "tween", "save")], "topic string")
    x = t.withColumn("lesson", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))))
    split = F.when(F.col("lesson") <= 18, "train").when(F.col("lesson") <= 21, "val").otherwise("test")
    return x.select("topic", "lesson", F.format_string("lessons/%s/%02d.gd", "topic", "lesson").alias("path"), split.alias("split"))


@query("""WITH p AS (SELECT profile, max_seq_len, batch_size FROM train_profiles), x AS (SELECT profile, b AS batch, a AS accumulate, max_seq_len * b * a AS tokens FROM p, (SELECT unnest([1, 2, 4]) AS b), (SELECT unnest([1, 2]) AS a))
SELECT profile, max(tokens) FILTER (tokens <= 8192) AS largest_safe, coalesce(min(tokens) FILTER (tokens > 8192), -1) AS first_unsafe, max_by(batch, struct_pack(x := tokens, y := batch)) FILTER (tokens <= 8192) AS best_batch FROM x GROUP BY profile""")
def probe_matrix(spark: SparkSession, d: str) -> DataFrame:
    """SRC-25, FLT-21, AGG-26, TOP-03. A configuration matrix per profile with the largest safe and the first unsafe entry."""
    p = table(spark, d, "train_profiles", "profile", "max_seq_len")
    x = p.select("profile", "max_seq_len", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("batch")).select("profile", "max_seq_len", "batch", F.explode(F.array(F.lit(1), F.lit(2))).alias("accumulate"))
    x = x.withColumn("tokens", F.col("max_seq_len") * F.col("batch") * F.col("accumulate"))
    safe = F.col("tokens") <= 8192
    return x.groupBy("profile").agg(
        F.max(F.when(safe, F.col("tokens"))).alias("largest_safe"), F.coalesce(F.min(F.when(~safe, F.col("tokens"))), F.lit(-1)).alias("first_unsafe"), F.max_by("batch", F.when(safe, F.struct("tokens", "batch"))).alias("best_batch")
    )


@query(f"""WITH {STG}, l AS (SELECT staged_path, unnest(string_split(text, chr(10))) AS line FROM stg WHERE text IS NOT NULL)
SELECT staged_path, count(*) AS lines, count(*) FILTER (trim(line) = '') AS blank, count(*) FILTER (starts_with(ltrim(line), '#')) AS comments, max(length(line)) AS longest, bool_or(starts_with(line, chr(9))) AND bool_or(starts_with(line, '    ')) AS mixed_indent, count(*) FILTER (regexp_matches(line, '^(<<<<<<<|>>>>>>>)')) AS merge_marks FROM l GROUP BY staged_path""")
def static_line_checks(spark: SparkSession, d: str) -> DataFrame:
    """FN-34. Line statistics and line-wise warnings of every text, computed within the row: nothing is exploded."""
    n = lambda l, f: F.size(F.filter(l, f)).cast("long")  # noqa: E731, E741
    facts = F.transform(F.array(F.split("text", "\n")), lambda l: F.struct(  # noqa: E741
        F.size(l).cast("long").alias("lines"), n(l, lambda s: F.trim(s) == "").alias("blank"), n(l, lambda s: F.ltrim(s).startswith("#")).alias("comments"),
        F.array_max(F.transform(l, F.length)).cast("long").alias("longest"), (F.exists(l, lambda s: s.startswith("\t")) & F.exists(l, lambda s: s.startswith("    "))).alias("mixed_indent"),
        n(l, lambda s: s.rlike("^(<<<<<<<|>>>>>>>)")).alias("merge_marks"),
    ))[0]
    return per_text(spark, d, f=facts).select("staged_path", "f.*")


@query()
def instruction_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15. Tasks by split and type with a fingerprint that doesn't depend on their order. No SQL: the tasks have none."""
    from siltworks.functions.ident import multiset_fingerprint

    return instruction_tasks(spark, d).groupBy("split", "task_type").agg(F.count("*").alias("tasks"), multiset_fingerprint(F.col("task_id")).alias("fingerprint"))


@query(f"""WITH {REC}, p AS (SELECT record_id, kind, lower(regexp_replace(original_path, '#.*$', '')) AS path, lower(regexp_extract(rtrim(trim(project_root), '/'), '([^/]+)$', 1)) AS folder FROM rec WHERE original_path IS NOT NULL)
SELECT record_id, CASE WHEN kind = 'user_lessons' THEN path WHEN coalesce(folder, '') <> '' AND starts_with(path, folder || '/') THEN substr(path, length(folder) + 2) END AS script FROM p""")
def script_paths(spark: SparkSession, d: str) -> DataFrame:
    """FN-60. The path of a record's script below its project, in lower case; null where it lies elsewhere."""
    path, folder = F.lower(F.regexp_replace("original_path", "#.*$", "")), F.lower(F.regexp_extract(F.rtrim(F.trim("project_root"), F.lit("/")), "([^/]+)$", 1))
    p = plain_records(spark, d, "kind", "original_path", "project_root").where("original_path is not null").select("record_id", "kind", path.alias("path"), folder.alias("folder"))
    inside = (F.coalesce("folder", F.lit("")) != "") & F.startswith("path", F.concat("folder", F.lit("/")))
    return p.select("record_id", F.when(F.col("kind") == "user_lessons", F.col("path")).when(inside, F.substr("path", F.length("folder") + 2)).alias("script"))


QUERIES, SQL = query.queries, query.sql
