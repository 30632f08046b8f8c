"""Generated, minified or vendored source files.

Declared paths come from repository attribute files (linguist-generated, linguist-vendored), read with
the precedence of their format: a pattern counts for its own folder, a deeper file beats a higher one, a
later line an earlier one. What a project's files say goes before all else: an attribute that is unset
there takes back that mark, whether a path, a text or a mined pattern gave it. Below that lie the patterns
of DEFAULT_ATTRIBUTES, in the same format and through the same globs, and, for projects without attribute
files, patterns mined from this data: folder names and compound endings under which nearly all files of
several projects are marked. Texts are judged by their comments and by their
make-up: in the opening comment any wording of a mark counts, in comments further down only one that
speaks of the file, since there most comments speak of the next line. Everything is built-in column
expressions over the scan; only verdicts are shuffled.

Defined cases: null or blank texts can still be told by their path; a null path by the text alone; code
under addons/ is the source's own where sources.allow_addons is true, else third-party; ties of repeated
rows are harmless, since a file is a case if any of its texts is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import canonical_path
from siltworks.session import discard, spread, stored
from siltworks.sources.tables import records, table

#: The patterns of general use, as an attribute file at the root of every project.
DEFAULT_ATTRIBUTES = """
**/thirdparty/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/3rdparty/** linguist-vendored
**/vendor/** linguist-vendored
**/vendored/** linguist-vendored
**/vendors/** linguist-vendored
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/external/** linguist-vendored
**/externals/** linguist-vendored
**/extern/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/site-packages/** linguist-vendored
**/Pods/** linguist-vendored
**/build/** linguist-generated
**/dist/** linguist-generated
**/generated/** linguist-generated
**/__generated__/** linguist-generated
**/gen/** linguist-generated
**/.godot/** linguist-generated
**/.import/** linguist-generated
**/.mono/** linguist-generated
**/exported/** linguist-generated
**/out/** linguist-generated
**/bin/** linguist-generated
**/obj/** linguist-generated
**/target/** linguist-generated
*.min.js linguist-generated
*.min.css linguist-generated
*.min.gd linguist-generated
*.min.json linguist-generated
*.gen.* linguist-generated
*.generated.* linguist-generated
*.g.* linguist-generated
*.pb.* linguist-generated
*.designer.* linguist-generated
*.bundle.* linguist-generated
*.chunk.* linguist-generated
*_pb.* linguist-generated
*_pb2.* linguist-generated
*_gen.* linguist-generated
*_generated.* linguist-generated
*_autogen.* linguist-generated
*_pb_[0-9]*.* linguist-generated
*_pb2_[0-9]*.* linguist-generated
*_gen_[0-9]*.* linguist-generated
*_generated_[0-9]*.* linguist-generated
*_autogen_[0-9]*.* linguist-generated
"""
#: Files of a project whose paths are matched in one task; attribute files up to which their list is broadcast.
BLOCK_FILES, BROADCAST_FILES = 50_000, 100_000
#: A mined pattern needs so many marked files, in so many projects, and this share of all its files.
MINED_FILES, MINED_PROJECTS, MINED_SHARE = 5, 3, 0.9
#: From this length on a line with so few blanks is not written by hand; share of the text it must make up.
DENSE_LINE, DENSE_BLANKS, DENSE_SHARE = 300, 0.12, 0.5
#: A table saved as code: rows at least, and share of the lines.
TABLE_ROWS, TABLE_SHARE = 20, 0.8

_GENERATED = (
    r"(?im)@generated\b|<auto-?generated|\bautogenerated\b|\bauto-generated\b|\bautomatically[ -](?:generated|written|created|built|produced|exported)\b"
    r"|\b(?:created|written|generated|built|exported) automatically\b|\b(?:file|code|script|class|module|table|list|data)s? (?:was |is |are |has been |have been )?generated (?:by|from|with|using) \S"
    r"|^\W*generated (?:by|from|with|using) \S|\bproduced by \S+[^\n]*\bdo not (?:edit|modify|change|touch)\b|\bchanges (?:here )?(?:will be|are|get) (?:lost|overwritten)\b"
    r"|\b(?:do not|don't|never) (?:edit|modify|change|touch)(?: (?:by hand|manually|directly|it|this file|this script|this))*\W*$|\bmachine[- ](?:generated|written|made)\b|\bedits? (?:will be|are|get) (?:lost|overwritten)\b"
    r"|\b(?:automatisch|maschinell)\b[^\n]*\b(?:erzeugt|erstellt|generiert)\b|\bwurde von \S+ (?:erzeugt|erstellt|generiert)\b|\bnicht (?:von hand|manuell) (?:bearbeiten|ändern)"
    r"|\bgénéré(?:e)? (?:automatiquement|par)\b|\bne pas (?:modifier|éditer)\b|\b(?:generado|creado) (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|\bgerado (?:automaticamente|por)\b|\bgenerato (?:automaticamente|da)\b"
)
_VENDORED = (
    r"(?m)(?i:\bcopied (?:unchanged |verbatim |unmodified |as is |over |in )*from\b|\b(?:bundled|vendored|unmodified|verbatim) copy\b|\bvendored (?:from|in)\b|\bupstream ?: ?(?:https?://|git@)|\bthird[- ]party (?:code|file|library|copy|module|script)\b"
    r"|\bimported (?:unchanged )?from https?://|\btaken (?:unchanged |verbatim )?from https?://)"
    r"|\A\W*(?!Godot\b|Version\b|Tested\b|Requires\b|Engine\b)[A-Z]\w*,? (?i:version |v)?\d+\.\d+\.\d+\b"
)
#: The comments of a text, and the long strings, in which comment signs are no comments.
_COMMENTS = (
    r"(?m)^[ \t]*+/\*(?s:.*?)\*/[^\n]*+|^[ \t]*+<!--(?s:.*?)-->[^\n]*+|^[ \t]*+(?:#|//|;|/\*|\*|<!--)[^\n]*+"
    r"|\"\"\"(?s:.*?)\"\"\"|'{3}(?s:.*?)'{3}|(?<=[=(+,:]\s{0,2})`[^`]*+`"
)
_COMMENT = r"^[ \t]*(?:#|//|;|/\*|\*|<!--)"
_FILE = r"(?:(?:the|this) (?:whole )?)?(?:file|code|script|class|module|source)s?"
_THIS = r"(?:this (?:whole )?(?:file|code|script|class|module|source|table|list|data)|these (?:files|scripts|classes|tables))"
_IS = r"(?: (?:was|is|are|has been|have been))?"
_MADE = r"(?:generated|written|created|built|produced|exported)"
#: A tool by name, and not 'by the spawner when a level starts'.
_MAKER = r"(?:by|from|with|using) (?!(?:the|a|an|its|our|each|every|this|that|hand)\b)\S(?![^\n]*\b(?:run-?time|start-?up|when|whenever|once|each|every|per|while|during)\b)"
_GENERATED_BELOW = (
    rf"(?im)^\W*@generated\b|<auto-?generated\b|^\W*(?:{_FILE}{_IS} )?(?:auto-?|automatically |machine[- ])?generated {_MAKER}|^\W*(?:{_FILE}{_IS} )?{_MADE} automatically {_MAKER}"
    rf"|^\W*(?:{_FILE}{_IS} )?automatically {_MADE} {_MAKER}|^\W*(?:{_FILE}{_IS} )?automatically {_MADE}\b[^\n]*\b(?:edit|change|modify)\b[^\n]*\binstead\b"
    rf"|^\W*(?:{_FILE}{_IS} )?(?:auto-?|automatically |machine[- ])generated\b(?:\W*$|\s*[-.,;:!(][^\n]*\b(?:do not|don't|never) (?:edit|modify|change|touch)\b)"
    rf"|\b{_THIS}{_IS} (?:(?:auto-?|automatically |machine[- ])(?:{_MADE})\b|(?:{_MADE}) automatically\b|generated (?:by|from|with|using) \S)"
    rf"|\b{_MADE} by \S+[^\n]*\b(?:do not|don't|never) (?:edit|modify|change|touch)(?: (?:by hand|manually|directly|it|this file|this script|this))*\W*$"
    rf"|^\W*(?:please )?(?:do not|don't|never) (?:edit|modify|change|touch) this (?:file|script)(?: (?:by hand|manually|directly))?\W*$"
    r"|\bdiese[rs]? (?:datei|skript|code|klasse|quelltext)\b[^\n]*\b(?:erzeugt|erstellt|generiert)\b|^\W*(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert)\b"
    r"|\bce (?:fichier|script|code)\b[^\n]*\bgénéré\b|^\W*généré(?:e)? automatiquement\b|\best[ea] (?:archivo|fichero|arquivo|script|código)\b[^\n]*\b(?:generado|creado|gerado)\b|^\W*(?:generado|creado) automáticamente\b"
    r"|^\W*gerado automaticamente\b|\bquesto (?:file|script|codice)\b[^\n]*\bgenerato\b|^\W*generato automaticamente\b"
)
_VENDORED_BELOW = (
    rf"(?im)^\W*(?:{_FILE}{_IS} )?(?:copied|imported|taken) (?:unchanged|verbatim|unmodified|as is|over) from\b|\b{_THIS}{_IS} (?:copied|imported|taken|vendored) (?:from|in)\b|^\W*(?:{_FILE}{_IS} )?vendored (?:from|in)\b"
    rf"|^\W*(?:{_THIS}{_IS} )?(?:an? )?(?:bundled|vendored|unmodified|verbatim) copy\b|^\W*upstream ?: ?(?:https?://|git@)|\b{_THIS}{_IS} third[- ]party\b"
)
_JSON_MAKER = r"""\"(?:[_$@]?generat(?:or|ed)(?:_?[bB]y|_?[wW]ith|_from)?|\$?_?tool|autogenerated|generated_by)\"\s*:\s*(?:\"[^\"]+\"|true\b)"""


def _dirs(path: Column) -> Column:
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def path_mark(path: Column, own_addons: Column) -> Column:
    """generated, vendored or null by the default patterns; the first folder is the project's."""
    p = F.lower(F.regexp_replace(F.substring_index(path, "#", 1), r"\\+", "/"))
    inside = F.regexp_replace(p, "^[^/]*/", "")
    union = lambda mark: "|".join(r.lower() for _, r, m, _ in attribute_rules(DEFAULT_ATTRIBUTES, "") if m == mark)
    return (
        F.when(inside.rlike(union("vendored")), "vendored")
        .when(inside.rlike("(?:^|/)addons/") & ~F.coalesce(own_addons, F.lit(False)), "vendored")
        .when(inside.rlike(union("generated")), "generated")
    )


def _json_made(t: Column) -> Column:
    """Whether a member of the outermost object names the maker. Escapes go first, so that a string ends at
    its quote; then makers become one sign and all else but brackets goes. Valid JSON is not needed."""
    x = F.regexp_replace(t, "(?s)\\\\.|\\x01", "")
    x = F.regexp_replace(F.regexp_replace(x, _JSON_MAKER, "\x01"), r'"[^"]*+"', "")
    x = F.regexp_replace(x, r"[^{}\[\]\x01]++", "")
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"), (a["made"] | ((c == "\x01") & (a["depth"] == 1))).alias("made")
    )
    return x.startswith("{") & F.aggregate(F.split(x, ""), F.struct(F.lit(0).alias("depth"), F.lit(False).alias("made")), step, lambda a: a["made"])


def text_marks(df: DataFrame, *keep: str) -> DataFrame:
    """df(text, ...) -> keep and by_text: generated, vendored, minified, data or null by the text. What several
    rules look at is made in steps, once for all of them."""
    t = F.regexp_replace("text", "^﻿", "")
    x = df.select(*keep, t.alias("t"), t.rlike(r"\A\s*[{\[]").alias("json"))
    head = F.regexp_extract("t", r"\A(?:[ \t]*+/\*(?s:.*?)\*/[^\n]*+\n|[ \t]*+(?:#|//|;|/\*|\*|<!--)[^\n]*+\n|[ \t\r]*+\n)*+(?:[ \t]*+(?:#|//|;|/\*|\*|<!--)[^\n]*+)?", 0)
    notes = F.array_join(F.filter(F.regexp_extract_all("t", F.lit(_COMMENTS), F.lit(0)), lambda c: c.rlike(_COMMENT)), "\n")
    bare = F.regexp_replace(F.regexp_replace("t", r'"[A-Za-z0-9+/=]{120,}+"', ""), r"(?:-?(?:0x)?[0-9a-fA-F]++(?:\.\d++)?,\s*+){40,}+", "")
    code = ~F.col("json") & F.col("t").rlike(r"(?m)^\s*(?:extends|class_name|const|static|var|func|let|window\.|module|export|!?\(?function|'use strict')")
    x = x.select(*keep, "t", "json", code.alias("code"), F.split("t", "\n").alias("lines"), *[F.when(~F.col("json"), c).alias(n) for n, c in (("head", head), ("notes", notes))], F.when(code, F.length(bare)).alias("bare"))
    blank = lambda c: F.length(F.regexp_replace(c, r"[^\s]+", ""))
    dense = F.aggregate("lines", F.lit(0), lambda n, c: n + F.when(F.length(c) >= DENSE_LINE, F.when(blank(c) < F.length(c) * DENSE_BLANKS, F.length(c)).otherwise(0)).otherwise(0))
    full = F.filter("lines", lambda c: F.trim(c) != "")
    rows = F.size(F.filter("lines", lambda c: c.rlike(r"""^\s*(?:static\s+)?(?:const|var)\s+\w+\s*(?::\s*\w*\s*)?=\s*(?:"[^"]*"|'[^']*'|[-\d.]+),?;?\s*$|^\s*"?\w+"?\s*[:=]\s*(?:"[^"]*"|[-\d.]+),\s*$|^\s*(?:"[^"]*"|[-\d.]+|\[[-\d., ]+\]),\s*$""")))
    x = x.select(*keep, "t", "json", "code", "head", "notes", "bare", F.when(~F.col("json"), dense).alias("dense"), F.when(F.col("code"), rows).alias("rows"), F.when(F.col("code"), F.size(full)).alias("full"))
    c = F.col
    mark = (
        F.when(c("head").rlike(_GENERATED), "generated")
        .when(c("json") & c("t").rlike(_JSON_MAKER), F.when(_json_made(c("t")), "generated"))
        .when(c("head").rlike(_VENDORED) | F.regexp_replace("head", r"\A[\s#/;*]+", "").rlike(_VENDORED), "vendored")
        .when(c("notes").rlike(_GENERATED_BELOW), "generated")
        .when(c("notes").rlike(_VENDORED_BELOW), "vendored")
        .when(c("code") & (c("bare") < F.length("t") * (1 - DENSE_SHARE)), "data")
        .when((c("dense") > 0) & (c("dense") >= F.length("t") * DENSE_SHARE), "minified")
        .when(c("code") & (c("rows") >= TABLE_ROWS) & (c("rows") >= c("full") * TABLE_SHARE), "data")
    )
    return x.select(*keep, mark.alias("by_text"))


# ---------------------------------------------------------------- attribute files


def glob_regex(glob: str, folder: str) -> str:
    """A pattern of an attribute file in `folder` ('' for the root) as a regular expression on paths."""
    anchored = "/" in glob.rstrip("/")
    g = glob.strip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("/**", i) and i + 3 == len(g):
            out, i = out + "/.*", i + 3
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and "]" in g[i + 2 :]:
            j = g.index("]", i + 2)
            body = g[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        else:
            out, i = out + ("\\" + g[i] if not g[i].isalnum() and g[i] != "_" else g[i]), i + 1
    base = "".join("\\" + c if not c.isalnum() and c not in "_/" else c for c in folder.strip("/"))
    lead = (base + "/" if base else "") + ("" if anchored else "(?:.*/)?")
    return "^" + lead + out + "$"


def attribute_rules(text: str, folder: str) -> Iterator[tuple[int, str, str, bool]]:
    """(line, regex, mark, on) of every marking line of an attribute file in `folder`."""
    for n, line in enumerate(text.splitlines()):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                yield n, glob_regex(parts[0], folder), name[9:], not (a[0] in "-!" or value.lower() in ("false", "0"))


def _rules(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [
        (project, len([x for x in folder.split("/") if x]), *rule)
        for project, folder, text in zip(pdf["project"], pdf["folder"], pdf["text"])
        for rule in attribute_rules(text or "", folder)
    ]
    return pd.DataFrame(rows, columns=["project", "depth", "line", "regex", "mark", "on"])


def _declare(files: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """record_id, mark, unset of a block of files: per attribute the deepest file's last matching line decides."""
    order = [(re.compile(r), m, on) for r, m, on in rules.sort_values(["depth", "line"], ascending=False)[["regex", "mark", "on"]].itertuples(index=False)]
    rows = []
    for k, path in zip(files["record_id"], files["path"]):
        said: dict[str, bool] = {}
        for r, m, on in order:
            if m not in said and r.search(path):
                said[m] = on
        if said:
            rows.append((k, min((m for m, on in said.items() if on), default=None), [m for m, on in sorted(said.items()) if not on]))
    return pd.DataFrame(rows, columns=["record_id", "mark", "unset"])


def declared(files: DataFrame) -> DataFrame:
    """files(record_id, project, path, text): (record_id, mark, unset) of files of which their project's
    attribute files say something: the mark that is set, if any, and those that are taken back. A project is
    matched in blocks of its files, the patterns being sent to each."""
    attr = files.where(F.col("path").rlike(r"(?:^|/)\.gitattributes$") & F.col("text").isNotNull()).select(
        "project", F.regexp_replace("path", r"/?\.gitattributes$", "").alias("folder"), "text"
    )
    rules = attr.mapInPandas(lambda it: map(_rules, it), "project string, depth int, line int, regex string, mark string, on boolean")
    f = files.where("project is not null and path is not null").select("record_id", "project", "path")
    blocks = f.groupBy("project").agg(F.ceil(F.count("*") / BLOCK_FILES).alias("blocks")).join(rules.select("project").distinct(), "project")
    f = f.join(blocks, "project").select("project", F.pmod(F.xxhash64("record_id"), F.col("blocks")).alias("block"), "record_id", "path")
    r = rules.join(blocks, "project").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return f.groupBy("project", "block").cogroup(r.groupBy("project", "block")).applyInPandas(_declare, "record_id string, mark string, unset array<string>")


# ---------------------------------------------------------------- the operator


def _base(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d, "source_id", "project_root", "original_path", "staged_path", "kind")
    s = table(spark, d, "sources", "id", "allow_addons").groupBy(F.col("id").alias("source_id")).agg(F.max("allow_addons").alias("allow_addons"))
    return r.join(F.broadcast(s), "source_id", "left").withColumn("project", canonical_path(F.col("project_root")))  # sources is a fixed list


def _said(spark: SparkSession, d: str, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, by_declaration, unset) and the projects that have attribute files. Only those files' texts
    are looked up; where there are none, nothing is read."""
    attr = base.where(F.col("original_path").rlike(r"(?:^|/)\.gitattributes$")).select("record_id", "project", F.col("original_path").alias("path"), "staged_path")
    if attr.isEmpty():
        return spark.createDataFrame([], "record_id string, by_declaration string, unset array<string>"), spark.createDataFrame([], "project string")
    attr = stored(attr, "attributes")
    at = attr.select("staged_path").distinct()
    at = F.broadcast(at) if attr.count() <= BROADCAST_FILES else at
    texts = table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null").join(at, "staged_path", "left_semi")
    texts = attr.join(texts.groupBy("staged_path").agg(F.min("text").alias("text")), "staged_path").select("record_id", "text")
    files = base.select("record_id", "project", F.col("original_path").alias("path")).join(texts, "record_id", "left")
    # original_path begins with the project's folder; an attribute file's patterns count from there.
    files = files.withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    return declared(files).withColumnRenamed("mark", "by_declaration"), attr.select("project").where("project is not null").distinct()


def marks(spark: SparkSession, d: str) -> DataFrame:
    """record_id, project, path, by_declaration, unset, by_path, by_text, by_mining and mark, the first of
    them that is not taken back."""
    base = stored(_base(spark, d), "files")
    t = table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null")
    judged = text_marks(spread(t.where("text is not null")), "staged_path").where("by_text is not null").groupBy("staged_path").agg(F.min("by_text").alias("by_text"))
    own, projects = _said(spark, d, base)
    x = (
        base.withColumn("by_path", path_mark(F.col("original_path"), F.col("allow_addons")))
        .join(judged, "staged_path", "left")
        .join(own, "record_id", "left")
        .join(projects.withColumn("declares", F.lit(True)), "project", "left")
    )
    x = stored(x, "marked")
    discard(base)
    m = mined(x)
    parts = F.explode_outer(patterns(F.col("original_path")))
    bare = x.where("declares is null").select("record_id", parts.alias("pattern"))  # projects that declare nothing
    by = bare.join(m.select("pattern", F.col("mark").alias("by_mining")), "pattern").groupBy("record_id").agg(F.min("by_mining").alias("by_mining"))
    out = x.join(by, "record_id", "left")
    gone = lambda c: F.when(~F.coalesce(F.array_contains("unset", F.col(c)), F.lit(False)), F.col(c))
    return out.select(
        "record_id",
        "source_id",
        "project",
        F.col("original_path").alias("path"),
        "by_declaration",
        "unset",
        "by_path",
        "by_text",
        "by_mining",
        F.coalesce("by_declaration", gone("by_path"), gone("by_text"), gone("by_mining")).alias("mark"),
    )


def patterns(path: Column) -> Column:
    """The folder names and the compound ending of a path, as patterns that can be mined."""
    p = F.substring_index(F.lower(path), "#", 1)
    d = _dirs(p)
    inside = F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0)))
    ext = F.regexp_extract(F.element_at(F.split(p, "/"), -1), r"(\.[a-z]{1,12}\.[a-z0-9]+)$", 1)
    return F.array_distinct(F.concat(F.transform(inside, lambda x: F.concat(F.lit("dir:"), x)), F.when(ext != "", F.array(F.concat(F.lit("end:"), ext))).otherwise(F.array().cast("array<string>"))))


def mined(x: DataFrame) -> DataFrame:
    """Patterns under which nearly all files are marked, in several projects. addons is left out: whose code
    it holds is the source's matter."""
    k = F.coalesce("by_declaration", "by_text", "by_path")
    e = x.select(F.explode(patterns(F.col("original_path"))).alias("pattern"), "project", k.alias("k")).where("pattern != 'dir:addons'")
    per = e.groupBy("pattern", "project").agg(F.count("*").alias("n"), F.count("k").alias("m"), F.min("k").alias("k"))
    g = per.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if(F.col("m") > 0).alias("projects"), F.min("k").alias("mark"))
    return g.where((F.col("m") >= MINED_FILES) & (F.col("projects") >= MINED_PROJECTS) & (F.col("m") >= F.col("n") * MINED_SHARE))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose file nobody of the project wrote by hand."""
    return marks(spark, d).where("mark is not null").select("record_id")


def handwritten(spark: SparkSession, d: str) -> DataFrame:
    """Records that remain."""
    return marks(spark, d).where("mark is null").select("record_id", "project", "path")


def report(spark: SparkSession, d: str) -> DataFrame:
    """Per project: files, those of each mark, and what the old scanner had counted."""
    a = table(spark, d, "project_audits", "project_root", "generated_files", "addon_files")
    old = a.groupBy(canonical_path(F.col("project_root")).alias("project")).agg(F.max("generated_files").alias("generated_before"), F.max("addon_files").alias("addons_before"))
    g = marks(spark, d).groupBy("project").agg(
        F.count("*").alias("files"),
        F.count("mark").alias("not_handwritten"),
        *[F.count_if(F.col("mark") == k).alias(k) for k in ("generated", "vendored", "minified", "data")],
    )
    return g.join(old, "project", "left")


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Per origin of a mark (declaration, path, text, mining): records that have it, those that have it from
    nowhere else, and the records whose mark it gave."""
    by = ("by_declaration", "by_path", "by_text", "by_mining")
    has = F.filter(F.array(*[F.when(F.col(c).isNotNull(), c[3:]) for c in by]), lambda c: c.isNotNull())
    x = marks(spark, d).where("mark is not null").select(has.alias("has")).select("has", F.explode("has").alias("origin"))
    return x.groupBy("origin").agg(F.count("*").alias("records"), F.count_if(F.size("has") == 1).alias("alone"), F.count_if(F.col("origin") == F.col("has")[0]).alias("first"))


QUERIES = {"p5_found": found, "p5_handwritten": handwritten, "p5_report": report, "p5_origins": origins}
SQL: dict[str, str] = {}
