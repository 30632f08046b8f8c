"""License of each code file and repository.

What a record says about its terms comes from four places: its license, its attribution, the comment at
the very top or end of its text, and its project's license file. Each statement is matched against
templates of licence wordings, names and whole grants, conditions and standard notices: an inverted index
over the templates' rarest token shingles proposes candidates. A name must then stand there word by word; a
text is aligned token by token, which gives the share of it that is there and what was left out or put in,
clause by clause. Wordings of one licence are one name, "or later" included; choices name each choice.

Defined cases: null, empty and filler statements name nothing; a license file in a folder of its own or
one that speaks of assets only does not count; of several audits of a project the latest with a value
decides, and of two at the same time the permitting one; records without project have no file and no
permission; a record without text has no comment.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.paths import canonical_path
from siltworks.llm.licence_texts import DISCLAIMERS, NAMES, PRIVATE, TEXTS
from siltworks.session import spread
from siltworks.sources.tables import records, table

#: Share of a text's tokens that must be found in order; tokens from which a run of them counts.
COVERAGE, RUN = 0.8, 2
#: Tokens of a name's index shingle, and of a text's, of which there are so many for each clause.
SHINGLE, TEXT_SHINGLE, PER_CLAUSE = 2, 3, 3
#: Statements whose outcome a worker keeps, by a hash of 16 bytes.
KEPT = 100_000

#: Spellings that are one token.
_SAME = {"licence": "license", "licences": "license", "licensed": "license", "licenses": "license", "version": "v", "two": "2", "three": "3", "gplv": "gpl v", "mplv": "mpl v", "lgplv": "lgpl v", "agplv": "agpl v", "cc": "cc"}
_DROP = {"the", "a", "an", "under", "of"}
_WORD = re.compile(r"[a-z]+|\d+")


def words(s: str) -> list[str]:
    """Tokens of a statement: letters and numbers apart, spellings unified, articles dropped; a trailing
    zero of a version is a token like any other."""
    out: list[str] = []
    for w in _WORD.findall(s.lower()):
        out += _SAME.get(w, w).split()
    return [w for w in out if w not in _DROP]


def grams(t: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))]


class Index:
    """Names and texts by their rarest shingles."""

    def __init__(self) -> None:
        self.names = list(dict.fromkeys((k, tuple(words(f))) for k, forms in NAMES.items() for f in forms))
        self.texts = [(k, [words(c) for c in clauses]) for k, texts in TEXTS.items() for clauses in texts]
        seen = Counter(g for _, t in self.names for g in set(grams(list(t), SHINGLE)))
        self.by: dict[tuple, list[int]] = {}
        for i, (_, t) in enumerate(self.names):
            g = set(grams(list(t), SHINGLE))
            # Two rare shingles, so that a change to one of them does not hide the name.
            for x in sorted(g, key=lambda x: (seen[x], x))[: 2 if len(g) > 3 else 1]:
                self.by.setdefault(x, []).append(i)
        seen = Counter(g for _, clauses in self.texts for g in {g for c in clauses for g in grams(c, TEXT_SHINGLE)})
        self.of_text: dict[tuple, list[int]] = {}
        for i, (_, clauses) in enumerate(self.texts):
            # Some of every clause, so that an altered clause hides no text.
            for x in {x for c in clauses for x in sorted(set(grams(c, TEXT_SHINGLE)), key=lambda x: (seen[x], x))[:PER_CLAUSE]}:
                self.of_text.setdefault(x, []).append(i)

    def named_at(self, t: list[str]) -> Iterator[tuple[int, int]]:
        """(name, place in t where one of its shingles stands)."""
        for i in range(len(t)):
            for n in (1, SHINGLE):
                if i + n <= len(t):
                    yield from ((k, i) for k in self.by.get(tuple(t[i : i + n]), ()))

    def texts_at(self, t: list[str]) -> dict[int, tuple[int, int]]:
        """Text -> first and last place in t where one of its shingles stands."""
        out: dict[int, tuple[int, int]] = {}
        for i, g in enumerate(grams(t, TEXT_SHINGLE)):
            for k in self.of_text.get(g, ()):
                out[k] = (out[k][0] if k in out else i, i)
        return out


@lru_cache(maxsize=1)
def index() -> Index:
    return Index()


Hit = tuple[int, int, str, int, float, str]  # first token, past the last, licence, weight, coverage, alterations


def name_hits(t: list[str]) -> Iterator[Hit]:
    """The names that stand in t word by word."""
    ix = index()
    for k, at in ix.named_at(t):
        name, form = ix.names[k]
        n = len(form)
        for a in range(max(0, at - n + 1), at + 1):
            if tuple(t[a : a + n]) == form:
                yield a, a + n, name, n, 1.0, ""


def text_hit(name: str, clauses: list[list[str]], t: list[str], lo: int, hi: int) -> Hit | None:
    """The text aligned, token by token, with t[lo:hi]: what of it is there, clause by clause, and what of it
    was left out (-) or put in between (+)."""
    whole = [w for c in clauses for w in c]
    n = len(whole)
    ops = difflib.SequenceMatcher(None, whole, t[lo:hi], autojunk=False).get_opcodes()
    same = [x for x in ops if x[0] == "equal" and x[2] - x[1] >= min(RUN, n)]
    got = sum(x[2] - x[1] for x in same)
    if got < COVERAGE * n:
        return None
    a, b = lo + same[0][3], lo + same[-1][4]
    notes, at = [], 0
    for i, c in enumerate(clauses, 1):
        out = [" ".join(whole[max(x[1], at) : min(x[2], at + len(c))]) for x in ops if x[0] in ("delete", "replace") and x[1] < at + len(c) and x[2] > at]
        put = [" ".join(t[lo + x[3] : lo + x[4]]) for x in ops if x[0] in ("insert", "replace") and at <= x[1] < at + len(c) and a <= lo + x[3] and lo + x[4] <= b]
        if out or put:
            notes.append(f"{name} {i}: " + " ".join([f"-[{x}]" for x in out] + [f"+[{x}]" for x in put]))
        at += len(c)
    return a, b, name, 2 * got - max(n, b - a), got / n, "; ".join(notes)


def _named(statement: str) -> tuple[tuple[str, ...], float, str]:
    t = words(statement)
    ix = index()
    hits = list(name_hits(t))
    for k, (first, last) in ix.texts_at(t).items():
        name, clauses = ix.texts[k]
        n = sum(map(len, clauses))
        if len(t) >= COVERAGE * n:
            h = text_hit(name, clauses, t, max(0, first - n), min(len(t), last + n + TEXT_SHINGLE))
            hits += [h] if h else []
    # Of wordings at one place the one that most of the place speaks for.
    hits.sort(key=lambda h: (-h[3], h[0], h[2]))
    taken: list[Hit] = []
    for h in hits:
        if all(h[1] <= x[0] or h[0] >= x[1] for x in taken):
            taken.append(h)
    if any(h[1] - h[0] == 1 and h[2] == "MIT" for h in taken) and not re.search(r"(?<![A-Za-z])MIT(?![A-Za-z])", statement):
        taken = [h for h in taken if not (h[1] - h[0] == 1 and h[2] == "MIT")]
    names = tuple(sorted({h[2] for h in taken}))
    if len(names) > 1 and PRIVATE in names:
        # "Copyright ... All rights reserved" above a licence's name is a phrase, not a second licence.
        if not _choice(t, sorted(taken), statement):
            names = tuple(n for n in names if n != PRIVATE)
    notes = [h[5] for h in sorted(taken) if h[5]]
    if any(h[3] >= 20 for h in taken):  # a text, and not just its name: whether its disclaimer is there as it was
        notes += _disclaimer(t)
    return names, round(min((h[4] for h in taken), default=0.0), 4), "; ".join(notes)


def _choice(t: list[str], taken: list[Hit], statement: str) -> bool:
    """Whether a statement leaves a choice among what it names: it says dual, or only an "or" or a slash
    lies between two of them."""
    gaps = [t[x[1] : y[0]] for x, y in zip(taken, taken[1:])]
    either = any(len(g) <= 4 and "or" in g and "later" not in g for g in gaps)
    return either or "dual" in t or "dually" in t or len(t) < 20 and bool(re.search(r"[A-Za-z0-9]\s?/\s?[A-Za-z]", statement))


def _disclaimer(t: list[str]) -> list[str]:
    """What differs in a disclaimer that is there for the most part."""
    found = [h for h in (text_hit("disclaimer", [words(c)], t, 0, len(t)) for c in DISCLAIMERS) if h]
    best = max(found, key=lambda h: h[3], default=None)
    return [best[5]] if best and best[5] else []


_outcomes: dict[bytes, tuple[tuple[str, ...], float, str]] = {}


def named(statement: str) -> tuple[tuple[str, ...], float, str]:
    """(licences that a statement names, least coverage, alterations)."""
    key = hashlib.md5(statement.encode("utf-8", "replace")).digest()
    out = _outcomes.get(key)
    if out is None:
        if len(_outcomes) >= KEPT:
            _outcomes.clear()
        out = _outcomes[key] = _named(statement)
    return out


# ---------------------------------------------------------------- statements

_LINE = r"[ \t]*+(?:#|//|;|/\*|\*(?!/)|\*/|<!--)[^\n]*+"


def top_comment(text: Column) -> Column:
    """The comment lines a text begins with; empty where it begins otherwise."""
    t = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.regexp_extract(t, r"\A\s*+((?:/\*(?:[^*]|\*(?!/))*+\*/[^\S\n]*+(?:\n|\z)|" + _LINE + r"(?:\n|\z))++)", 1)


def end_comment(text: Column) -> Column:
    """The comment lines a text ends with."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\s++\z", "")
    last = F.filter(F.transform(F.split(t, "\n"), lambda x: x), lambda x: F.lit(True))
    # Walk back from the last line while lines are comments.
    back = F.aggregate(
        F.reverse(last),
        F.struct(F.lit(True).alias("on"), F.lit("").alias("s")),
        lambda a, x: F.struct(
            (a["on"] & x.rlike("^" + _LINE + "$")).alias("on"),
            F.when(a["on"] & x.rlike("^" + _LINE + "$"), F.concat(x, F.lit("\n"), a["s"])).otherwise(a["s"]).alias("s"),
        ),
    )
    return F.when(F.element_at(last, -1).rlike("^" + _LINE + "$"), back["s"]).otherwise("")


def _name_columns(cols: list[str], keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            for c in cols:
                r = [named(x) if isinstance(x, str) and x else ((), 0.0, "") for x in pdf[c]]
                out[c + "_names"] = [list(x[0]) for x in r]
                out[c + "_coverage"] = [x[1] for x in r]
                out[c + "_altered"] = [x[2] for x in r]
            yield out

    return run


def named_columns(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """df's columns `keep`, and for each of `cols` the licences it names, coverage and alterations."""
    types = dict(df.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [f"{c}_names array<string>, {c}_coverage double, {c}_altered string" for c in cols])
    return df.select(*keep, *cols).mapInPandas(_name_columns(cols, keep), schema)


def license_files(spark: SparkSession, d: str) -> DataFrame:
    """project and the distinct sets of licences that its license files name for scripts."""
    f = table(spark, d, "license_files", "repo", "file_name", "text").where("text is not null")
    own = ~F.coalesce(F.regexp_replace("file_name", r"\\", "/").contains("/"), F.lit(False))
    scripts = ~F.col("text").rlike(r"(?i)\b(?:only|just|solely|exclusively)\b[^.\n]*\b(?:pictures?|sounds?|music|images?|art(?:work)?|assets?|fonts?|textures?|models?|audio|graphics)\b|\bnot (?:for |cover )?(?:the )?(?:scripts?|code)\b")
    n = named_columns(f.where(own & scripts).withColumn("project", canonical_path(F.col("repo"))).where("project is not null"), ["project"], ["text"])
    return n.where(F.size("text_names") > 0).groupBy("project").agg(F.collect_set("text_names").alias("file_sets"))


def permissions(spark: SparkSession, d: str) -> DataFrame:
    """project and redistribution_allowed of its latest audit that has a value."""
    a = table(spark, d, "project_audits", "project_root", "redistribution_allowed", "audited_at").where("redistribution_allowed is not null")
    key = F.struct("audited_at", "redistribution_allowed")
    return a.groupBy(canonical_path(F.col("project_root")).alias("project")).agg(F.max_by("redistribution_allowed", key).alias("allowed")).where("project is not null")


def statements(spark: SparkSession, d: str) -> DataFrame:
    """record_id, project, sets (one set of licences per statement that names any), allowed, and the
    least coverage and the alterations of what was matched."""
    r = records(spark, d, "staged_path", "project_root", "license", "attribution").withColumn("project", canonical_path(F.col("project_root")))
    r = named_columns(r, ["record_id", "staged_path", "project"], ["license", "attribution"])
    t = table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null")
    t = spread(t).select("staged_path", top_comment(F.col("text")).alias("top"), end_comment(F.col("text")).alias("bottom"))
    t = t.withColumn("bottom", F.when(F.col("bottom") == F.col("top"), "").otherwise(F.col("bottom"))).where("top != '' or bottom != ''")
    t = named_columns(t, ["staged_path"], ["top", "bottom"]).where("size(top_names) > 0 or size(bottom_names) > 0")
    t = t.groupBy("staged_path").agg(F.min(F.struct("top_names", "bottom_names", "top_coverage", "bottom_coverage", "top_altered", "bottom_altered")).alias("c"))
    j = r.join(t, "staged_path", "left").join(license_files(spark, d), "project", "left").join(permissions(spark, d), "project", "left")
    none = F.array().cast("array<string>")
    sets = F.filter(
        F.concat(
            F.array(F.col("license_names"), F.col("attribution_names"), F.coalesce("c.top_names", none), F.coalesce("c.bottom_names", none)),
            F.coalesce("file_sets", F.array().cast("array<array<string>>")),
        ),
        lambda x: F.size(x) > 0,
    )
    low = F.least(*[F.when(F.col(c) > 0, F.col(c)) for c in ("license_coverage", "attribution_coverage", "c.top_coverage", "c.bottom_coverage")])
    alt = F.array_join(F.filter(F.array(F.col("license_altered"), F.col("attribution_altered"), F.col("c.top_altered"), F.col("c.bottom_altered")), lambda x: x.isNotNull() & (x != "")), "; ")
    return j.select("record_id", "project", sets.alias("sets"), "allowed", low.alias("coverage"), alt.alias("altered"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """record_id, project, licences (what all statements allow, else all that any names), finding
    (conflict, unknown or null), statements, coverage and altered."""
    s = statements(spark, d)
    apart = F.exists("sets", lambda a: F.exists("sets", lambda b: ~F.arrays_overlap(a, b)))
    private = F.exists("sets", lambda a: F.array_contains(a, PRIVATE)) & F.coalesce("allowed", F.lit(False))
    common = F.aggregate(F.slice("sets", 2, F.greatest(F.size("sets") - 1, F.lit(0))), F.element_at("sets", 1), lambda a, x: F.array_intersect(a, x))
    any_of = F.array_sort(F.array_distinct(F.flatten("sets")))
    empty = F.size("sets") == 0
    return s.select(
        "record_id",
        "project",
        F.when(empty, F.array().cast("array<string>")).when(F.size(common) > 0, F.array_sort(common)).otherwise(any_of).alias("licences"),
        F.when(empty, "unknown").when(apart | private, "conflict").alias("finding"),
        F.size("sets").alias("statements"),
        "coverage",
        "altered",
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose statements conflict, or that have none."""
    return judged(spark, d).where("finding is not null").select("record_id", "finding")


def files(spark: SparkSession, d: str) -> DataFrame:
    """The licence of each file, with the finding, how much of the wording was there and what differed."""
    return judged(spark, d).withColumn("licences", F.array_join("licences", " OR "))


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Per project: its licence (that of most of its files), files, conflicts and unknowns."""
    j = judged(spark, d).where("project is not null").withColumn("licence", F.array_join("licences", " OR "))
    per = j.groupBy("project", "licence").agg(F.count("*").alias("n"), F.count_if(F.col("finding") == "conflict").alias("c"), F.count_if(F.col("finding") == "unknown").alias("u"))
    return per.groupBy("project").agg(
        F.max_by("licence", F.struct(F.col("licence") != "", "n", "licence")).alias("licence"),
        F.sum("n").alias("files"),
        F.sum("c").alias("conflicts"),
        F.sum("u").alias("unknown"),
    )


QUERIES = {"p6_found": found, "p6_files": files, "p6_projects": projects}
SQL: dict[str, str] = {}
