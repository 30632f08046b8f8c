"""Text normalisation and lexing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the lexical token pattern (a name, a number, or one other visible character).
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\sA-Za-z0-9_]"


def normalize_code(t: Column) -> Column:
    """Line ends as LF, no NUL, no blanks at line ends, no blank lines at the end, one closing LF."""
    x = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "\x00", "")
    x = F.regexp_replace(x, r"[ \t\f\x0B]+\n", "\n")
    x = F.regexp_replace(x, r"[ \t\f\x0B\n]+$", "")
    return F.concat(x, F.lit("\n"))


def normalize_code_sql(c: str) -> str:
    """normalize_code in DuckDB's SQL."""
    x = rf"replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), chr(0), '')"
    x = rf"regexp_replace({x}, '[ \t\f\x0B]+\n', chr(10), 'g')"
    return rf"regexp_replace({x}, '[ \t\f\x0B\n]+$', '') || chr(10)"


def lexical_tokens(t: Column) -> Column:
    """Lower-cased lexical tokens in order."""
    return F.transform(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), F.lower)


def shingles(tokens: Column, n: int = 5) -> Column:
    """Rows of n neighbouring tokens joined by one blank; the whole where there are fewer."""
    size = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(many)


def stripped(t: Column) -> Column:
    """Without ASCII white space around it."""
    return F.regexp_replace(t, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def slug(t: Column, default: str = "item", most: int = 42) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, at most `most` characters."""
    s = F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), r"-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def collapse_blank_lines(t: Column) -> Column:
    """FN-08. Runs of blank lines become one empty line."""
    return F.regexp_replace(t, r"\n(?:[ \t]*\n)+", "\n\n")


def without_ansi(t: Column) -> Column:
    """FN-07. Terminal escapes and carriage returns removed."""
    return F.regexp_replace(F.regexp_replace(t, "\x1b\\[[0-9;?]*[A-Za-z]", ""), "\r", "")


def log_level(t: Column) -> Column:
    """error, warning, success or info by the first keyword rule that applies."""
    x = F.lower(t)
    return (
        F.when(x.rlike(r"error|exception|traceback|failed|fatal"), "error")
        .when(x.rlike(r"warn|deprecated"), "warning")
        .when(x.rlike(r"passed|finished|completed|success|done"), "success")
        .otherwise("info")
    )


def duration(seconds: Column) -> Column:
    """mm:ss, from an hour on hh:mm:ss; null for null."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(seconds >= 3600, F.format_string("%02d:%02d:%02d", h, m, s)).when(seconds.isNotNull(), F.format_string("%02d:%02d", F.floor(seconds / 60), s))


def short_path(path: Column, most: int = 86) -> Column:
    """At most about `most` characters of a path: its beginning, an ellipsis, the last folder and the name."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    name, parent = F.element_at(parts, -1), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    tail = F.when(parent != "", F.concat(parent, F.lit("/"), name)).otherwise(name)
    lead = F.when(parent != "", F.concat(parent, F.lit("/"))).otherwise(F.lit(""))
    tight = F.concat(lead, F.lit("…"), F.substr(name, F.greatest(F.length(name) - F.greatest(F.lit(8), most - F.length(parent) - 3) + 1, F.lit(1))))
    wide = F.concat(F.substr(p, F.lit(1), F.greatest(F.lit(8), most - F.length(tail) - 3)), F.lit("…/"), tail)
    return F.when(F.length(path) <= most, path).when(F.length(tail) >= most - 2, tight).otherwise(wide)
