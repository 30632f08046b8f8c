"""Quote-aware scanning of scripts: comments, strings and brackets."""

from __future__ import annotations

import hashlib
import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.ident import simhash_of
from siltworks.functions.text import TOKEN
from siltworks.session import spread

_PART = re.compile(r'"""(?:[^\\]|\\[\s\S])*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\[\s\S])*?(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|\'(?:[^\'\\\n]|\\.)*(?:\'|(?=\n)|\Z)|#[^\n]*')


def strip_comments(text: str, mask: bool = False) -> str:
    """FN-03. Without comments outside strings; with `mask`, the inside of strings becomes blanks."""

    def part(m: re.Match) -> str:
        x = m[0]
        if x[0] == "#":
            return ""
        if not mask:
            return x
        k = 3 if x[:3] in ('"""', "'''") else 1
        inner = "".join(c if c == "\n" else " " for c in x[k : max(k, len(x) - k)])
        return x[:k] + inner + (x[-k:] if len(x) >= 2 * k else "")

    return _PART.sub(part, text)


#: _PART for an engine without look-ahead: a string or a comment, the former as group 1.
_PART_SQL = r'''("""(?:[^\\]|\\[\s\S])*?(?:"""|\z)|''' + r"""'''(?:[^\\]|\\[\s\S])*?(?:'''|\z)|""" + r'''"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|#[^\n]*'''


def uncommented_sql(c: str) -> str:
    """strip_comments in DuckDB's SQL."""
    return f"regexp_replace({c}, '{_PART_SQL.replace(chr(39), chr(39) * 2)}', '\\1', 'g')"


def dedup_form(text: str) -> str:
    """FN-02. For duplicate search: comments gone, lines stripped, inner white space as one blank, no blank lines."""
    lines = (re.sub(r"\s+", " ", x.strip()) for x in strip_comments(text.replace("\r\n", "\n").replace("\r", "\n")).split("\n"))
    return "\n".join(x for x in lines if x)


def unbalanced(text: str) -> bool:
    """Whether brackets outside strings and comments fail to pair up."""
    stack = []
    for c in strip_comments(text, mask=True):
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() + c not in ("()", "[]", "{}"):
                return True
    return bool(stack)


_TOKEN = re.compile(TOKEN)


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8", "replace")).hexdigest()


def lexical(df: DataFrame, key: str, text: str, form: bool = False, sketch: bool = False) -> DataFrame:
    """(key, sha, form_hash, tokens, distinct_tokens, simhash) of the lexical tokens of `text`, of its
    duplicate-search form where `form` is set; the SimHash only where `sketch` is. One pass in Arrow batches: as a column expression
    the token array would be built once for every use of it."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[text]):
                f = dedup_form(x) if form else x
                t = [w.lower() for w in _TOKEN.findall(f)]
                rows.append((k, _sha(x), _sha(f), len(t), len(set(t)), simhash_of(t) if sketch else 0))
            yield pd.DataFrame(rows, columns=[key, "sha", "form_hash", "tokens", "distinct_tokens", "simhash"])

    x = df.where(F.col(text).isNotNull()).select(key, text)
    return spread(x).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, sha string, form_hash string, tokens long, distinct_tokens long, simhash long")


def unbalanced_udf(c) -> Column:
    """unbalanced in Arrow batches."""

    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unbalanced(x) if isinstance(x, str) else None)

    return F.pandas_udf(run, "boolean")(c)


#: The header of a function, and of a documentation page's script block.
_FUNC = re.compile(r"[ \t]*(?:static\s+)?func\s+[A-Za-z_]\w*\s*\(.*\)\s*(?:->\s*[^:]+)?\s*:\s*$")
_DIRECTIVE = re.compile(r"[ \t]*\.\.\s+(?:code-block|code-tab|code)::\s+(?:gdscript|GDScript)(?:\s.*)?$")
#: Lines of a function block, characters of a snippet, and beginnings of what is only output.
BLOCK_LINES, SNIPPET_CHARS, OUTPUT = (3, 180), 24, ("# Output:", "# Prints")


def indent(line: str) -> int:
    """Columns ahead of a line's first sign, a tab going to the next multiple of four."""
    return len(line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4))


def below(lines: list[str], i: int, base: int) -> int:
    """The end of the run of lines from i on that are blank or indented by more than `base`."""
    while i < len(lines) and (not lines[i].strip() or indent(lines[i]) > base):
        i += 1
    return i


def function_blocks(text: str) -> list[tuple[int, str]]:
    """(index, code) of every function block of 3 to 180 lines, told by indentation."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        head, i = i, i + 1
        if _FUNC.match(lines[head]):
            i = below(lines, i, indent(lines[head]))
            code = "\n".join(lines[head:i]).rstrip()
            if BLOCK_LINES[0] <= code.count("\n") + 1 <= BLOCK_LINES[1]:
                out.append((len(out), code))
    return out


def rst_snippets(text: str) -> list[tuple[int, str]]:
    """(number, code) of the script blocks of a documentation page, option lines skipped and the common
    indentation removed; short ones, those with an ellipsis and those that show output are left out."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        head, i = i, i + 1
        if not _DIRECTIVE.match(lines[head]):
            continue
        base = indent(lines[head])
        while i < len(lines) and (not lines[i].strip() or indent(lines[i]) > base and lines[i].lstrip().startswith(":")):
            i += 1
        start, i = i, below(lines, i, base)
        code = textwrap.dedent("\n".join(lines[start:i])).strip("\n")
        if len(code) >= SNIPPET_CHARS and "..." not in code and not code.lstrip().startswith(OUTPUT):
            out.append((len(out) + 1, code))
    return out
