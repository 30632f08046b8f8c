"""Grammars: each checks a whole text and says where it stops being valid.

Every checker returns None for a valid text, else (line, message). GDScript is checked line by line:
strings, comments, names and numbers are reduced to their kinds by a few whole-text substitutions, and
the outcome for each reduced line is kept, because the kinds alone decide validity and few of them are
ever new. JavaScript is read by a recursive-descent parser that asks for one token at a time.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from functools import wraps
from json.scanner import py_make_scanner

Fault = tuple[int, str] | None


class Bad(Exception):
    """Syntax error; the argument is a message, `at` a position or line where known."""

    def __init__(self, message: str, at: int = -1):
        super().__init__(message)
        self.at = at


# ---------------------------------------------------------------- JSON


def _refuse(x: str):
    raise ValueError(f"{x} is no JSON")


def any_depth(parse):
    """Parse again with room for any nesting where the usual depth of calls doesn't do. The parsers are Python
    throughout, so a deep call takes memory in proportion to the text, and no C stack."""

    @wraps(parse)
    def run(text: str) -> Fault:
        try:
            return parse(text)
        except RecursionError:
            usual = sys.getrecursionlimit()
            sys.setrecursionlimit(usual + 100 * len(text))
            try:
                return parse(text)
            finally:
                sys.setrecursionlimit(usual)

    return run


@any_depth
def _json_deep(text: str) -> Fault:
    """json_strict by the reader that is written in Python; the one in C has a fixed depth."""
    d = json.JSONDecoder(parse_constant=_refuse)
    d.scan_once = py_make_scanner(d)
    try:
        d.decode(text)
    except json.JSONDecodeError as e:
        return e.lineno, e.msg
    except ValueError as e:
        return 1, str(e)
    return None


def json_strict(text: str) -> Fault:
    """RFC 8259: one value, no comments, no trailing comma, no NaN."""
    try:
        json.loads(text, parse_constant=_refuse)
        return None
    except json.JSONDecodeError as e:
        return e.lineno, e.msg
    except ValueError as e:
        return 1, str(e)
    except RecursionError:
        return _json_deep(text)


# ---------------------------------------------------------------- Godot configuration

_CFG_LINE = re.compile(
    r"""[^\S\n]*(?:;[^\n]*|\[[^\]"\n]*(?:"(?:[^"\\]|\\.)*"[^\]"\n]*)*\][^\S\n]*(?:;[^\n]*)?|[^\s=;\[\]"][^=\n;\[\]"]*=[^\S\n]*(?:"(?:[^"\\\n]|\\.)*"|-?\d+(?:\.\d*)?(?:e[+-]?\d+)?|true|false|null|Vector[234]i?\([-\d.,e ]*\)|PackedStringArray\((?:"(?:[^"\\\n]|\\.)*"(?:, *)?)*\))[^\S\n]*)?(?:\n|$)"""
)
_CFG_KEY = re.compile(r"""[^\S\n]*(?:"(?:[^"\\\n]|\\.)*"|[^\s=;\[\]"][^=\n;\[\]"]*?)[^\S\n]*=\s*""")
_CFG_TOKEN = re.compile(
    r"""(?:\s|;[^\n]*)*(?:(?P<s>[&^@]?"(?:[^"\\]|\\[\s\S])*")|(?P<n>[+-]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|inf|nan))|(?P<c>\#[0-9a-fA-F]{3,8})|(?P<w>[A-Za-z_][\w.]*)|(?P<p>[\[\](){},:=]))"""
)
_CFG_WORDS = {"true", "false", "null", "nil", "inf", "nan", "inf_neg"}


class _Cfg:
    def __init__(self, text: str, at: int):
        self.s, self.i = text, at

    def tok(self) -> tuple[str, str]:
        m = _CFG_TOKEN.match(self.s, self.i)
        if not m:
            raise Bad("value expected", self.i)
        self.i = m.end()
        return m.lastgroup or "", m[m.lastgroup]

    def peek(self) -> str:
        m = _CFG_TOKEN.match(self.s, self.i)
        return m[m.lastgroup] if m else ""

    def value(self, depth: int = 0) -> None:
        kind, v = self.tok()
        if kind in "snc" and kind:
            return
        if kind == "w":
            if v in _CFG_WORDS:
                return
            if self.peek() == "[":  # typed container
                self.tok()
                while self.tok()[1] != "]":
                    pass
            if self.tok()[1] != "(":
                raise Bad(f"unexpected name {v}", self.i)
            return self.items(")", depth)
        if v == "[":
            return self.items("]", depth)
        if v == "{":
            return self.items("}", depth)
        raise Bad(f"unexpected {v}", self.i)

    def items(self, close: str, depth: int) -> None:
        while self.peek() != close:
            self.value(depth + 1)
            if self.peek() == ":" and (close == "}" or close == ")"):
                self.tok()
                self.value(depth + 1)
            elif close == "}":
                raise Bad("colon expected", self.i)
            if self.peek() == ",":
                self.tok()
            elif self.peek() != close:
                raise Bad(f"{close} expected", self.i)
        self.tok()


@any_depth
def godot_cfg(text: str) -> Fault:
    """`[section]`, `key=value` with values as the engine writes them, `;` comments."""
    i, n = 0, len(text)
    try:
        while i < n:
            m = _CFG_LINE.match(text, i)
            if m and m.end() > i:
                i = m.end()
                continue
            k = _CFG_KEY.match(text, i)
            if not k:
                raise Bad("section, setting or comment expected", i)
            p = _Cfg(text, k.end())
            p.value()
            rest = re.compile(r"[^\S\n]*(?:;[^\n]*)?(?:\n|$)").match(text, p.i)
            if not rest:
                raise Bad("end of line expected", p.i)
            i = max(rest.end(), i + 1)
    except Bad as e:
        return text.count("\n", 0, max(0, e.at)) + 1, str(e)
    return None


# ---------------------------------------------------------------- GDScript

#: Words that are part of the grammar.
_GD_KEYWORDS = (
    "var const func static signal enum class class_name extends if elif else for while match when return pass break continue breakpoint "
    "assert await and or not in is as yield namespace trait"
).split()
_GD_MASK = re.compile(
    r'#[^\n]*|\br?"""(?:[^\\]|\\[\s\S])*?"""|"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|\br"[^"\n]*"|\br\'[^\'\n]*\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|["\']|\\[^\S\n]*\n'
)
_GD_NAME = re.compile(r"(?<![\w])(?!(?:" + "|".join(_GD_KEYWORDS) + r")\b)[^\W\d]\w*")
_GD_NUMBER = re.compile(r"(?<![\w])(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?[\d_]+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?!\w)")
_GD_TOKEN = re.compile(r"\s*(?:(\w+)|(\*\*=|<<=|>>=|\.\.\.|:=|->|\*\*|<<|>>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|[-+*/%&|^~!<>=()\[\]{},.:;@$\"\\?]))")
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", "&=", "|=", "^="}
_BINARY = {
    "or": 2, "||": 2, "and": 3, "&&": 3, "in": 5, "is": 13, "as": 1, "==": 6, "!=": 6, "<": 6, ">": 6, "<=": 6, ">=": 6,
    "|": 7, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 14,
}


def _gd_mask(m: re.Match) -> str:
    x = m[0]
    c = x[0]
    if c == "#":
        return ""
    if c == "\\":
        return " "
    return "\0" if len(x) == 1 else '"' + "\n" * 0


class _Gd:
    """One logical line, given as kinds: a is a name, 0 a number, " a string."""

    def __init__(self, line: str):
        self.t: list[str] = []
        i, n = 0, len(line)
        while i < n:
            m = _GD_TOKEN.match(line, i)
            if not m:
                if line[i:].strip():
                    raise Bad("unexpected character")
                break
            self.t.append(m[1] or m[2])
            i = m.end()
        self.i = 0

    def at(self, *xs: str) -> bool:
        return self.i < len(self.t) and self.t[self.i] in xs

    def end(self) -> bool:
        return self.i >= len(self.t)

    def eat(self, x: str) -> bool:
        if self.at(x):
            self.i += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.eat(x):
            raise Bad(f"{x} expected")

    def name(self) -> None:
        if not (self.eat("a") or self.eat("when")):
            raise Bad("name expected")

    # -- types and parameters
    def type(self) -> None:
        self.name()
        while self.eat("."):
            self.name()
        if self.eat("["):
            self.type()
            if self.eat(","):
                self.type()
            self.need("]")

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.name()
            if self.eat(":="):
                self.expr()
            else:
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expr()
            if not self.eat(",") and not self.at(")"):
                raise Bad(") expected")

    # -- expressions
    def expr(self, least: int = 0) -> None:
        self.unary()
        while not self.end():
            x = self.t[self.i]
            if x == "if":
                if least > 0:
                    return
                self.i += 1
                self.expr(1)
                self.need("else")
                self.expr(0)
                continue
            if x == "not" and self.t[self.i + 1 : self.i + 2] == ["in"]:
                if least > 5:
                    return
                self.i += 2
                self.expr(6)
                continue
            p = _BINARY.get(x)
            if p is None or p < least or (p == 1 and least > 1):
                return
            self.i += 1
            if x in ("is", "as"):
                if x == "is":
                    self.eat("not")
                self.type()
            else:
                self.expr(p + 1)

    def unary(self) -> None:
        while self.at("-", "+", "~", "!", "not", "await"):
            self.i += 1
        self.primary()
        while not self.end():
            if self.eat("."):
                if self.end() or not (self.t[self.i] == '"' or self.t[self.i][0].isalpha()):
                    raise Bad("name expected after .")
                self.i += 1
            elif self.eat("["):
                self.expr()
                self.need("]")
            elif self.eat("("):
                self.args(")")
            else:
                return

    def args(self, close: str) -> None:
        while not self.eat(close):
            if close == "]" and (self.eat("..") or self.eat("var")):
                self.eat("a")
            else:
                self.expr()
            if not self.eat(",") and not self.at(close):
                raise Bad(f"{close} expected")

    def primary(self) -> None:
        if self.end():
            raise Bad("expression expected")
        x = self.t[self.i]
        self.i += 1
        if x in ("a", "0", "when"):
            return
        if x == '"':
            while self.eat('"'):  # neighbours are no valid pair
                raise Bad("operator expected")
            return
        if x == "(":
            self.expr()
            return self.need(")")
        if x == "[":
            return self.args("]")
        if x == "{":
            while not self.eat("}"):
                if self.eat(".."):
                    continue
                self.expr(0)
                if not (self.eat(":") or self.eat("=")):
                    if not self.at(",", "}"):
                        raise Bad("colon expected")
                else:
                    if self.eat("var"):
                        self.name()
                    else:
                        self.expr()
                if not self.eat(",") and not self.at("}"):
                    raise Bad("} expected")
            return None
        if x in ("$", "%"):
            if x == "$":
                self.eat("%")
            if not (self.eat("a") or self.eat('"') or self.eat("..")):
                raise Bad("node path expected")
            while self.at("/") and self.t[self.i + 1 : self.i + 2] and self.t[self.i + 1] in ("a", "..", "%") and x == "$":
                self.i += 2
                if self.t[self.i - 1] == "%":
                    self.name()
            return None
        if x in ("&", "^"):
            return self.need('"')
        if x == "func":
            self.eat("a")
            self.params()
            if self.eat("->"):
                self.type()
            self.need(":")
            return self.inline(until=(")", "]", "}", ","))
        raise Bad(f"unexpected {x}" if x != "\0" else "unterminated text")

    # -- statements
    def inline(self, until: tuple[str, ...] = ()) -> None:
        """One or more statements on the line of their header."""
        while True:
            self.simple()
            if self.end() or self.at(*until):
                return
            self.need(";")
            if self.end():
                return

    def simple(self) -> None:
        """A statement without a block."""
        if self.end():
            raise Bad("statement expected")
        x = self.t[self.i]
        if x in ("pass", "break", "continue", "breakpoint"):
            self.i += 1
        elif x == "return":
            self.i += 1
            if not self.end() and not self.at(";", ")", "]", "}", ","):
                self.expr()
        elif x in ("var", "const"):
            self.variable()
        elif x == "assert":
            self.i += 1
            self.need("(")
            self.args(")")
        elif x in ("if", "while", "for") and self.i > 0:
            self.header()
            self.inline()
        else:
            self.expr()
            if not self.end() and self.t[self.i] in _ASSIGN:
                self.i += 1
                self.expr()

    def variable(self) -> None:
        x = self.t[self.i]
        self.i += 1
        self.name()
        typed = False
        if self.eat(":="):
            self.expr()
            return
        if self.at(":") and self.t[self.i + 1 : self.i + 2] and self.t[self.i + 1] == "a" and not (self.t[self.i + 2 : self.i + 3] == ["="] and self.t[self.i + 3 : self.i + 5] in (["a", ","],)):
            self.i += 1
            self.type()
            typed = True
        if self.eat("="):
            self.expr()
        elif x == "const":
            raise Bad("value expected")
        del typed

    def header(self) -> str:
        """if, elif, while, for, match or else up to and with the colon; gives the block's kind."""
        x = self.t[self.i]
        self.i += 1
        if x == "for":
            self.name()
            if self.eat(":"):
                self.type()
            self.need("in")
        if x != "else":
            self.expr()
        self.need(":")
        return "match" if x == "match" else "body"


def _gd_line(ctx: str, line: str) -> tuple[str, str]:
    """(kind of the line, kind of the block that must follow or ''), or Bad."""
    p = _Gd(line)
    t = p.t
    noted = ""
    while p.at("@"):
        p.i += 1
        p.name()
        if p.eat("("):
            p.args(")")
        noted = "@"
    if p.end():
        return "note", ""
    x = t[p.i]
    rest = t[p.i + 1] if p.i + 1 < len(t) else ""
    if ctx == "match":
        while True:
            if p.eat("var"):
                p.name()
            elif not p.eat(".."):
                p.expr()
            if not p.eat(","):
                break
        if p.eat("when"):
            p.expr()
        p.need(":")
        if p.end():
            return "branch", "body"
        p.inline()
        return "branch", ""
    if ctx == "prop":
        p.name()
        if p.at("("):
            p.params()
        if p.eat("="):
            p.name()
            if p.eat(","):
                p.name()
                p.need("=")
                p.name()
            p.eat(",")
            if not p.end():
                raise Bad("end of line expected")
            return "accessor", ""
        p.need(":")
        if p.end():
            return "accessor", "body"
        p.inline()
        return "accessor", ""
    if x == "static":
        p.i += 1
        x, rest = rest, t[p.i + 1] if p.i + 1 < len(t) else ""
        if x not in ("func", "var"):
            raise Bad("func or var expected")
    if ctx == "class" or x == "const" or x == "var":
        if x in ("var", "const"):
            if x == "var" and ctx == "class":
                return _gd_member(p)
            p.variable()
            if p.eat(":") and ctx == "class":
                return _gd_accessors(p)
            while p.eat(";") and not p.end():
                p.simple()
            if not p.end():
                raise Bad("end of statement expected")
            return "var", ""
        if x == "func":
            p.i += 1
            p.name()
            p.params()
            if p.eat("->"):
                p.type()
            if p.end() and noted:
                return "func", ""
            p.need(":")
            if p.end():
                return "func", "body"
            p.inline()
            return "func", ""
        if x == "signal":
            p.i += 1
            p.name()
            if p.at("("):
                p.params()
        elif x == "enum":
            p.i += 1
            p.eat("a")
            p.need("{")
            while not p.eat("}"):
                p.name()
                if p.eat("="):
                    p.expr()
                if not p.eat(",") and not p.at("}"):
                    raise Bad("} expected")
        elif x == "class":
            p.i += 1
            p.name()
            if p.eat("extends"):
                p.eat('"') or p.type()
            p.need(":")
            if p.end():
                return "class", "class"
            p.inline()
            return "class", ""
        elif x in ("class_name", "extends"):
            while p.at("class_name", "extends"):
                if p.eat("class_name"):
                    p.name()
                    if p.eat(","):
                        p.need('"')
                else:
                    p.i += 1
                    if p.eat('"'):
                        while p.eat("."):
                            p.name()
                    else:
                        p.type()
        elif x in ("pass", '"'):
            p.i += 1
        else:
            raise Bad(f"unexpected {'name' if x == 'a' else x} in class body")
        p.eat(";")
        if not p.end():
            raise Bad("end of line expected")
        return "decl", ""
    if x in ("if", "elif", "else", "while", "for", "match"):
        block = p.header()
        if p.end():
            return x, block
        if x == "match":
            raise Bad("end of line expected")
        p.inline()
        return x, ""
    if x in ("func", "signal", "enum", "class", "class_name", "extends") and rest != "(":
        raise Bad(f"{x} inside a function")
    p.inline()
    if not p.end():
        raise Bad("end of statement expected")
    return "stmt", ""


def _gd_member(p: _Gd) -> tuple[str, str]:
    """A member variable, perhaps with accessors."""
    p.i += 1
    p.name()
    if p.eat(":="):
        p.expr()
    else:
        if p.at(":"):
            after = p.t[p.i + 1 : p.i + 3]
            if not after:
                p.i += 1
                return "var", "prop"
            if not (after[0] == "a" and after[1:] == ["="] and "," in p.t[p.i + 3 : p.i + 5] or after == ["a", "("] and p.t[-1] == ":"):
                p.i += 1
                p.type()
        if p.eat("="):
            p.expr()
    if p.eat(":"):
        return _gd_accessors(p)
    p.eat(";")
    if not p.end():
        raise Bad("end of line expected")
    return "var", ""


def _gd_accessors(p: _Gd) -> tuple[str, str]:
    if p.end():
        return "var", "prop"
    while not p.end():
        p.name()
        if p.at("("):
            p.params()
        if p.eat(":"):
            p.inline()
            break
        p.need("=")
        p.name()
        p.eat(",")
    return "var", ""


_gd_cache: dict[tuple[str, str], tuple[str, str] | str] = {}
#: Reduced lines kept per worker process.
CACHE_LINES = 200_000
_ATOM = re.compile(r'[0"]')
_PAIRS = re.compile(r"(?:a ?: ?a, *){2,}")
_ITEMS = re.compile(r"(?:\ba, *){3,}")


def _gd_known(ctx: str, line: str) -> tuple[str, str]:
    if "{" in line or "[" in line or len(line) > 120:
        if not line.startswith(("func", "static", "enum", "signal", "class", "for", "var", "const", "@", "match")):
            line = _ATOM.sub("a", line)
        line = _PAIRS.sub("a: a,", line)
        if not line.startswith(("func", "static", "signal")):
            line = _ITEMS.sub("a, a, ", line)
    key = (ctx, line)
    r = _gd_cache.get(key)
    if r is None:
        try:
            r = _gd_line(ctx, line)
        except Bad as e:
            r = str(e)
        if len(_gd_cache) > CACHE_LINES:
            _gd_cache.clear()
        _gd_cache[key] = r
    if isinstance(r, str):
        raise Bad(r)
    return r


_OPEN, _CLOSE = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")
_LAMBDA = re.compile(r"\bfunc\b[^:]*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:->\s*[a.\[\]]+\s*)?:\s*$")


def _nested(s: str) -> bool:
    """Whether the brackets in s pair up."""
    stack = []
    for c in s:
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() + c not in ("()", "[]", "{}"):
                return False
    return not stack


@any_depth
def gdscript(text: str) -> Fault:
    """Godot 4 GDScript: line structure, indentation and the grammar of every line."""
    starts: list[int] = []

    def masked(m: re.Match) -> str:
        x = m[0]
        c = x[0]
        if c == "#":
            return ""
        if c == "\\":
            starts.append(m.start())
            return " "
        if len(x) == 1:
            return "\0"
        if "\n" in x:
            starts.extend([m.start()] * x.count("\n"))
        return '"'

    kinds = _GD_MASK.sub(masked, text)
    bad = kinds.find("\0")
    kinds = _GD_NUMBER.sub("0", _GD_NAME.sub("a", kinds))
    lines = kinds.split("\n")
    try:
        _gd_blocks(lines, bad >= 0)
    except Bad as e:
        return max(1, e.at), str(e)
    return None


def _gd_blocks(lines: list[str], unterminated: bool) -> None:
    stack: list[tuple[int, str]] = [(0, "class")]
    last: list[str] = [""]  # the last line's kind on each level
    want = ""  # kind of block that must begin now
    indent_char = ""
    i, n = 0, len(lines)
    while i < n:
        raw = lines[i].rstrip()
        i += 1
        body = raw.lstrip(" \t\f")
        if not body:
            continue
        ind = raw[: len(raw) - len(body)]
        at = i
        if ind:
            c = ind[0]
            if not indent_char:
                indent_char = c
            if ind.count(indent_char) != len(ind):
                raise Bad("tabs and blanks mixed", at)
        depth = len(_OPEN.findall(body)) - len(_CLOSE.findall(body))
        if depth > 0:
            parts = [body]
            while depth > 0:
                if _LAMBDA.search(parts[-1]):
                    # A block inside brackets: its lines lie deeper than the line that opened it.
                    base = len(lines[i - 1]) - len(lines[i - 1].lstrip(" \t")) if i else 0
                    inner = []
                    while i < n and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" \t")) > base):
                        inner.append(lines[i])
                        i += 1
                    if not any(x.strip() for x in inner):
                        raise Bad("indented block expected", i)
                    tail = ""
                    last_line = next(x for x in reversed(inner) if x.strip())
                    extra = len(_CLOSE.findall(last_line)) - len(_OPEN.findall(last_line))
                    if extra > 0:  # the brackets close on the block's last line
                        k = max(j for j, x in enumerate(inner) if x.strip())
                        cut = len(last_line)
                        for _ in range(extra):
                            cut = max(last_line.rfind(c, 0, cut) for c in ")]}")
                        tail = last_line[cut:]
                        inner[k] = last_line[:cut]
                        depth -= extra
                    try:
                        _gd_blocks(["func a():", *["\t" + x if indent_char != " " else " " + x for x in inner]], False)
                    except Bad as e:
                        raise Bad(str(e), i - len(inner) + max(0, e.at - 2)) from None
                    parts.append("pass " + tail)
                    if depth <= 0:
                        break
                if i >= n:
                    raise Bad("closing bracket expected", at)
                nxt = lines[i].strip()
                i += 1
                parts.append(nxt)
                depth += len(_OPEN.findall(nxt)) - len(_CLOSE.findall(nxt))
            body = " ".join(parts)
            if not _nested(body):
                raise Bad("closing bracket expected", at)
        elif depth < 0:
            raise Bad("closing bracket without an opening one", at)
        w = len(ind)
        if want:
            if w <= stack[-1][0]:
                raise Bad("indented block expected", at)
            stack.append((w, want))
            last.append("")
        elif w > stack[-1][0]:
            raise Bad("unexpected indentation", at)
        else:
            while stack[-1][0] > w:
                stack.pop()
                last.pop()
            if stack[-1][0] != w:
                raise Bad("indentation matches no block", at)
        try:
            kind, want = _gd_known(stack[-1][1], body)
        except Bad as e:
            raise Bad("unterminated text" if "\0" in body else str(e), at) from None
        if kind in ("elif", "else") and last[-1] not in ("if", "elif"):
            raise Bad(f"{kind} without if", at)
        last[-1] = kind
    if want:
        raise Bad("indented block expected", n)
    if unterminated and any("\0" in x for x in lines):
        raise Bad("unterminated text", n)


# ---------------------------------------------------------------- JavaScript

_JS_SPACE = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*[\s\S]*?\*/|<!--[^\n]*)*")
_JS_TOKEN = re.compile(
    r"(?P<n>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$])"
    r"|(?P<w>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F{}]+)(?:\w|\$|\\u[0-9a-fA-F{}]+)*)"
    r"|(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
#: Words that cannot name anything.
_JS_RESERVED = set(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
_JS_BIN = {
    "??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7,
    "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11,
}
_JS_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}


class _Js:
    def __init__(self, text: str):
        self.s, self.pos, self.n = text, 0, len(text)
        if text.startswith("#!"):
            self.pos = text.find("\n") if "\n" in text else self.n
        self.next()

    def next(self) -> None:
        m = _JS_SPACE.match(self.s, self.pos)
        a = m.end()
        self.nl = "\n" in self.s[self.pos : a] or self.pos == 0
        self.prev_end = self.pos
        self.start = a
        if a >= self.n:
            self.k, self.v, self.pos = "end", "", a
            return
        m = _JS_TOKEN.match(self.s, a)
        if not m:
            raise Bad("unexpected character", a)
        self.k, self.v, self.pos = m.lastgroup, m[0], m.end()

    def mark(self):
        return self.pos, self.k, self.v, self.nl, self.start

    def back(self, m) -> None:
        self.pos, self.k, self.v, self.nl, self.start = m

    def fail(self, what: str = "") -> None:
        raise Bad(what or f"unexpected {self.v[:20] or 'end'}", self.start)

    def p(self, x: str) -> bool:
        return self.k == "p" and self.v == x

    def eat(self, x: str) -> bool:
        if self.k == "p" and self.v == x:
            self.next()
            return True
        return False

    def need(self, x: str) -> None:
        if not self.eat(x):
            self.fail(f"{x} expected")

    def word(self, x: str) -> bool:
        return self.k == "w" and self.v == x

    def eatw(self, x: str) -> bool:
        if self.k == "w" and self.v == x:
            self.next()
            return True
        return False

    def ident(self) -> None:
        if self.k != "w" or self.v in _JS_RESERVED or self.v[0] == "#":
            self.fail("name expected")
        self.next()

    def semi(self) -> None:
        if self.eat(";") or self.p("}") or self.k == "end" or self.nl:
            return
        self.fail("; expected")

    # -- program and statements
    def program(self) -> None:
        while self.k != "end":
            self.statement()

    def block(self) -> None:
        self.need("{")
        while not self.p("}"):
            if self.k == "end":
                self.fail("} expected")
            self.statement()
        self.next()

    def statement(self) -> None:
        if self.k == "p":
            if self.v == "{":
                return self.block()
            if self.v == ";":
                return self.next()
            if self.v == "@":
                self.next()
                self.unary()
                return self.statement()
        elif self.k == "w":
            f = getattr(self, "s_" + self.v, None) if self.v in _JS_STATEMENTS else None
            if f:
                return f()
            if self.v in ("let", "async") or self.v not in _JS_RESERVED:
                m = self.mark()
                w = self.v
                self.next()
                if w == "let" and (self.k == "w" and self.v not in ("in", "instanceof", "of") or self.p("[") or self.p("{")):
                    self.declare()
                    return self.semi()
                if w == "async" and self.word("function") and not self.nl:
                    return self.s_function()
                if self.p(":") and w not in _JS_RESERVED:
                    self.next()
                    return self.statement()
                self.back(m)
        self.expression()
        self.semi()

    def declare(self, no_in: bool = False, loop: bool = False) -> None:
        while True:
            pattern = not self.k == "w"
            self.binding()
            if self.eat("="):
                self.assign(no_in)
            elif pattern and not loop:
                self.fail("= expected")
            if not self.eat(","):
                return

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assign()
                if not self.p("]"):
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    short = self.k == "w" and self.v not in _JS_RESERVED
                    self.key()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        self.fail(": expected")
                    if self.eat("="):
                        self.assign()
                if not self.p("}"):
                    self.need(",")
        else:
            self.ident()

    def s_var(self) -> None:
        self.next()
        self.declare()
        self.semi()

    def s_const(self) -> None:
        self.next()
        while True:
            self.binding()
            self.need("=")
            self.assign()
            if not self.eat(","):
                break
        self.semi()

    def s_if(self) -> None:
        self.next()
        self.paren()
        self.statement()
        if self.eatw("else"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_while(self) -> None:
        self.next()
        self.paren()
        self.statement()

    s_with = s_while

    def s_do(self) -> None:
        self.next()
        self.statement()
        if not self.eatw("while"):
            self.fail("while expected")
        self.paren()
        self.eat(";")

    def s_for(self) -> None:
        self.next()
        self.eatw("await")
        self.need("(")
        if self.word("var") or self.word("const") or self.word("let"):
            self.next()
            self.declare(no_in=True, loop=True)
        elif not self.p(";"):
            self.expression(no_in=True)
        if self.word("of") or self.word("in"):
            self.next()
            self.expression()
        else:
            self.need(";")
            if not self.p(";"):
                self.expression()
            self.need(";")
            if not self.p(")"):
                self.expression()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        self.next()
        if not (self.nl or self.p(";") or self.p("}") or self.k == "end"):
            self.expression()
        self.semi()

    def s_throw(self) -> None:
        self.next()
        if self.nl:
            self.fail("expression expected")
        self.expression()
        self.semi()

    def s_break(self) -> None:
        self.next()
        if self.k == "w" and not self.nl and self.v not in _JS_RESERVED:
            self.next()
        self.semi()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.next()
        self.semi()

    def s_try(self) -> None:
        self.next()
        self.block()
        some = False
        if self.eatw("catch"):
            some = True
            if self.eat("("):
                self.binding()
                self.need(")")
            self.block()
        if self.eatw("finally"):
            some = True
            self.block()
        if not some:
            self.fail("catch expected")

    def s_switch(self) -> None:
        self.next()
        self.paren()
        self.need("{")
        while not self.eat("}"):
            if self.eatw("case"):
                self.expression()
            elif not self.eatw("default"):
                self.fail("case expected")
            self.need(":")
            while not (self.word("case") or self.word("default") or self.p("}")):
                if self.k == "end":
                    self.fail("} expected")
                self.statement()

    def s_function(self, named: bool = True) -> None:
        self.next()
        self.eat("*")
        if self.k == "w" and not self.p("("):
            self.ident()
        elif named:
            self.fail("name expected")
        self.params()
        self.block()

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.binding()
            if self.eat("="):
                self.assign()
            if not self.p(")"):
                self.need(",")

    def s_class(self, named: bool = True) -> None:
        self.next()
        if self.k == "w" and not self.word("extends"):
            self.ident()
        elif named:
            self.fail("name expected")
        if self.eatw("extends"):
            self.unary()
        self.need("{")
        while not self.eat("}"):
            if self.eat(";"):
                continue
            while self.eat("@"):
                self.unary()
            self.member()

    def member(self) -> None:
        for w in ("static", "async", "get", "set"):
            if self.word(w):
                m = self.mark()
                self.next()
                if self.p("(") or self.p("=") or self.p(";") or self.p("}") or (self.nl and w != "static"):
                    self.back(m)
                    break
                if w == "static" and self.p("{"):
                    return self.block()
        self.eat("*")
        self.key()
        if self.p("("):
            self.params()
            self.block()
        else:
            if self.eat("="):
                self.assign()
            self.semi()

    def key(self) -> None:
        if self.eat("["):
            self.assign()
            self.need("]")
        elif self.k in ("w", "s", "n"):
            self.next()
        else:
            self.fail("key expected")

    def s_import(self) -> None:
        m = self.mark()
        self.next()
        if self.p("(") or self.p("."):
            self.back(m)
            self.expression()
            return self.semi()
        if self.k != "s":
            if self.k == "w" and not self.word("from"):
                self.ident()
                self.eat(",")
            if self.eat("*"):
                if not self.eatw("as"):
                    self.fail("as expected")
                self.ident()
            elif self.p("{"):
                self.names()
            if not self.eatw("from"):
                self.fail("from expected")
        if self.k != "s":
            self.fail("module name expected")
        self.next()
        if self.word("with") or self.word("assert"):
            self.next()
            self.primary()
        self.semi()

    def names(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.key()
            if self.eatw("as"):
                self.key()
            if not self.p("}"):
                self.need(",")

    def s_export(self) -> None:
        self.next()
        if self.eatw("default"):
            if self.word("function"):
                return self.s_function(named=False)
            if self.word("class"):
                return self.s_class(named=False)
            self.assign()
            return self.semi()
        if self.p("{") or self.p("*"):
            if self.eat("*"):
                if self.eatw("as"):
                    self.key()
            else:
                self.names()
            if self.eatw("from"):
                if self.k != "s":
                    self.fail("module name expected")
                self.next()
            return self.semi()
        if self.k == "w" and self.v in ("var", "let", "const", "function", "class", "async"):
            return self.statement()
        self.fail()

    # -- expressions
    def expression(self, no_in: bool = False) -> None:
        self.assign(no_in)
        while self.eat(","):
            self.assign(no_in)

    def arrow(self) -> bool:
        """An arrow function's parameters, if an arrow follows; nothing is consumed otherwise."""
        m = self.mark()
        try:
            if self.word("async"):
                self.next()
                if self.nl or not (self.k == "w" and self.v not in _JS_RESERVED or self.p("(")):
                    self.back(m)
                    return False
            if self.p("("):
                self.params()
            else:
                self.ident()
            if self.p("=>") and not self.nl:
                self.next()
                return True
        except Bad:
            pass
        self.back(m)
        return False

    def maybe_arrow(self) -> bool:
        if self.k == "w":
            if self.v in _JS_RESERVED or self.v[0] == "#":
                return False
            if self.v == "async":
                return True
            m = _JS_SPACE.match(self.s, self.pos)
            return self.s.startswith("=>", m.end())
        if self.p("("):
            # The bracket that closes this one must be followed by an arrow.
            m = _JS_SPACE.match(self.s, self.pos)
            c = self.s[m.end() : m.end() + 1]
            return c in ")[{." or c.isalpha() or c in "_$"
        return False

    def assign(self, no_in: bool = False) -> None:
        if self.maybe_arrow() and self.arrow():
            return self.block() if self.p("{") else self.assign(no_in)
        if self.word("yield"):
            m = self.mark()
            self.next()
            if not self.nl and (self.eat("*") or not (self.k == "p" and self.v in ")]};,:" or self.k == "end" or self.p("="))):
                return self.assign(no_in)
            if not self.p("="):
                return None
            self.back(m)
        target = self.binary(0, no_in)
        if self.k == "p":
            if self.v == "?":
                self.next()
                self.assign()
                self.need(":")
                return self.assign(no_in)
            if self.v in _JS_ASSIGN:
                if not target:
                    self.fail("no target to assign to")
                self.next()
                return self.assign(no_in)
        return None

    def binary(self, least: int, no_in: bool) -> bool:
        target = self.unary()
        while True:
            p = _JS_BIN.get(self.v) if self.k in ("p", "w") else None
            if p is None or p <= least or (no_in and self.v == "in"):
                return target
            self.next()
            self.binary(p if p != 11 else p - 1, no_in)
            target = False

    def unary(self) -> bool:
        if self.k == "p" and self.v in ("!", "~", "+", "-", "++", "--"):
            self.next()
            self.unary()
            return False
        if self.k == "w" and self.v in ("typeof", "void", "delete"):
            self.next()
            self.unary()
            return False
        if self.word("await"):
            m = self.mark()
            self.next()
            if not (self.k == "end" or self.k == "p" and self.v in ")]};,:=.?" or self.p("=>")):
                self.unary()
                return False
            self.back(m)
        target = self.postfix()
        if self.k == "p" and self.v in ("++", "--") and not self.nl:
            if not target:
                self.fail("no target")
            self.next()
            return False
        return target

    def postfix(self) -> bool:
        if self.word("new"):
            self.next()
            if self.eat("."):
                self.next()
                target = False
            else:
                self.unary_new()
                target = False
        else:
            target = self.primary()
        return self.suffixes(target)

    def unary_new(self) -> None:
        if self.word("new"):
            self.next()
            self.unary_new()
        else:
            self.primary()
        while True:
            if self.eat("."):
                self.member_name()
            elif self.eat("["):
                self.expression()
                self.need("]")
            else:
                break
        if self.eat("("):
            self.args()

    def member_name(self) -> None:
        if self.k != "w":
            self.fail("name expected")
        self.next()

    def suffixes(self, target: bool) -> bool:
        while self.k == "p":
            if self.v == ".":
                self.next()
                self.member_name()
                target = True
            elif self.v == "?.":
                self.next()
                if self.eat("("):
                    self.args()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                else:
                    self.member_name()
                target = False
            elif self.v == "[":
                self.next()
                self.expression()
                self.need("]")
                target = True
            elif self.v == "(":
                self.next()
                self.args()
                target = False
            elif self.v == "`":
                self.template()
                target = False
            else:
                break
        return target

    def args(self) -> None:
        while not self.eat(")"):
            self.eat("...")
            self.assign()
            if not self.p(")"):
                self.need(",")

    def template(self) -> None:
        while True:
            m = _JS_TEXT.match(self.s, self.pos)
            self.pos = m.end()
            if self.pos >= self.n:
                raise Bad("unterminated text", self.start)
            if self.s[self.pos] == "`":
                self.pos += 1
                return self.next()
            self.pos += 2
            self.next()
            self.expression()
            if not self.p("}"):
                self.fail("} expected")

    def primary(self) -> bool:
        k, v = self.k, self.v
        if k == "w":
            if v == "function":
                self.s_function(named=False)
                return False
            if v == "class":
                self.s_class(named=False)
                return False
            if v == "async":
                m = self.mark()
                self.next()
                if self.word("function") and not self.nl:
                    self.s_function(named=False)
                    return False
                self.back(m)
            if v == "import":
                self.next()
                if not (self.p("(") or self.p(".")):
                    self.fail()
                return False
            if v in _JS_RESERVED and v not in ("this", "null", "true", "false", "super"):
                self.fail()
            if v[0] == "#":
                self.next()
                if not self.word("in"):
                    self.fail()
                return False
            self.next()
            return v not in ("this", "null", "true", "false")
        if k in ("n", "s"):
            self.next()
            return False
        if k == "p":
            if v == "(":
                self.next()
                self.expression()
                self.need(")")
                return True
            if v == "[":
                self.next()
                while not self.eat("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assign()
                    if not self.p("]"):
                        self.need(",")
                return True
            if v == "{":
                self.object()
                return True
            if v == "`":
                self.template()
                return False
            if v in ("/", "/="):
                m = _JS_REGEX.match(self.s, self.start)
                if not m:
                    self.fail("unterminated pattern")
                self.pos = m.end()
                self.next()
                return False
        self.fail()
        return False

    def object(self) -> None:
        self.next()
        while not self.eat("}"):
            if self.eat("..."):
                self.assign()
            else:
                plain = self.k == "w"
                own = self.v
                if plain and own in ("get", "set", "async"):
                    m = self.mark()
                    self.next()
                    if self.k == "p" and self.v in (",", ":", "(", "}", "="):
                        self.back(m)
                    else:
                        plain = False
                if self.eat("*"):
                    plain = False
                if self.k == "w":
                    own = self.v
                else:
                    plain = False
                self.key()
                if self.p("("):
                    self.params()
                    self.block()
                elif self.eat(":"):
                    self.assign()
                elif plain and own not in _JS_RESERVED:
                    if self.eat("="):
                        self.assign()
                else:
                    self.fail(": expected")
            if not self.p("}"):
                self.need(",")


_JS_STATEMENTS = set("var const if while with do for return throw break continue debugger try switch function class import export".split())


@any_depth
def javascript(text: str) -> Fault:
    """ECMAScript, scripts and modules."""
    p = None
    try:
        p = _Js(text)
        p.program()
    except Bad as e:
        return text.count("\n", 0, max(0, e.at)) + 1, str(e)
    return None


# ---------------------------------------------------------------- foreign languages


def python(text: str) -> Fault:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return None
    except SyntaxError as e:
        return e.lineno or 1, e.msg
    except (ValueError, RecursionError, MemoryError) as e:
        return 1, str(e)


_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?:\s[^<>]*)?(/?)>|<!--[\s\S]*?-->|<!\w[^>]*>")
_VOID = set("area base br col embed hr img input link meta source track wbr li p td tr th option dt dd".split())


def html(text: str) -> Fault:
    """Markup: begins with a tag and its tags pair up."""
    if not text.lstrip().startswith("<"):
        return 1, "tag expected"
    stack: list[str] = []
    for m in _TAG.finditer(text):
        name = (m[2] or "").lower()
        if not name or m[3] or name in _VOID:
            continue
        if not m[1]:
            stack.append(name)
        elif not stack or stack.pop() != name:
            return text.count("\n", 0, m.start()) + 1, f"</{name}> without its start"
    return (text.count("\n") + 1, f"</{stack[-1]}> expected") if stack else None


_C_MASK = re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|@?"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_C_HEAD = re.compile(r"^\s*(?:using|namespace|import|package|public|private|internal|protected|class|struct|#include)\b", re.M)


def csharp(text: str) -> Fault:
    """The C family: declarations, statements that end in semicolons, brackets that pair up."""
    plain = _C_MASK.sub('""', text)
    if not _C_HEAD.search(plain):
        return 1, "declaration expected"
    if not _nested(re.sub(r"[^()\[\]{}]", "", plain)):
        return text.count("\n") + 1, "brackets do not pair up"
    for i, line in enumerate(plain.split("\n"), 1):
        s = line.strip()
        if s and s[-1] not in ";{},:)]>(" and not s.startswith(("#", "[", "@")) and not re.match(r"[\w\s<>\[\],.?:]+(?:\([^)]*\))?[\w\s:<>,.]*$", s):
            return i, "; expected"
    return None


def markdown(text: str) -> Fault:
    """Prose with headings or lists and without statements."""
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(bool(re.match(r"\s*(?:#{1,6} \S|[-*] |\d+\. |> |```|\[)", x)) for x in lines)
    return None if lines and marks * 4 >= len(lines) and re.search(r"^#{1,6} |^[-*] ", text, re.M) else (1, "no markup")


GRAMMARS = {
    "gdscript": gdscript, "javascript": javascript, "json": json_strict, "godot_cfg": godot_cfg,
    "python": python, "html": html, "csharp": csharp, "markdown": markdown,
}

_MARKS = {
    "gdscript": re.compile(r"^\s*(?:func \w+\(|extends \w|class_name \w|@\w+|signal \w|var \w+ ?:?=|(?:el)?if .*:$|for \w+ in .*:$)", re.M),
    "javascript": re.compile(r"\b(?:function\b|=>|let \w|const \w+ ?=|===|document\.|window\.|console\.)|;$", re.M),
    "json": re.compile(r"^\s*\"[^\"\n]*\": |^\s*[{\[]\s*$", re.M),
    "godot_cfg": re.compile(r"^\[[\w./ ]+\]\s*$|^[\w/.]+=\S|^;", re.M),
    "python": re.compile(r"^\s*(?:def \w+\(|import \w|from \w+ import|class \w+.*:$|with .*:$|if __name__)", re.M),
    "html": re.compile(r"</?[a-z]+[^>\n]*>"),
    "csharp": re.compile(r"^\s*(?:using [\w.]+;|namespace |(?:public|private|protected|internal) )|\bvoid \w+\(|\d+f;", re.M),
    "markdown": re.compile(r"^(?:#{1,6} \S|[-*] \S|> )|\]\(", re.M),
}


def ranked(text: str) -> list[str]:
    """Languages by how often their tokens occur, most likely first."""
    n = {k: len(r.findall(text)) for k, r in _MARKS.items()}
    return sorted(n, key=lambda k: (-n[k], list(n).index(k)))
