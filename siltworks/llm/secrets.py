"""Credentials embedded in source code.

Every text is scanned once, where it is read. Candidates come from context: a value bound to a name
that says credential (assignment, key of a table, argument after the name, unquoted setting, a comment
that tells it), an authorisation header, a login in an address, a signed address, a log-in call, a
private key block, a token of a known form. Values are judged by how many characters a subword of a
public vocabulary covers: random strings fall apart into short subwords, written language does not.
Context decides how unnatural a value must be; placeholders, look-ups, slots, digests and ids are out.
Redaction overwrites the value character by character, so offsets and syntax stay.

Defined cases: null and empty texts have no hit; a line counts once; repeated rows give the same hits
once; text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import tokens
from siltworks.session import spread
from siltworks.sources.tables import table

#: Characters per subword at or under which a value is unnatural; the same for a value that a person has made
#: up from words, with a digit or a sign in it, and is bound to a credential's name.
UNNATURAL, UNNATURAL_NAMED = 2.6, 4.0
#: Words that name a credential by themselves, and kinds of key that do.
WORDS = (
    "token secret password passwort passwd passphrase kennwort wachtwoord contrasena senha pwd passcode "
    "credential credentials cred creds bearer apikey pat pass secretkey accesskey authkey authtoken"
).split()
KEY_OF = "api access secret service signing sign private master encryption auth client storage deploy license admin root".split()
#: What may follow the naming word in a name.
TAIL = "value val str text string dev prod production staging stage live test local old new backup default".split()

_LIT = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_NAME_END = (
    r"(?:(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")|(?:" + "|".join(KEY_OF) + r")[_\-. ]?keys?)(?:[_\-]?(?:" + "|".join(TAIL) + r"|\d+))?"
)
#: A naming word that is a whole part of the name before it, or its camel-case end.
_HEAD = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
NAMED = re.compile(
    _HEAD + r"(?P<name>(?i:" + _NAME_END + r"))(?P<q>[\"'\]]*)\s*"
    r"(?:(?P<op>:\s*(?i:string(?:name)?)\s*=|:=|=>|==|=|:)|(?P<arg>,))\s*(?P<open>[(\[]?)\s*(?P<v>(?:" + _LIT + r")(?:\s*[+,]\s*(?:" + _LIT + r"))*)"
)
BARE = re.compile(
    r"^[ \t]*(?P<c>[#;][ \t]*)?(?:export[ \t]+)?(?P<full>[A-Za-z][\w./\-]*?)?" + _HEAD + r"(?P<name>(?i:" + _NAME_END + r"))[ \t]*=[ \t]*(?P<v>[^\s\"'(\[{][^\s\"']*)[ \t]*\r?$", re.M
)
#: Told in a comment: the name, then perhaps a link word, then the value.
TOLD = re.compile(
    r"(?m)(?:^|(?<=\s))(?:#|//|;|/\*|\*)[^\n\"']*?" + r"(?<![A-Za-z])(?P<name>(?i:" + _NAME_END + r"))(?![\w\-])[\"']?[ \t]*(?:is[ \t]|was[ \t]|->|=>|:=|=|:)?[ \t]*[\"'`]?(?P<v>[^\s\"'`]{6,})"
)
#: A literal that the comment at the line's end calls a credential.
NOTED = re.compile(r"(?P<v>" + _LIT + r")[^\n\"'#]*(?:#|//)[ \t]*(?P<why>[^\n]*)$", re.M)
HEADER = re.compile(
    r"(?i)(?<![\w\-])(?:(?:authorization|x-auth(?:-token)?|x-api-key|api-key|private-token|x-access-token)[\"']?\s*[:=,]\s*[\"'`]?(?:(?:bearer|token|apikey)[ ]+)?"
    r"|cookie[\"']?\s*[:=,]\s*[\"'`]?[\w\-]*(?:sid|session|token|auth)\w*=)(?P<v>[^\s\"'`;,<>{}()$%]{8,})"
)
SCHEME = re.compile(r"\b(?i:bearer|token)[ ]+(?P<v>[A-Za-z0-9+/=_.\-~]{16,})")
BASIC = re.compile(r"\b[Bb]asic[ ]+(?P<v>[A-Za-z0-9+/]{6,}={0,2})")
LOGIN_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]*://(?P<u>[^\s:/@\"'`<>]*)(?::(?P<v>[^\s/\"'`<>]+))?@(?=[A-Za-z0-9\[])")
QUERY = re.compile(r"(?i)[?&;](?:sig|signature|sign|(?:access_?|auth_?|api_?|secret_?|private_?)?(?:token|key)|auth|secret|password|passwd|pwd)=(?P<v>[^&\s\"'#`]+)")
HOOK = re.compile(r"(?i)https?://[^\s\"'`]*?/(?:services|webhooks?|hooks?)/(?P<v>[A-Za-z0-9_\-/]{16,})")
CALL = re.compile(
    r"(?<![A-Za-z0-9])(?i:log_?in|sign_?in|authenticate|set_credentials|basic_auth|set_password|unlock_with)\w*\s*\(\s*(?:[^()\n\"']*,\s*)?(?P<u>" + _LIT + r")\s*(?:,\s*(?P<v>" + _LIT + r"))"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:\s|\\n|[\"'+,]|(?:Proc-Type|DEK-Info)[^\n]*)*[A-Za-z0-9+/=]{16,}(?:[A-Za-z0-9+/=\s]|\\n|[\"'+,])*)")
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|sk-(?:[a-z]+-)?[A-Za-z0-9_\-]{20,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|AIza[\w\-]{35}|xox[abposr]-[\w\-]{10,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}"
    r"|[a-z]{2,6}_(?:live|pat|prod|key|secret)_[A-Za-z0-9]{20,}|ptk-[A-Za-z0-9]{20,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})"
)
#: Never a credential, whatever its name.
PLACEHOLDER = re.compile(
    r"(?i)^(?:|[x*.\-_#?0 ]+|(.)\1*|<.*>|\[.*\]|\$.*|%.*%?|.*%[sdv]|.*\$\{.*|.*\{\{?\w*\}?\}.*|(?:res|user|uid|file)://.*|0x[0-9a-f]{1,8}"
    r"|(?:[a-z]+[_\-. ])*(?:your|replace|change|changeme|placeholder|example|dummy|insert|redacted|todo|fixme|sample|none|null|nil|undefined|true|false|enter|goes|here|not|set|unset|empty|hidden|secret|masked|removed)(?:[_\-. ][a-z]+)*)$"
)
_JOIN = re.compile(r"\s*,?\s*\]\s*\.\s*join\b")
_DENIED = re.compile(r"(?i)\bnot?\s+(?:a|an|the|our|real)\b|\bno\s+\w+\b|example|placeholder")
_NAMING = re.compile(r"(?i)(?<![A-Za-z])(?:" + _NAME_END + r")(?![A-Za-z])")
#: A text with none of these, in lower case, binds no value to a credential's name.
_ROOTS = [w for w in WORDS if w not in ("pat", "pass")] + [k + j + "key" for k in KEY_OF for j in ("_", "-", ".", " ", "")]
#: The two words that are common in code as well, and such of them as are bound to something.
_SHORT = re.compile(_HEAD + r"(?i:pass|pat)")
_BOUND = re.compile(r"(?i:pass|pat)(?:[_\-]?(?:(?i:" + "|".join(TAIL) + r")|\d+))?[\"'\]]*\s*[:=,]")
#: Words, perhaps numbered: what names a thing, and may be a password, but no key or token.
_NUMBERED = re.compile(r"[A-Za-z]+(?:[_\-./ ][A-Za-z]+)*[_\-./ ]?\d{1,3}")
_CHOSEN = re.compile(r"(?i)pass|pwd|kennwort|wachtwoord|contrasena|senha|cred")
_FORMS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "k_live_", "k_test_", "AKIA", "ASIA", "AIza", "xox", "npm_", "hf_", "SG.", "_live_", "_pat_", "_prod_", "_key_", "_secret_", "ptk-", "eyJ")
_PIECE = re.compile(_LIT)
#: A member of a list: a literal, or what stands between two.
_MEMBER = re.compile(r"\s*(?:(?:#|//)[^\n]*\n\s*)*(?:(?P<lit>" + _LIT + r")|(?P<sign>[+,]))")


def per_subword(v: str, enc) -> float:
    """Characters that a subword covers."""
    return len(v) / max(1, len(enc.encode_ordinary(v)))


def _random(v: str, enc, least: int = 8) -> bool:
    """Unnatural, long enough, and not a word, a path or a number."""
    if len(v) < least or not re.search(r"[A-Za-z]", v):
        return False
    return per_subword(v, enc) <= UNNATURAL


def _granting(v: str, enc, name: str) -> bool:
    """A value that, bound to a credential's name, would grant access. Subwords judge every value but a number."""
    if PLACEHOLDER.match(v) or re.search(r"\s", v) or len(v) < 5 or v.startswith(("/", "./", "../")) or "://" in v:
        return False
    if _NAMING.fullmatch(v) or re.fullmatch(r"[A-Za-z]+(?:[_\-./][A-Za-z]+)*", v) and not _random(v, enc, 10):
        return False  # another name, not a value
    if re.fullmatch(r"[\d.,:]+", v):
        return len(re.sub(r"\D", "", v)) >= 6
    if _NUMBERED.fullmatch(v) and not _CHOSEN.search(name):
        return _random(v, enc, 10) and per_subword(v, enc) <= UNNATURAL - 0.6  # an item's id
    return bool(re.search(r"\d|[^\w\s\-./]", v)) and per_subword(v, enc) <= UNNATURAL_NAMED or _random(v, enc)


def _row(text: str, at: int) -> list[list[re.Match]]:
    """The literals of the list whose inside begins at `at`, those joined by a plus together."""
    out: list[list[re.Match]] = []
    plus = False
    while m := _MEMBER.match(text, at):
        if m["lit"]:
            lit = _PIECE.match(text, m.start("lit"))
            if plus and out:
                out[-1].append(lit)
            else:
                out.append([lit])
            plus = False
        else:
            plus = m["sign"] == "+"
        at = m.end()
    return out


def _joined(raw: str) -> str:
    """The text that a row of literals spells."""
    return "".join(x[1:-1] for x in _PIECE.findall(raw))


def _short_named(text: str) -> bool:
    """Whether one of the two short words is bound to a value or stands in a comment, all that patterns match."""
    for m in _SHORT.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if _BOUND.match(text, m.start()) or "//" in line or any(c in line for c in "#;*"):
            return True
    return False


def spans(text: str, enc) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential's value, in order; what overlaps is one."""
    if not text:
        return []
    hits: list[tuple[int, int, str]] = []
    add = lambda a, b, kind: hits.append((a, b, kind))
    low = text.casefold().replace("\u0131", "i")  # what (?i) takes as equal
    if any(w in low for w in _ROOTS) or ("pat" in low or "pass" in low) and _short_named(text):
        for m in NAMED.finditer(text):
            raw, a = m["v"], m.start("v")
            pieces = list(_PIECE.finditer(raw))
            if m["arg"] and not m["q"]:
                continue
            if m["open"] == "[" and m["op"] != "==" and not _JOIN.match(text, a + len(raw)):
                for group in _row(text, a):  # every member is a value of its own
                    if _granting("".join(x[0][1:-1] for x in group), enc, m["name"]):
                        add(group[0].start() + 1, group[-1].end() - 1, "named")
                continue
            if len(pieces) > 1 and "+" not in raw[pieces[0].end() : pieces[1].start()] and m["open"] != "[":
                pieces = pieces[:1]
                raw = pieces[0][0]
            if m["op"] and m["op"] == "==" and not _random(_joined(raw), enc):
                continue
            if _granting(_joined(raw), enc, m["name"]):
                add(a + pieces[0].start() + 1, a + pieces[-1].end() - 1, "named")
        for m in BARE.finditer(text):
            if _granting(m["v"], enc, m["name"]):
                add(*m.span("v"), "setting")
        for m in TOLD.finditer(text):
            v = m["v"].rstrip(".,;)")
            if not PLACEHOLDER.match(v) and "(" not in v and re.search(r"\d|[^\w\-./]", v) and (_random(v, enc) or _granting(v, enc, m["name"]) and re.search(r"\d", v)):
                add(m.start("v"), m.start("v") + len(v), "comment")
        for m in NOTED.finditer(text):
            why, v = m["why"], m["v"][1:-1]
            name = _NAMING.search(why)
            if name and not _DENIED.search(why) and len(why) < 80 and _granting(v, enc, name[0]):
                add(m.start("v") + 1, m.end("v") - 1, "noted")
    if any(w in low for w in ("authorization", "x-auth", "api-key", "private-token", "x-access", "cookie")):
        for m in HEADER.finditer(text):
            v = m["v"]
            if not PLACEHOLDER.match(v) and (_random(v, enc) or KNOWN.search(v)):
                add(*m.span("v"), "header")
    if "bearer " in low or "token " in low:
        for m in SCHEME.finditer(text):
            if not PLACEHOLDER.match(m["v"]) and re.search(r"\d", m["v"]) and _random(m["v"], enc):
                add(*m.span("v"), "header")
    if "basic" in low:
        for m in BASIC.finditer(text):
            try:
                plain = base64.b64decode(m["v"], validate=True)
            except (binascii.Error, ValueError):
                continue
            if b":" in plain and plain.isascii() and plain.decode().isprintable() and not PLACEHOLDER.match(plain.decode().partition(":")[2]):
                add(*m.span("v"), "basic")
    if "://" in text:
        for m in LOGIN_URL.finditer(text):
            g = "v" if m["v"] is not None else "u"
            v = m[g]
            if v and not PLACEHOLDER.match(v) and (g == "v" or _random(v, enc, 16)):
                add(*m.span(g), "address")
        for m in HOOK.finditer(text):
            last = max(m["v"].split("/"), key=len)
            if len(last) >= 16 and _random(last, enc):
                add(*m.span("v"), "address")
    if any(w in low for w in ("sig=", "signature=", "sign=", "token=", "key=", "auth=", "secret=", "password=", "passwd=", "pwd=")):
        whole = "://" in text
        for m in QUERY.finditer(text):
            # Without an address in the text, the value must not be an expression of code.
            if not PLACEHOLDER.match(m["v"]) and _random(m["v"], enc) and (whole or re.fullmatch(r"[\w%~+/=\-]+", m["v"]) and re.search(r"\d", m["v"])):
                add(*m.span("v"), "address")
    if any(w in low for w in ("login", "log_in", "sign_in", "signin", "authenticate", "credentials", "basic_auth", "set_password", "unlock_with")):
        for m in CALL.finditer(text):
            if _granting(m["v"][1:-1], enc, "password"):
                add(m.start("v") + 1, m.end("v") - 1, "call")
    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            end = text.find("-----END", m.end())
            add(m.start(), m.end() if end < 0 or end - m.end() > 80 else end, "private-key")
    for m in KNOWN.finditer(text) if any(w in text for w in _FORMS) else ():
        if not PLACEHOLDER.match(m[0]) and re.search(r"\d", m[0]) and per_subword(m[0], enc) <= UNNATURAL + 0.6:
            add(*m.span(), "known-form")
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str]] = []
    for h in hits:
        if out and h[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], h[1]), out[-1][2])  # one value, seen by two rules
        else:
            out.append(h)
    return out


_KEEP = re.compile(r"-----BEGIN [A-Z0-9 ]*-----|\\n|\\r|\s|[\"'+,]")


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every value overwritten by as many asterisks; line ends, quotes and joins inside
    a value that is written in pieces stay, so the text parses as before."""
    parts, at = [], 0
    for a, b, kind in found:
        parts.append(text[at:a])
        v = text[a:b]
        if kind == "private-key" or ("\n" in v or '"' in v or "'" in v):
            i, buf = 0, []
            while i < len(v):
                k = _KEEP.match(v, i)
                buf.append(k[0] if k else "*")
                i = k.end() if k else i + 1
            parts.append("".join(buf))
        else:
            parts.append("*" * len(v))
        at = b
    parts.append(text[at:])
    return "".join(parts)


def _scanner(at: str, what: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.byte_bpe(at)
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["staged_path"], pdf["text"]):
                found = spans(text, enc) if isinstance(text, str) else []
                if what == "hits":
                    seen, line = 0, 1
                    for a, b, kind in found:
                        line += text.count("\n", seen, a)
                        seen = a
                        rows.append((path, line, a - (text.rfind("\n", 0, a) + 1) + 1, b - a, kind, round(per_subword(text[a:b], enc), 3)))
                elif found:
                    rows.append((path, redact(text, found), len(found)))
            yield pd.DataFrame(rows, columns=_HITS if what == "hits" else _RED)

    return run


_HITS = ["staged_path", "line_no", "col_no", "length", "kind", "chars_per_subword"]
_RED = ["staged_path", "text", "credentials"]


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Place, length, kind and characters per subword of every credential."""
    src = spread(table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null"))
    out = src.mapInPandas(_scanner(tokens.folder(spark), "hits"), "staged_path string, line_no long, col_no long, length long, kind string, chars_per_subword double")
    return out.distinct()


def found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a credential begins."""
    return hits(spark, d).select("staged_path", "line_no").distinct()


def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text that holds a credential, with the values blacked out, and how many there were."""
    src = spread(table(spark, d, "staged_files", "staged_path", "text").where("staged_path is not null and text is not null"))
    return src.mapInPandas(_scanner(tokens.folder(spark), "text"), "staged_path string, text string, credentials int").distinct()


def report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: credentials, files, and how many of the lines the old scanner had listed."""
    h = hits(spark, d)
    old = (
        table(spark, d, "project_audits", "secret_hits")
        .select(F.explode("secret_hits").alias("s"))
        .select(F.col("s.path").alias("original_path"), F.col("s.line").cast("long").alias("line_no"))
        .distinct()
    )
    r = table(spark, d, "records", "staged_path", "original_path").distinct()
    listed = old.join(r, "original_path").select("staged_path", "line_no").distinct().withColumn("listed", F.lit(1))
    return (
        h.join(listed, ["staged_path", "line_no"], "left")
        .groupBy("kind")
        .agg(F.count("*").alias("credentials"), F.countDistinct("staged_path").alias("files"), F.count("listed").alias("listed_before"))
    )


QUERIES = {"p2_found": found, "p2_hits": hits, "p2_redacted": redacted, "p2_report": report}
SQL: dict[str, str] = {}
