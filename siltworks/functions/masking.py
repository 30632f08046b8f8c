"""Plain secret patterns and masking, written so that Java's and RE2's regular expressions agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the plain scan, by kind.
KINDS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "openai_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "generic_secret_assignment": r"(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|password)\b\s*[:=]\s*[\"']?[A-Za-z0-9_\-/.+=]{16,}",
}
#: Masking steps in order; groups 1 and 2 stay. A quoted value is one step for each quote, since
#: not every engine has back-references.
MASKS = [
    r"()\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}()",
    r"()\bAKIA[0-9A-Z]{16}\b()",
    r"()-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----(?s:.*?)-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----()",
    r"()-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----()",
    r'(?i)(\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|token|password)\b\s*[:=]\s*)"[^\s,;"' + r"']{8,}" + '"()',
    r"(?i)(\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|token|password)\b\s*[:=]\s*)'[^\s,;\"']{8,}'()",
    r"(?i)(\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|token|password)\b\s*[:=]\s*)[^\s,;\"']{8,}()",
    r"(?i)(authorization\s*:\s*bearer\s+)[A-Za-z0-9._~+\-/=]{8,}()",
    r"()\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})\b()",
    r"()\beyJ[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}(?:\.[A-Za-z0-9_=-]{8,})?()",
    r"(?i)(\b[a-z][a-z0-9+.-]*://[^:\s/@]+:)[^@\s/]+(@)",
]


#: What every text that a step changes has in it; the others need not go through the steps.
NEEDED = r"sk-|AKIA|PRIVATE KEY-----|(?i:api[_-]?key|secret[_-]?key|token|password|bearer)|gh[pousr]_|github_pat_|eyJ|://[^\s/@]*:"


def masked(t: Column) -> Column:
    for p in MASKS:
        t = F.regexp_replace(t, p, "$1[REDACTED]$2")
    return t


def masked_sql(c: str) -> str:
    for p in MASKS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '\\1[REDACTED]\\2', 'g')"
    return c
