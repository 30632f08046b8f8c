"""Scripts, completions and prompts, text by text: what needs a state machine or a walk over lines."""

from __future__ import annotations

import re

import numpy as np

from siltworks.functions.grams import SPECIAL, byte_ids
from siltworks.functions.scan import function_blocks, strip_comments

FUNC = re.compile(r"(?:static\s+)?func\s+[A-Za-z_]\w*\s*\(.*\)\s*(?:->\s*[^:]+)?\s*:\s*(?:#.*)?$")
#: Bytes beyond which a script is large, and beyond which it isn't trained on.
LARGE, OVERSIZED = 96 * 1024, 4 * 1024 * 1024


def static_warnings(text: str) -> list[tuple[str, int | None]]:
    """(code, line) of what a scan can tell of a script without parsing it."""
    out: list[tuple[str, int | None]] = []
    lines = text.split("\n")
    if "�" in text:
        out.append(("encoding_replacement", None))
    if any(x.startswith(("<<<<<<<", "=======", ">>>>>>>")) for x in lines):
        out.append(("merge_markers", None))
    if any(x.strip() == "..." for x in lines):
        out.append(("ellipsis_placeholder", None))
    mixed = next((i for i, x in enumerate(lines, 1) if {" ", "\t"} <= set(x[: len(x) - len(x.lstrip(" \t"))])), None)
    if mixed:
        out.append(("mixed_leading_indentation", mixed))
    code = strip_comments(text, mask=True)
    fault = first_unpaired(code)
    if fault:
        out.append(fault)
        if fault[0] == "unbalanced_delimiter":
            return out
    names = re.findall(r"(?m)^func\s+([A-Za-z_]\w*)\s*\(", code)
    if any(names.count(n) > 1 for n in set(names) - {"_init"}):
        out.append(("duplicate_top_level_function_name", None))
    size = len(text.encode("utf-8", "replace"))
    if size > LARGE:
        out.append(("oversized_training_file" if size > OVERSIZED else "very_large_script", None))
    return out


def first_unpaired(code: str) -> tuple[str, int] | None:
    """The first closing bracket without its partner, else the last opening one that stays open."""
    partner, open_at, line = {")": "(", "]": "[", "}": "{"}, [], 1
    for m in re.finditer(r"[()\[\]{}\n]", code):
        c = m[0]
        if c == "\n":
            line += 1
        elif c in "([{":
            open_at.append((c, line))
        elif not open_at or open_at.pop()[0] != partner[c]:
            return "unbalanced_delimiter", line
    return ("unclosed_delimiter", open_at[-1][1]) if open_at else None


def cut_repetition(text: str, longest: int = 64) -> str:
    """The text up to the first block that repeats itself at once, longest blocks first; a single line must
    come three times, a comment twice. Lines are numbered by their content and compared as arrays."""
    lines = text.split("\n")
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(x, len(known)) for x in lines])
    n = len(ids)
    for size in range(min(n // 2, longest), 1, -1):
        same = np.concatenate([[0], np.cumsum(ids[:-size] == ids[size:])])
        runs = np.flatnonzero(same[size:] - same[:-size] == size)
        if len(runs):
            return "\n".join(lines[: int(runs[0]) + size])
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    for a, b in zip(edges, edges[1:]):
        x = lines[a]
        if x.strip() and b - a >= (2 if x.startswith("#") else 3):
            return "\n".join(lines[: int(a) + 1])
    return text


def last_function(text: str, most: int) -> tuple[str, str, int] | None:
    """(prompt, completion, tokens): the text cut after the header of the last function whose rest has an
    indented line and 8 to `most` byte tokens."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True)
    for i in reversed(range(len(lines))):
        if FUNC.match(lines[i].rstrip("\n")):
            rest = lines[i + 1 :]
            n = len(byte_ids("".join(rest)))
            if 8 <= n <= most and any(x.strip() and (x[0] == "\t" or x.startswith("    ")) for x in rest):
                return "".join(lines[: i + 1]), "".join(rest), n
    return None


def _outside_long_strings(text: str) -> str:
    """The text with everything in triple quotes as blanks, place by place."""
    return re.sub(r"\"{3}[\s\S]*?(?:\"{3}|\Z)|'{3}[\s\S]*?(?:'{3}|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def mutations(text: str) -> list[tuple[str, str]]:
    """(kind, text) of variants that mean the same: a comment ahead, the last function renamed, and a parameter
    more that nothing uses."""
    out = [("comment", "# verify: rephrased prompt\n" + text)]
    heads = list(re.finditer(r"(?m)^[ \t]*func[ \t]+([A-Za-z_]\w*)", _outside_long_strings(text)))
    if heads:
        a, b = heads[-1].span(1)
        first, *more = text[a:b].split("_")
        out.append(("rename", text[:a] + first + "".join(x[:1].upper() + x[1:] for x in more) + "Impl" + text[b:]))
        opened = text.find("(", b)
        level = 0
        for m in re.finditer(r"[()]", text[opened:]) if opened >= 0 else ():
            level += 1 if m[0] == "(" else -1
            if not level:
                at = opened + m.start()
                out.append(("parameter", text[:at] + (", " if text[opened + 1 : at].strip() else "") + "_unused: int = 0" + text[at:]))
                break
    return out


def decoded_bytes(ids: list[int], skip: bool = False) -> str:
    """The text of byte token ids; bytes that are no UTF-8 are replaced, an id out of range is an error."""
    out, held = [], bytearray()
    for i in ids:
        if not 0 <= i < len(SPECIAL) + 256:
            raise ValueError(f"{i} is no token")
        if i >= len(SPECIAL):
            held.append(i - len(SPECIAL))
        else:
            out.append(held.decode("utf-8", "replace"))
            held.clear()
            out.append("" if skip else SPECIAL[i])
    return "".join(out) + held.decode("utf-8", "replace")


def composed(parts: list[tuple[str, str, bool]], window: int) -> list[tuple[str, str, int, int]]:
    """parts(name, text, fixed) -> (name, text kept, tokens, tokens dropped): what a window of byte tokens, less
    one for the beginning, leaves of each part. The last flexible part loses its tail first; a cut falls
    between characters. ValueError where the fixed parts fill the window."""
    size = lambda x: len(x.encode("utf-8", "replace"))
    room = window - 1
    if sum(size(t) for _, t, fixed in parts if fixed) >= room:
        raise ValueError("the fixed parts fill the window")
    over = max(0, sum(size(t) for _, t, _ in parts) - room)
    kept = {}
    for k in reversed(range(len(parts))):
        _, t, fixed = parts[k]
        if over and not fixed:
            t = t.encode("utf-8", "replace")[: max(0, size(t) - over)].decode("utf-8", "ignore")
            over = max(0, over - (size(parts[k][1]) - size(t)))
        kept[k] = t
    return [(n, kept[k], size(kept[k]), size(t) - size(kept[k])) for k, (n, t, _) in enumerate(parts)]


def frames(buffer: str, chunk: str) -> tuple[list[str], str]:
    """(payloads, rest) of a stream of `data: ` lines that comes in pieces cut anywhere."""
    *lines, rest = (buffer + chunk).split("\n")
    got = [x[6:].strip() for x in lines if x.startswith("data: ")]
    return [x for x in got if x != "[DONE]"], rest


def blocks(text: str) -> list[str]:
    return [c for _, c in function_blocks(text)]
