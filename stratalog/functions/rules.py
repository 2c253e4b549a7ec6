"""Row-wise statement of the template rules, for the sequential parse and for tests."""

from __future__ import annotations

import re

from .templates import DELIMITERS, MOST_WILDCARDS
from .text import WILD

_PARTS = re.compile(f"([^{DELIMITERS}]+|[{DELIMITERS}])")
_W = r"<\*>"


def _stable(t: str, old: str, new: str) -> str:
    while old in t:
        t = t.replace(old, new)
    return t


def corrected(template: str) -> str:
    def token(x: str) -> str:
        if x.isdecimal() or re.match("0x[0-9a-fA-F]+", x):
            return WILD
        x = _stable(x, "0x<*>", WILD)
        return WILD if re.fullmatch(rf"[^\s/]+{_W}[^\s/]+", x) else x

    t = "".join(map(token, _PARTS.findall(" ".join(template.split()))))
    t = re.sub(rf"({_W})[^()\[\]{{}},.:<>#$/\"'\s]*", r"\1", t)
    for chain in (".", ""):
        t = _stable(t, f"{WILD}{chain}{WILD}", WILD)
    t = _stable(_stable(t, " #<*># ", " <*> "), " #<*> ", " <*> ")
    for chain in (":", "#", "/", "@", "."):
        t = _stable(t, f"{WILD}{chain}{WILD}", WILD)
    t = _stable(_stable(t, '"<*>"', WILD), "'<*>'", WILD)
    t = _stable(t, "<*><*>", WILD)
    t = _stable(t, "( <*>, <*>)", "(<*>, <*>)").replace("`", "")
    t = _stable(_stable(t, " <*>. ", " <*> "), " <*>, ", " <*> ")
    t = _stable(_stable(t, "<*>+<*>", WILD), "<*>##<*>", WILD)
    t = _stable(_stable(t, "#<*>#", WILD), "<*>-<*>", WILD)
    t = _stable(t, " <*> <*> ", " <*> ")
    if t.endswith(" <*> <*>"):
        t = re.sub(r"(?: <\*>){2,}$", " <*>", t)
    t = re.sub(r"^<\*> (?:<\*> )+", "<*> ", t)
    t = _stable(t, "<*>,<*>", WILD)
    t = _stable(t, "(<*> <*>)", "(<*>)")
    t = re.sub(r" /<\*>(?= |$)", " <*>", t)
    return t.replace("= ", "=<*> ") if t.count("=<*>") >= 3 else t


def post_processed(template: str) -> tuple[str, bool]:
    t = corrected(re.sub(r"\{[A-Za-z0-9_\-]+\}", WILD, template))
    if not re.sub(r"[\s!-/:-@\[-`{-~]", "", t.replace(WILD, "")):
        return "", False
    return t, True


def valid(template: str) -> bool:
    return bool(template) and template.count(WILD) <= MOST_WILDCARDS


def matcher(template: str) -> re.Pattern:
    return re.compile(".*".join(map(re.escape, template.split(WILD))) + r"\Z")


def jaccard(a: str, b: str, smooth: float = 0.0) -> float:
    x, y = set(a.split()), set(b.split())
    return (len(x & y) + smooth) / (len(x | y) + smooth) if x | y else 0.0


def merged(new: str, known: str) -> str | None:
    """As the Column of the same name."""
    if new == known:
        return new
    a, b = new.split(" "), known.split(" ")
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    if len(a) != len(b) or not (len(differ) <= 1 or (len(differ) == 2 and len(a) > 10)):
        return None
    if not any(WILD in (x, y) for x, y in differ):
        return None
    out, _ = post_processed(" ".join(WILD if x != y and WILD in (x, y) else x for x, y in zip(a, b)))
    ok = valid(out) and matcher(out).match(new) and matcher(out).match(known)
    return out if ok else None


def lcs(a: list[str], b: list[str]) -> list[str]:
    """Longest common subsequence; ties go left."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif size[i - 1][j] > size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def lcs_run(a: list[str], b: list[str]) -> list[str]:
    """Longest common run of words; the first of equals."""
    best, at, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                if new[j] > best:
                    best, at = new[j], i
        row = new
    return a[at - best : at]


def lcs_lengths(a: list[str], b: list[str]) -> tuple[int, int]:
    """Words in the longest common subsequence, and in the longest common run."""
    return len(lcs(a, b)), len(lcs_run(a, b))


def most_tries(logs: list[str], assigned: int = 3) -> int:
    """How often to ask again: once for one log of up to five words, or where no log has more
    than two; else as assigned."""
    sizes = [len(x.split(" ")) for x in logs or ()]
    if not sizes or not ((len(sizes) == 1 and sizes[0] <= 5) or max(sizes) <= 2):
        return assigned
    return 1
