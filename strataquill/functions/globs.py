"""Glob patterns as regular expressions, compiled once on the driver and matched in the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}"}


def _literal(c: str) -> str:
    return "\\" + c if c in r".^$+?()[]{}|\*" else c


def _bracket(pattern: str, at: int) -> tuple[str, int] | None:
    """(regular expression, index behind it) of a bracket expression that starts at ``at``; None if it isn't closed."""
    i, out = at + 1, ""
    negated = i < len(pattern) and pattern[i] in "!^"
    i += negated
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return ("[^/" if negated else "[") + out + "]", i + 1
        m = re.match(r"\[:(\w+):\]", pattern[i:])
        if m and m[1] in _POSIX:
            out += _POSIX[m[1]]
            i += len(m[0])
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out += "\\" + c if c in "[]\\^&" else c
            i += 1
        first = False
    return None


def wildmatch(pattern: str, paths: bool = True) -> str:
    """The anchored regular expression of a glob. With ``paths``, ``*`` and ``?`` stop at slashes and ``**`` spans folders."""
    out, i = "", 0
    one, many = ("[^/]", "[^/]*") if paths else (".", ".*")
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            j = i
            while j < len(pattern) and pattern[j] == "*":
                j += 1
            whole = j - i == 2 and (i == 0 or pattern[i - 1] == "/")
            if paths and whole and j < len(pattern) and pattern[j] == "/":
                out, i = out + "(?:.*/)?", j + 1
            elif paths and whole and j == len(pattern):
                out, i = out + ".*", j
            else:
                out, i = out + many, j
        elif c == "?":
            out, i = out + one, i + 1
        elif c == "[" and (found := _bracket(pattern, i)):
            out, i = out + found[0], found[1]
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + _literal(pattern[i + 1]), i + 2
        else:
            out, i = out + _literal(c), i + 1
    return f"^(?s:{out})$"


def segments(pattern: str) -> str:
    """A glob of ref segments: a name may go on below the pattern, never stop above it."""
    return wildmatch(pattern)[:-1] + "(?:/.*)?$"


@dataclass(frozen=True)
class Rule:
    """One line of an ignore or sparse file: number, regular expression over full paths, negation, folders only."""

    line: int
    regex: str
    negated: bool
    dir_only: bool
    anchored: bool
    pattern: str


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules of an ignore file: comments and blank lines dropped, trailing blanks unless escaped, ``!``, leading and trailing slash."""
    out = []
    for no, raw in enumerate(lines):
        line = raw.rstrip("\r\n")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        text = line[1:] if negated else line[1:] if line.startswith(("\\#", "\\!")) else line
        dir_only = text.endswith("/")
        text = text.rstrip("/") if dir_only else text
        anchored = "/" in text
        body = text.lstrip("/") if anchored else text
        if not body:
            body = "*" if text.startswith("/") or dir_only else body
        regex = wildmatch(body if anchored else f"**/{body}")
        out.append(Rule(no, regex, negated, dir_only, anchored, line))
    return out
