"""Configuration files: sections of multi-valued settings, with conditional includes, on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable

from strataquill.functions.globs import wildmatch

_ESCAPES = {"n": "\n", "t": "\t", "b": "\b", '"': '"', "\\": "\\"}


def _value(text: str) -> str:
    out, quoted, i, tail = "", False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            if text[i + 1] not in _ESCAPES:
                raise ValueError(f"escape \\{text[i + 1]}")
            out += _ESCAPES[text[i + 1]]
            i += 1
            tail = len(out)
        elif c == '"':
            quoted = not quoted
            tail = len(out)
        elif c in "#;" and not quoted:
            break
        else:
            out += c
            tail = len(out) if quoted or not c.isspace() else tail
        i += 1
    if quoted:
        raise ValueError("quote is not closed")
    return out[:tail]


def parse(text: str, read: Callable[[str], str] | None = None, condition: Callable[[str], bool] = lambda _: False, depth: int = 0) -> list[tuple[tuple[str, ...], str, str]]:
    """(section, name, value) settings in order; ``read`` gives the text of included files, ``condition`` decides on conditional ones."""
    if depth > 10:
        raise ValueError("includes go too deep")
    out: list[tuple[tuple[str, ...], str, str]] = []
    section: tuple[str, ...] = ()
    lines = iter(re.sub(r"\\\r?\n", "", text).splitlines())
    for raw in lines:
        line = raw.strip().lstrip("﻿")
        if m := re.match(r'\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\](.*)$', line):
            section = (m[1].lower(),) if m[2] is None else (m[1].lower(), re.sub(r"\\(.)", r"\1", m[2]))
            line = m[3].strip()
        if not line or line[0] in "#;":
            continue
        m = re.match(r"([A-Za-z][A-Za-z0-9-]*)\s*(=?)\s*(.*)$", line)
        if not m or not section:
            raise ValueError(f"cannot read {raw!r}")
        name, value = m[1].lower(), _value(m[3]) if m[2] else "true"
        out.append((section, name, value))
        if name == "path" and read and (section == ("include",) or (section[0] == "includeif" and len(section) > 1 and condition(section[1]))):
            out += parse(read(value), read, condition, depth + 1)
    return out


def get(settings: list[tuple[tuple[str, ...], str, str]], section: tuple[str, ...], name: str) -> str | None:
    """The last value of a setting."""
    found = [v for s, n, v in settings if s == section and n == name.lower()]
    return found[-1] if found else None


def matches_glob(value: str, pattern: str) -> bool:
    """Whether a value matches a condition's glob."""
    return re.match(wildmatch(pattern + "**" if pattern.endswith("/") else pattern), value) is not None
