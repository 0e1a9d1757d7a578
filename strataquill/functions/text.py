"""Lines, white space, trailers and conflict texts."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions._udf import vectorised


def split_lines(text: Column) -> Column:
    """Array of lines with their terminators; no empty last line."""
    return F.regexp_extract_all(text, F.lit("([^\n]*\n|[^\n]+)"), F.lit(1))


def blocks(text: Column) -> Column:
    """Array of blocks: lines, of which those of over 64 bytes are cut every 64. Each character of a block stands for one byte of the UTF-8 text."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit("([^\n]{0,63}\n|[^\n]{1,64})"), F.lit(1))


def lf_to_crlf(text: Column) -> Column:
    """Line feeds as carriage return and line feed; those that are so already stay."""
    return F.regexp_replace(text, "(?<!\r)\n", "\r\n")


def crlf_to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def strip_space(text: Column, comment: str | None = None) -> Column:
    """No trailing blanks, no blank lines at either end, runs of blank lines as one, a final line feed; comment lines dropped if asked."""
    out = text
    if comment:
        out = F.regexp_replace(out, rf"(?m)^{re.escape(comment)}[^\n]*(\n|\z)", "")
    out = F.regexp_replace(out, r"[ \t\r\x0b\x0c]+(?=\n|\z)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\A\n+|\n+\z", ""), r"\n{3,}", "\n\n")
    return F.when(out == "", "").otherwise(F.concat(out, F.lit("\n")))


def summary_slug(message: Column) -> Column:
    """First line of a message as a part of a file name."""
    first = F.substring_index(message, "\n", 1)
    return F.replace(first, F.lit(" "), F.lit("-"))


#: All kinds of white space errors.
WHITESPACE_RULES = ("trailing-space", "space-before-tab", "indent-with-non-tab", "tab-in-indent", "cr-at-eol")


def whitespace_errors(lines: DataFrame, text: str = "line", tab_width: int = 8, rules: tuple[str, ...] = ("trailing-space", "space-before-tab", "indent-with-non-tab", "cr-at-eol")) -> DataFrame:
    """``lines`` with one row for each error (column error) of the kinds asked for."""
    line = F.col(text)
    body = F.regexp_replace(line, "\r?\n$", "")
    tests = {
        "trailing-space": body.rlike(r"[ \t]+\r?$"),
        "space-before-tab": body.rlike(r"^\t* +\t"),
        "indent-with-non-tab": body.rlike(rf"^[ \t]* {{{tab_width},}}"),
        "tab-in-indent": body.rlike(r"^ *\t"),
        "cr-at-eol": line.rlike("\r\n?$"),
    }
    found = F.filter(F.array(*[F.when(tests[n], F.lit(n)) for n in rules]), lambda x: x.isNotNull())
    return lines.select("*", F.explode(found).alias("error"))


def fix_whitespace(text: Column, tab_width: int = 8) -> Column:
    """Trailing blanks dropped, blanks before indenting tabs dropped, carriage returns at line ends dropped."""
    out = F.regexp_replace(text, r"\r(?=\n|\z)", "")
    out = F.regexp_replace(out, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(out, r"(?m)^(\t*) +(?=\t)", "$1")


# Trailers --------------------------------------------------------------------------------------------------

_TRAILER = re.compile(r"^([A-Za-z0-9][A-Za-z0-9-]*)\s*([:=#])\s*(.*)$")


def _end(lines: list[str]) -> int:
    """Number of lines before the last one that starts with three dashes."""
    return next((i for i in range(len(lines) - 1, -1, -1) if lines[i].lstrip().startswith("---")), len(lines))


def split_trailers(message: str, separators: str = ":") -> tuple[str, list[tuple[str, str, str]]]:
    """(body, [(key, value, separator)]): trailers are the last paragraph if every line is one or continues one.

    The last line that starts with ``---`` ends the message: what follows it is no part of either.
    """
    lines = message.split("\n")
    end = _end(lines)
    while end and not lines[end - 1].strip():
        end -= 1
    start = end
    while start and lines[start - 1].strip():
        start -= 1
    if start == 0 or start == end:
        return message, []
    found: list[tuple[str, str, str]] = []
    for line in lines[start:end]:
        m = _TRAILER.match(line)
        if m and m[2] in separators:
            found.append((m[1], m[3].strip(), m[2]))
        elif line[:1] in " \t" and found:
            k, v, s = found[-1]
            found[-1] = (k, f"{v} {line.strip()}", s)
        else:
            return message, []
    return "\n".join(lines[:start]).rstrip("\n") + "\n", found


def join_trailers(trailers: list[tuple[str, str, str]]) -> str:
    return "".join(f"{k}{s} {v}\n" for k, v, s in trailers)


def with_trailer(message: str, key: str, value: str, where: str = "end", if_exists: str = "addIfDifferentNeighbor", if_missing: str = "add") -> str:
    """The message with a trailer put in by the rules that ``where``, ``if_exists`` and ``if_missing`` name; what follows a line of dashes stays behind it."""
    lines = message.split("\n")
    rest = "\n".join(lines[_end(lines) :])
    body, found = split_trailers(message)
    if rest and not found:
        body = "\n".join(lines[: _end(lines)])
    same = [i for i, t in enumerate(found) if t[0].lower() == key.lower()]
    new = (key, value, ":")
    if same:
        if if_exists == "doNothing" or (if_exists == "addIfDifferent" and any(found[i][1] == value for i in same)):
            return message
        at_end = where in ("end", "after")
        if if_exists == "addIfDifferentNeighbor":
            near = (found[-1] if where == "end" else found[0] if where == "start" else found[same[-1 if at_end else 0]])
            if near[0].lower() == key.lower() and near[1] == value:
                return message
        if if_exists == "replace":
            gone = same[-1 if at_end else 0]
            found.pop(gone)
            found.insert(gone if where in ("after", "before") else len(found) if at_end else 0, new)
        elif where == "after":
            found.insert(same[-1] + 1, new)
        elif where == "before":
            found.insert(same[0], new)
        else:
            found.insert(len(found) if at_end else 0, new)
    elif if_missing == "doNothing":
        return message
    else:
        found.insert(len(found) if where in ("end", "after") else 0, new)
    return body.rstrip("\n") + "\n\n" + join_trailers(found) + rest


@vectorised("struct<body:string, trailers:array<struct<key:string, value:string, separator:string>>>")
def parse_trailers(message: pd.Series) -> pd.DataFrame:
    """Body and trailers of each message."""
    rows = [split_trailers(m or "") for m in message]
    return pd.DataFrame({"body": [b for b, _ in rows], "trailers": [[{"key": k, "value": v, "separator": s} for k, v, s in t] for _, t in rows]})


def add_trailer(message: Column, key: str, value: str, where: str = "end", if_exists: str = "addIfDifferentNeighbor", if_missing: str = "add") -> Column:
    @vectorised("string")
    def run(m: pd.Series) -> pd.Series:
        return m.map(lambda x: None if x is None else with_trailer(x, key, value, where, if_exists, if_missing))

    return run(message)


# Conflicts -------------------------------------------------------------------------------------------------


def normalise_conflict(text: str) -> str:
    """Conflict hunks with bare markers and their sides in order, so that the same conflict has one text."""
    out, ours, theirs, side = [], [], [], None
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if line.startswith("<<<<<<<"):
            ours, theirs, side = [], [], "ours"
        elif line.startswith("|||||||") and side:
            side = "base"
        elif line.startswith("=======") and side:
            side = "theirs"
        elif line.startswith(">>>>>>>") and side:
            a, b = sorted(["".join(ours), "".join(theirs)])
            out += ["<<<<<<<\n", a, "=======\n", b, ">>>>>>>\n"]
            side = None
        elif side == "ours":
            ours.append(line)
        elif side == "theirs":
            theirs.append(line)
        elif side is None:
            out.append(line)
    return "".join(out)


@vectorised("string")
def conflict_id(text: pd.Series) -> pd.Series:
    """SHA-1 of the normalised conflict; the key that resolutions are joined by."""
    return text.map(lambda t: None if t is None else hashlib.sha1(normalise_conflict(t).encode()).hexdigest())
