"""Line diffs: unified output, parsing, application, three-way merge, attribution and assignment of patches.

Plain functions over lists of lines, used behind pandas UDFs.
"""

from __future__ import annotations

import bisect
import difflib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from strataquill.functions._udf import vectorised

Opcode = tuple[str, int, int, int, int]


def lines_of(text: str) -> list[str]:
    """Lines with their line feeds; no other character ends a line."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def opcodes(a: list[str], b: list[str], algorithm: str = "myers") -> list[Opcode]:
    """Edit operations (tag, a start, a end, b start, b end) that turn a into b; patience anchors on lines unique to both sides."""
    if algorithm == "patience":
        out: list[Opcode] = []
        i = j = 0
        for x, y in [*_anchors(a, b), (len(a), len(b))]:
            out += [(t, p + i, q + i, r + j, s + j) for t, p, q, r, s in difflib.SequenceMatcher(None, a[i:x], b[j:y], False).get_opcodes()]
            if x < len(a):
                out.append(("equal", x, x + 1, y, y + 1))
            i, j = x + 1, y + 1
        return _joined(out)
    n, m = len(a), len(b)
    if n and m and (at := _place(a, b) if n <= m else _place(b, a)) is not None:  # the longest match is the whole of one side
        ops = [("insert", 0, 0, 0, at), ("equal", 0, n, at, at + n), ("insert", n, n, at + n, m)] if n <= m else [("delete", 0, at, 0, 0), ("equal", at, at + m, 0, m), ("delete", at + m, n, m, m)]
        return [o for o in ops if o[1] < o[2] or o[3] < o[4]]
    return difflib.SequenceMatcher(None, a, b, False).get_opcodes()


def _place(part: list[str], whole: list[str]) -> int | None:
    """Where ``part`` first stands in one piece in ``whole``."""
    at, last = 0, len(whole) - len(part)
    while at <= last:
        try:
            at = whole.index(part[0], at, last + 1)
        except ValueError:
            return None
        if whole[at : at + len(part)] == part:
            return at
        at += 1
    return None


def _joined(ops: list[Opcode]) -> list[Opcode]:
    out: list[Opcode] = []
    for op in ops:
        if out and out[-1][0] == op[0] == "equal" and out[-1][2] == op[1] and out[-1][4] == op[3]:
            out[-1] = ("equal", out[-1][1], op[2], out[-1][3], op[4])
        else:
            out.append(op)
    return out


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest increasing chain of lines that occur once on either side."""
    once = lambda xs: {x: i for i, x in enumerate(xs) if xs.count(x) == 1} if len(xs) < 200 else {x: i for x, (i, n) in _counted(xs).items() if n == 1}
    ua, ub = once(a), once(b)
    pairs = sorted((i, ub[x]) for x, i in ua.items() if x in ub)
    tails: list[int] = []
    back: list[int | None] = []
    ends: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        back.append(ends[k - 1] if k else None)
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else None
    while n is not None:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _counted(xs: list[str]) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for i, x in enumerate(xs):
        out[x] = (i, out.get(x, (0, 0))[1] + 1)
    return out


def unified(a: list[str], b: list[str], old: str = "a", new: str = "b", context: int = 3, algorithm: str = "myers") -> str:
    """Unified diff of two lists of lines with terminators; empty if they are equal."""
    groups: list[list[Opcode]] = []
    ops = opcodes(a, b, algorithm)
    if all(o[0] == "equal" for o in ops):
        return ""
    now: list[Opcode] = []
    for t, i, j, k, m in ops:
        if t == "equal":
            if not now and not groups:
                now.append((t, max(i, j - context), j, max(k, m - context), m))
            elif j - i > 2 * context:
                now.append((t, i, i + context, k, k + context))
                groups.append(now)
                now = [(t, j - context, j, m - context, m)]
            else:
                now.append((t, i, j, k, m))
        else:
            now.append((t, i, j, k, m))
    if any(o[0] != "equal" for o in now):
        if now[-1][0] == "equal":
            t, i, j, k, m = now[-1]
            now[-1] = (t, i, min(j, i + context), k, min(m, k + context))
        groups.append(now)
    out = [f"--- {old}\n", f"+++ {new}\n"]
    for g in groups:
        i, j, k, m = g[0][1], g[-1][2], g[0][3], g[-1][4]
        place = lambda s, e: f"{s + 1 if e > s else s}" + ("" if e - s == 1 else f",{e - s}")
        out.append(f"@@ -{place(i, j)} +{place(k, m)} @@\n")
        for t, p, q, r, s in g:
            rows = [(" ", x) for x in a[p:q]] if t == "equal" else [*(("-", x) for x in a[p:q]), *(("+", x) for x in b[r:s])]
            for sign, line in rows:
                out.append(sign + line if line.endswith("\n") else f"{sign}{line}\n\\ No newline at end of file\n")
    return "".join(out)


@dataclass
class Hunk:
    old_start: int
    new_start: int
    lines: list[str] = field(default_factory=list)


@dataclass
class FilePatch:
    old_path: str | None
    new_path: str | None
    hunks: list[Hunk] = field(default_factory=list)
    binary: bool = False


def parse_unified(text: str) -> list[FilePatch]:
    """Files and hunks of a unified diff."""
    out: list[FilePatch] = []
    need_old = need_new = 0
    for line in lines_of(text):
        if need_old > 0 or need_new > 0:
            if line[:1] in " -+":
                need_old -= line[0] != "+"
                need_new -= line[0] != "-"
                out[-1].hunks[-1].lines.append(line)
                continue
            if line.strip() == "":
                need_old, need_new = need_old - 1, need_new - 1
                out[-1].hunks[-1].lines.append(" " + line)
                continue
        if m := re.match(r"diff --git a/(.*) b/(.*)\n?$", line):
            out.append(FilePatch(m[1], m[2]))
        elif line.startswith("Binary files") and out:
            out[-1].binary = True
        elif line.startswith("--- "):
            path = line[4:].split("\t")[0].strip()
            if not out or out[-1].hunks:
                out.append(FilePatch(None, None))
            out[-1].old_path = None if path == "/dev/null" else path.removeprefix("a/")
        elif line.startswith("+++ ") and out:
            path = line[4:].split("\t")[0].strip()
            out[-1].new_path = None if path == "/dev/null" else path.removeprefix("b/")
        elif (m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)) and out:
            out[-1].hunks.append(Hunk(int(m[1]), int(m[3])))
            need_old, need_new = int(m[2] or 1), int(m[4] or 1)
        elif line.startswith("\\") and out and out[-1].hunks:
            last = out[-1].hunks[-1].lines
            last[-1] = last[-1].rstrip("\n")
    return out


def apply_hunks(patch: FilePatch, lines: list[str]) -> list[str]:
    """The patched lines; ValueError if a hunk's context is nowhere near its place."""
    out, at = [], 0
    for hunk in patch.hunks:
        before = [x[1:] for x in hunk.lines if x[0] != "+"]
        after = [x[1:] for x in hunk.lines if x[0] != "-"]
        want = max(at, hunk.old_start - (1 if before else 0))
        for start in sorted(range(at, len(lines) - len(before) + 1), key=lambda s: abs(s - want)):
            if lines[start : start + len(before)] == before:
                break
        else:
            raise ValueError(f"hunk at line {hunk.old_start} does not apply")
        out += lines[at:start] + after
        at = start + len(before)
    return out + lines[at:]


def merge3(base: list[str], ours: list[str], theirs: list[str], names: tuple[str, str] = ("ours", "theirs")) -> tuple[list[str], bool]:
    """(merged lines, whether there is a conflict) of two derivations of ``base``."""
    def changed(side: list[str]) -> list[tuple[int, int, int, int]]:
        return [(i, j, k, m) for t, i, j, k, m in opcodes(base, side) if t != "equal"]

    a, b = changed(ours), changed(theirs)
    out, at, conflict = [], 0, False
    while a or b:
        start = min(x[0][0] for x in (a, b) if x)
        end, grown, mine, other = start, True, [], []
        while grown:  # take in whatever touches the region
            grown = False
            for queue, taken in ((a, mine), (b, other)):
                while queue and (queue[0][0] < end or queue[0][0] == start or (queue[0][0] == end and (mine or other) and queue[0][0] == queue[0][1])):
                    taken.append(queue.pop(0))
                    end, grown = max(end, taken[-1][1]), True

        def text(side: list[str], taken: list[tuple[int, int, int, int]]) -> list[str]:
            if not taken:
                return base[start:end]
            lead, tail = taken[0][0] - start, end - taken[-1][1]
            return side[taken[0][2] - lead : taken[-1][3] + tail]

        out += base[at:start]
        x, y = text(ours, mine), text(theirs, other)
        if x == y or not other:
            out += x
        elif not mine:
            out += y
        else:
            conflict = True
            closed = lambda z: [*z[:-1], z[-1] if z[-1].endswith("\n") else z[-1] + "\n"] if z else z
            out += [f"<<<<<<< {names[0]}\n", *closed(x), "=======\n", *closed(y), f">>>>>>> {names[1]}\n"]
        at = end
    return out + base[at:], conflict


def reattribute(known: list[tuple[str, object]], lines: list[str], commit: object) -> list[tuple[str, object]]:
    """Lines with the commit that last changed them, after one more revision."""
    out: list[tuple[str, object]] = []
    for t, i, j, k, m in opcodes([x for x, _ in known], lines):
        out += known[i:j] if t == "equal" else [(x, commit) for x in lines[k:m]]
    return out


def diff_size(a: str, b: str) -> int:
    """Number of lines of the diff of two texts."""
    return len(lines_of(unified(lines_of(a), lines_of(b))))


@vectorised("long")
def diff_sizes(a: pd.Series, b: pd.Series) -> pd.Series:
    """diff_size of two text columns."""
    return pd.Series([diff_size(x, y) for x, y in zip(a, b)], dtype="int64")


def assign_patches(old: list[str], new: list[str], creation_factor: int = 60) -> list[tuple[int | None, int | None]]:
    """Least-cost pairs of two lists of patches; None stands for a patch without partner, whose cost is a share of its size."""
    n, m = len(old), len(new)
    if not n and not m:
        return []
    size = lambda p: p.count("\n") * creation_factor // 100
    cost = np.zeros((n + m, n + m))
    for i in range(n):
        for j in range(m):
            cost[i, j] = diff_size(old[i], new[j])
        cost[i, m:] = size(old[i])
    for j in range(m):
        cost[n:, j] = size(new[j])
    pick = hungarian(cost)
    return [(i if i < n else None, j if j < m else None) for i, j in enumerate(pick) if i < n or j < m]


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in a least-cost assignment of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while row_of[j]:
            used[j] = True
            free = ~used
            free[0] = False
            now = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = free[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j
            nxt = int(np.where(free, least, np.inf).argmin())
            step = least[nxt]
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            j = nxt
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


@vectorised("string")
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unified diff of two text columns."""
    return pd.Series([unified(lines_of(x or ""), lines_of(y or "")) for x, y in zip(a, b)])


@vectorised("struct<text:string, conflict:boolean>")
def merge_texts(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    """Three-way merge of text columns with conflict marks."""
    rows = [merge3(*(lines_of(t or "") for t in x)) for x in zip(base, ours, theirs)]
    return pd.DataFrame({"text": ["".join(x) for x, _ in rows], "conflict": [c for _, c in rows]})


@vectorised("string")
def patched(text: pd.Series, patch: pd.Series) -> pd.Series:
    """Each text after its patch of one file; a patch without hunks leaves it."""

    def one(t: str, p: str) -> str:
        found = parse_unified(p)
        return "".join(apply_hunks(found[0], lines_of(t))) if found else t

    return pd.Series([None if t is None or p is None else one(t, p) for t, p in zip(text, patch)])
