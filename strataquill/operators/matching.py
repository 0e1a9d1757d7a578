"""Rule files over paths: ignore, attributes and sparse rules, where the last matching rule decides.

A rule file is small and known on the driver, so it becomes one column expression per path: no join, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions.globs import Rule, parse_rules, wildmatch


def last_match(path: Column, rules: list[Rule], is_dir: Column | bool = False) -> Column:
    """Number of the last rule that matches a path itself, else null."""
    is_dir = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    hits = [F.when(path.rlike(r.regex) & (is_dir if r.dir_only else F.lit(True)), F.lit(i)) for i, r in enumerate(rules)]
    return F.coalesce(*reversed(hits)) if hits else F.lit(None).cast("int")


def _verdict(index: Column, rules: list[Rule]) -> Column:
    """True if the rule excludes, false if it is negated, null without a rule."""
    return F.get(F.array(*[F.lit(not r.negated) for r in rules]), index) if rules else F.lit(None).cast("boolean")


def is_ignored(path: Column, lines: list[str], is_dir: Column | bool = False) -> Column:
    """True, false (re-included) or null (no rule): a folder that is excluded excludes all below it, whatever later rules say."""
    rules = parse_rules(lines)
    whole = F.regexp_replace(path, "/+$", "")
    folders = F.filter(O.ancestors_of_path(whole), lambda p: (p != whole) & (p != ""))
    above = F.exists(folders, lambda p: F.coalesce(_verdict(last_match(p, rules, True), rules), F.lit(False)))
    folder = path.endswith("/") | (F.lit(is_dir) if isinstance(is_dir, bool) else is_dir)
    return F.when(above, F.lit(True)).otherwise(_verdict(last_match(whole, rules, folder), rules))


def is_ignored_by(path: Column, files: dict[str, list[str]], is_dir: Column | bool = False) -> Column:
    """As is_ignored with rule files of several folders ('' is the root): rules of the deepest folder go first.

    Every folder above the path is judged by the files above that folder; once one is excluded, no deeper rule brings back what lies below.
    """
    order = [(f, parse_rules(files[f])) for f in sorted(files, key=lambda f: f.count("/") + bool(f))]

    def verdict(p: Column, folder: Column | bool) -> Column:
        out = F.lit(None).cast("boolean")
        for top, rules in order:
            below = F.substr(p, F.lit(len(top) + 2)) if top else p
            out = F.coalesce(F.when(p.startswith(top + "/") if top else F.lit(True), _verdict(last_match(below, rules, folder), rules)), out)
        return out

    whole = F.regexp_replace(path, "/+$", "")
    folders = F.filter(O.ancestors_of_path(whole), lambda p: (p != whole) & (p != ""))
    above = F.exists(folders, lambda p: F.coalesce(verdict(p, True), F.lit(False)))
    folder = path.endswith("/") | (F.lit(is_dir) if isinstance(is_dir, bool) else is_dir)
    return F.when(above, F.lit(True)).otherwise(verdict(whole, folder))


def parse_attributes(lines: list[str]) -> list[tuple[str, dict[str, str | None]]]:
    """(pattern, values by name) of an attributes file: 'true', 'false', a text, or None for 'unspecified'."""
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        pattern, *words = text.split()
        values: dict[str, str | None] = {}
        for w in words:
            if w == "binary":
                values |= {"binary": "true", "diff": "false", "merge": "false", "text": "false"}
            elif w[0] == "-":
                values[w[1:]] = "false"
            elif w[0] == "!":
                values[w[1:]] = None
            else:
                name, _, value = w.partition("=")
                values[name] = value if "=" in w else "true"
        out.append((pattern, values))
    return out


def attributes(path: Column, lines: list[str]) -> Column:
    """Map of a path's attributes: later rules override by name, an unspecified value takes the name away."""
    parsed = parse_attributes(lines)
    names = sorted({n for _, v in parsed for n in v})
    hit = [path.rlike(wildmatch(p.lstrip("/") if "/" in p else f"**/{p}")) for p, _ in parsed]
    pairs = []
    for n in names:
        value: Column = F.lit(None).cast("string")
        for h, (_, v) in zip(hit, parsed):
            if n in v:
                value = F.when(h, F.lit(v[n])).otherwise(value)
        pairs.append(F.struct(F.lit(n).alias("key"), value.alias("value")))
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))


def _matcher(rule: Rule):
    return lambda p: p.rlike(rule.regex)


def sparse_included(path: Column, lines: list[str]) -> Column:
    """Full-pattern sparse rules: the last rule that matches a path or a folder above it includes it, or excludes it if negated; without one it is out."""
    rules = parse_rules(lines)
    folders = F.filter(O.ancestors_of_path(path), lambda p: (p != path) & (p != ""))
    best: Column = F.lit(-1)
    for i, r in enumerate(rules):
        own = F.lit(False) if r.dir_only else path.rlike(r.regex)
        hit = own | F.exists(folders, _matcher(r))
        best = F.when(hit, F.lit(i)).otherwise(best)
    return F.coalesce(F.get(F.array(*[F.lit(not r.negated) for r in rules]), best), F.lit(False)) if rules else F.lit(False)


def cone_included(path: Column, lines: list[str]) -> Column:
    """Cone rules: files at the top if ``/*`` stands there; others if nothing excludes folders or they lie below a listed one."""
    text = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
    top, closed = "/*" in text, "!/*/" in text
    dirs = [x.strip("/") for x in text if x.startswith("/") and x not in ("/*",) and not x.startswith("!") and x.strip("/*")]
    below = reduce(lambda a, b: a | b, [path.startswith(d + "/") for d in dirs], F.lit(False))
    return F.when(~path.contains("/"), F.lit(top)).otherwise(below | F.lit(not closed))


def included_paths(index: DataFrame, lines: list[str], cone: bool = False) -> DataFrame:
    """Rows of ``index`` (path, …) that sparse rules include."""
    return index.where((cone_included if cone else sparse_included)(F.col("path"), lines))


def skip_worktree(index: DataFrame, lines: list[str], cone: bool = False) -> DataFrame:
    """``index`` with the flag of paths that a sparse checkout leaves out."""
    return index.withColumn("skip_worktree", ~(cone_included if cone else sparse_included)(F.col("path"), lines))
