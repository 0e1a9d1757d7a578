"""Revision expressions, parsed on the driver into plans.

``rev~n``, ``rev^n``, ``rev^{}``, ``rev^{type}``, ``rev@{n}``, ``rev@{time}``, ``rev:path``, ``a..b``, short ids and abbreviated refs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions.dates import approxidate
from strataquill.functions.refs import candidates
from strataquill.operators import graph, refs, store, trees


@dataclass
class Repository:
    """Tables of one repository; what an expression does not ask for may be left out."""

    objects: DataFrame
    parents: DataFrame
    refs: DataFrame
    tags: DataFrame | None = None
    commits: DataFrame | None = None
    tree_entries: DataFrame | None = None
    reflog: DataFrame | None = None
    index: DataFrame | None = None


class RevisionError(ValueError):
    """An expression that names nothing, or too much."""


_SUFFIX = re.compile(r"~(\d*)|\^\{([a-z]*)\}|\^(\d*)|@\{([^}]*)\}")


def split(spec: str) -> tuple[str, list[tuple[str, str]], str | None]:
    """(base, suffix operations, path) of an expression."""
    path = None
    if m := re.match(r"((?:[^:{]|\{[^}]*\})+):(.*)$", spec):  # a colon in braces belongs to a time
        spec, path = m[1], m[2]
    at = min([i for i in (spec.find("~"), spec.find("^"), spec.find("@{")) if i >= 0], default=len(spec))
    base, rest, ops = spec[:at], spec[at:], []
    while rest:
        m = _SUFFIX.match(rest)
        if not m:
            raise RevisionError(f"cannot read {rest!r}")
        ops.append(("~", m[1] or "1") if m[1] is not None else ("{}", m[2]) if m[2] is not None else ("^", m[3] or "1") if m[3] is not None else ("@", m[4]))
        rest = rest[m.end() :]
    return base, ops, path


def _one(df: DataFrame, what: str):
    found = [r[0] for r in df.select(df.columns[0]).distinct().limit(2).collect()]
    if len(found) != 1:
        raise RevisionError(f"{what} {'is ambiguous' if found else 'names nothing'}")
    return found[0]


def base_id(repo: Repository, name: str, kind: str | None = None):
    """The id of a full id, a ref (abbreviated or not) or a unique short id."""
    name = name or "HEAD"
    hit = refs.lookup(refs.resolve(repo.refs) if "symref" in repo.refs.columns else repo.refs, name).collect()
    if hit:
        return hit[0]["oid"]
    column = dict(repo.objects.dtypes)["oid"]
    if column != "string":
        return _one(repo.objects.where(F.col("oid") == int(name)).select("oid"), name) if name.isdigit() else _one(repo.objects.limit(0).select("oid"), name)
    if re.fullmatch(r"[0-9a-f]{4,64}", name):
        return _one(store.prefix(repo.objects, name, kind).select("oid"), name)
    raise RevisionError(f"{name} names nothing (tried {', '.join(candidates(name))})")


def parent(repo: Repository, oid, n: int):
    return _one(repo.parents.where((F.col("commit") == oid) & (F.col("parent_no") == n)).select("parent"), f"parent {n} of {oid}")


def peel(repo: Repository, oid):
    """``oid`` behind any tags."""
    if repo.tags is None:
        return oid
    spark = repo.objects.sparkSession
    return _one(graph.peel(repo.tags, spark.createDataFrame([(oid,)], f"oid {dict(repo.objects.dtypes)['oid']}")).select("peeled"), str(oid))


def resolve(repo: Repository, spec: str):
    """The id that an expression names."""
    if m := re.match(r"^:(?:([0-3]):)?(.+)$", spec):
        return _one(repo.index.where((F.col("path") == m[2]) & (F.col("stage") == int(m[1] or 0))).select("oid"), spec)
    base, ops, path = split(spec)
    if ops and ops[0][0] == "@":
        oid = _from_log(repo, base or "HEAD", ops[0][1])
        ops = ops[1:]
    else:
        oid = base_id(repo, base)
    for op, arg in ops:
        if op == "{}":
            oid = peel(repo, oid)
        elif op == "^":
            oid = peel(repo, oid) if arg == "0" else parent(repo, peel(repo, oid), int(arg))
        elif op == "~":
            oid = peel(repo, oid)
            for _ in range(int(arg)):
                oid = parent(repo, oid, 1)
        else:
            raise RevisionError(f"@{{{arg}}} may only follow a ref")
    return oid if path is None else _at_path(repo, peel(repo, oid), path)


def _from_log(repo: Repository, name: str, arg: str):
    names = [n for n in candidates(name) if repo.reflog.where(F.col("ref") == n).take(1)]
    if not names:
        raise RevisionError(f"no log of {name}")
    log = repo.reflog.where(F.col("ref") == names[0])
    if arg.isdigit():
        return _one(refs.at_index(log, int(arg)).select("new"), f"{name}@{{{arg}}}")
    probe = log.sparkSession.createDataFrame([(names[0], approxidate(arg))], "ref string, at long")
    return _one(refs.at_time(log, probe).select("oid"), f"{name}@{{{arg}}}")


def _at_path(repo: Repository, commit, path: str):
    """The id at a path of a commit's tree, one join for each part of the path."""
    tree = _one(repo.commits.where(F.col("commit") == commit).select("tree"), str(commit))
    for part in [p for p in path.split("/") if p]:
        tree = _one(repo.tree_entries.where((F.col("tree") == tree) & (F.col("name") == part)).select("oid"), path)
    return tree


def flatten(repo: Repository, spec: str) -> DataFrame:
    """Files of the tree that an expression names."""
    oid = _at_path(repo, resolve(repo, spec), "")
    return trees.flatten(repo.tree_entries, repo.objects.sparkSession.createDataFrame([(oid,)], "root string"))


def commit_range(repo: Repository, spec: str) -> DataFrame:
    """(node): commits of ``a..b`` (behind b and not behind a), or of one expression's whole history."""
    kind = dict(repo.objects.dtypes)["oid"]
    frame = lambda oid: repo.objects.sparkSession.createDataFrame([(oid,)], f"node {kind}")
    old, dots, new = spec.partition("..")
    if not dots:
        return graph.walk(repo.parents, frame(resolve(repo, spec)))
    return graph.walk(repo.parents, frame(resolve(repo, new or "HEAD")), frame(resolve(repo, old or "HEAD")))


def parse_refspec(spec: str, force: bool = False) -> tuple[str | None, str | None, bool]:
    """(source, destination, force) of ``[+]source:destination``."""
    if spec.startswith("+"):
        spec, force = spec[1:], True
    source, colon, target = spec.partition(":")
    return source or None, (target if colon else source) or None, force
