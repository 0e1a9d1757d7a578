"""Filters of partial transfers, as predicates over objects (oid, type, size, depth, path)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.operators.matching import sparse_included

_SCALE = {"": 1, "k": 1024, "m": 1024**2, "g": 1024**3}


@dataclass(frozen=True)
class ObjectFilter:
    """A predicate and whether it needs paths."""

    spec: str
    predicate: Callable[[], Column]
    needs_path: bool = False


def blob_none() -> ObjectFilter:
    return ObjectFilter("blob:none", lambda: F.col("type") != "blob")


def blob_limit(limit: int) -> ObjectFilter:
    """Keeps blobs of at most ``limit`` bytes."""
    return ObjectFilter(f"blob:limit={limit}", lambda: (F.col("type") != "blob") | (F.col("size") <= limit))


def tree_depth(depth: int) -> ObjectFilter:
    """Keeps trees down to ``depth`` and blobs above it; a root tree has depth 0."""
    return ObjectFilter(f"tree:{depth}", lambda: ~F.col("type").isin("tree", "blob") | ((F.col("type") == "tree") & (F.col("depth") <= depth)) | ((F.col("type") == "blob") & (F.col("depth") < depth)))


def sparse(lines: list[str], name: str = "sparse") -> ObjectFilter:
    """Keeps blobs at paths that sparse rules include; trees are all kept."""
    return ObjectFilter(f"sparse:oid={name}", lambda: (F.col("type") != "blob") | sparse_included(F.col("path"), lines), True)


def combine(filters: list[ObjectFilter]) -> ObjectFilter:
    return ObjectFilter("combine:" + "+".join(f.spec for f in filters), lambda: reduce(lambda a, b: a & b, [f.predicate() for f in filters]), any(f.needs_path for f in filters))


def parse(spec: str, rules: Callable[[str], list[str]] | None = None) -> ObjectFilter:
    """The filter of ``blob:none``, ``blob:limit=<n>[kmg]``, ``tree:<d>``, ``sparse:oid=<id>`` or ``combine:<a>+<b>``; ``rules`` reads a sparse blob."""
    if spec == "blob:none":
        return blob_none()
    if m := re.fullmatch(r"blob:limit=(\d+)([kmg]?)", spec, re.I):
        return blob_limit(int(m[1]) * _SCALE[m[2].lower()])
    if m := re.fullmatch(r"tree:(\d+)", spec):
        return tree_depth(int(m[1]))
    if (m := re.fullmatch(r"sparse:oid=(.+)", spec)) and rules:
        return sparse(rules(m[1]), m[1])
    if spec.startswith("combine:"):
        parts = spec.removeprefix("combine:").split("+")
        if all(parts):
            return combine([parse(p, rules) for p in parts])
    raise ValueError(f"not a filter: {spec!r}")


def apply(objects: DataFrame, found: ObjectFilter) -> DataFrame:
    """Rows of ``objects`` that pass; one without paths or depths is judged as if it stood at the root."""
    if "depth" not in objects.columns:
        objects = objects.withColumn("depth", F.lit(0))
    if found.needs_path and "path" not in objects.columns:
        objects = objects.withColumn("path", F.lit(""))
    return objects.where(found.predicate())


def apply_with_paths(objects: DataFrame, found: ObjectFilter) -> DataFrame:
    """Distinct ids (oid, type) of which any place passes."""
    return apply(objects, found).select("oid", "type").distinct()
