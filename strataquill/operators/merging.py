"""Merges of commits: trees by rule, contents line by line, several bases, several heads, and replayed series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions import diffs
from strataquill.functions import objects as O
from strataquill.operators import trees
from strataquill.plans.lineage import Materialised

#: A function from base, ours and theirs (text columns) to a struct (text, conflict).
MergeDriver = Callable[[Column, Column, Column], Column]


def union_driver(base: Column, ours: Column, theirs: Column) -> Column:
    """Both sides' lines where they conflict, without marks."""
    text = F.regexp_replace(diffs.merge_texts(base, ours, theirs)["text"], r"(?m)^(<<<<<<< ours|=======|>>>>>>> theirs)\n", "")
    return F.struct(text.alias("text"), F.lit(False).alias("conflict"))


def ours_driver(base: Column, ours: Column, theirs: Column) -> Column:
    return F.struct(ours.alias("text"), F.lit(False).alias("conflict"))


DRIVERS: dict[str, MergeDriver] = {"text": diffs.merge_texts, "union": union_driver, "ours": ours_driver}


def register_driver(name: str, driver: MergeDriver) -> None:
    """Make a merge driver known under the name that attributes use."""
    DRIVERS[name] = driver


def merge_files(base: DataFrame, ours: DataFrame, theirs: DataFrame, blobs: DataFrame, driver: str = "text") -> tuple[DataFrame, DataFrame]:
    """((path, oid, mode, conflict) of the merged snapshot, (oid, data) of the blobs it adds).

    Only contents that both sides changed are read and merged; where there are none, no blobs are read. Blobs move once to their ids and the
    contents found once to their paths.
    """
    keep = Materialised(base.sparkSession, "merge")
    verdict = keep(trees.merge3_sides(base, ours, theirs))
    rest = verdict.where("outcome <> 'merge'").select("path", "oid", "mode", (F.col("outcome") == "conflict").alias("conflict"))
    wanted = verdict.where("outcome = 'merge'")
    if wanted.isEmpty():
        return rest, rest.where("false").select("oid", F.lit(None).cast("string").alias("data"))  # the optimiser takes it out of unions
    sides = ("base", "ours", "theirs")
    ids = wanted.select("path", "mode", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_oid").alias("oid")) for s in sides])).alias("x")).select("path", "mode", "x.*").where("oid is not null")
    found = ids.join(blobs.select("oid", "data"), "oid", "left")
    both = found.groupBy("path", "mode").agg(*[F.coalesce(F.first(F.when(F.col("side") == s, F.col("data")), ignorenulls=True), F.lit("")).alias(s) for s in sides])
    merged = both.select("path", "mode", DRIVERS[driver](*map(F.col, sides)).alias("m")).select("path", "mode", F.col("m.text").alias("data"), F.col("m.conflict").alias("conflict"))
    merged = keep(merged.withColumn("oid", O.blob_id(F.col("data"))))
    return rest.unionByName(merged.select("path", "oid", "mode", "conflict")), merged.select("oid", "data").dropDuplicates(["oid"])


def recursive_merge(bases: list[DataFrame], ours: DataFrame, theirs: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A merge whose several bases are first merged with each other, without an ancestor of their own."""
    base, known = bases[0], blobs
    nothing = base.limit(0)
    for other in bases[1:]:
        merged, new = merge_files(nothing, base, other, known)
        base, known = merged.where("oid is not null").select("path", "oid", "mode"), known.unionByName(new)
    return merge_files(base, ours, theirs, known)


def octopus_merge(base: DataFrame, heads: list[DataFrame], blobs: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """(snapshot, new blobs, number of the first conflicting head or None): heads are merged one after another into the first."""
    now, known = heads[0], blobs
    for i, head in enumerate(heads[1:], 1):
        merged, new = merge_files(base, now, head, known)
        known = known.unionByName(new)
        if merged.where("conflict").take(1):
            return merged, known, i
        now = merged.select("path", "oid", "mode")
    return now.withColumn("conflict", F.lit(False)), known, None


def replay(onto: DataFrame, series: list[tuple[DataFrame, DataFrame]], blobs: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """(snapshot, blobs, number of the first conflicting step or None): each step (snapshot before, snapshot after) is applied to what is there so far."""
    now, known = onto, blobs
    for i, (before, after) in enumerate(series):
        merged, new = merge_files(before, now, after, known)
        known = known.unionByName(new)
        if merged.where("conflict").take(1):
            return merged, known, i
        now = merged.select("path", "oid", "mode")
    return now.withColumn("conflict", F.lit(False)), known, None
