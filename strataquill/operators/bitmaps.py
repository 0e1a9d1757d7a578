"""Reachability as bitmaps over object positions, in buckets of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.operators import graph
from strataquill.plans.closure import closure
from strataquill.plans.ranking import numbered

#: Positions of one bucket.
BUCKET = 32768


def positions(objects: DataFrame) -> DataFrame:
    """``objects`` (oid, …) with pos: the rank of the id, from 0, found by counting ids in ranges of their first characters."""
    ranged = objects.withColumn("sq_range", F.substring("oid", 1, 3))
    before = ranged.groupBy("sq_range").agg(F.count("*").alias("n"))
    before = before.select("sq_range", (F.sum("n").over(Window.orderBy("sq_range")) - F.col("n")).alias("before"))  # at most 4096 rows
    rank = F.row_number().over(Window.partitionBy("sq_range").orderBy("oid")) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(before), "sq_range").withColumn("pos", F.col("before") + F.col("rank")).drop("sq_range", "rank", "before")


def build(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, bucket, bits) of rows (*keys, pos)."""
    placed = rows.select(*keys, F.floor(F.col("pos") / BUCKET).cast("long").alias("bucket"), (F.col("pos") % BUCKET).alias("p"))
    return placed.groupBy(*keys, "bucket").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))


def type_bitmaps(objects: DataFrame) -> DataFrame:
    """(type, bucket, bits) of objects (oid, type)."""
    return build(positions(objects), "type")


def reachability_bitmaps(edges: DataFrame, selected: DataFrame, placed: DataFrame) -> DataFrame:
    """(commit, bucket, bits): positions that each selected commit (commit) reaches over the unified edges."""
    reach = closure(edges, selected.select("commit", F.col("commit").alias("node")), keys=("commit",))
    return build(reach.join(placed.select(F.col("oid").alias("node"), "pos"), "node"), "commit")


def select_commits(parents: DataFrame, tips: DataFrame, interval: int = 100) -> DataFrame:
    """(commit): tips and every ``interval``-th commit by distance from them."""
    reach = graph.ancestors(parents, tips)
    return numbered(reach, "depth", "node", name="n").where((F.col("n") % interval == 0) | (F.col("depth") == 0)).select(F.col("node").alias("commit"))


def union(bitmaps: DataFrame) -> DataFrame:
    """(bucket, bits) of several bitmaps together."""
    return bitmaps.groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def intersection(bitmaps: DataFrame, key: str) -> DataFrame:
    """(bucket, bits) that all bitmaps share; a bucket that one of them lacks is empty."""
    n = bitmaps.select(key).distinct()
    grouped = bitmaps.groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("have"))
    return grouped.join(n.agg(F.count("*").alias("all"))).where("have = all").select("bucket", "bits")


def members(bitmaps: DataFrame) -> DataFrame:
    """(bucket, pos): set positions of (bucket, bits)."""
    byte = F.posexplode(F.split(F.regexp_replace(F.hex("bits"), "(..)(?!$)", "$1,"), ","))
    each = bitmaps.select("bucket", byte.alias("at", "hex")).where("hex <> '00'").withColumn("b", F.conv("hex", 16, 10).cast("int"))
    bits = each.select("bucket", "at", "b", F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("i")).where("shiftright(b, i) % 2 = 1")
    return bits.select("bucket", (F.col("bucket") * BUCKET + F.col("at") * 8 + F.col("i")).cast("long").alias("pos"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, pos) in ``a`` and not in ``b``."""
    return members(a).join(members(b), ["bucket", "pos"], "left_anti")


def combine(bitmaps: DataFrame, include: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(pos) reached from ``include`` and not from ``exclude`` (commit), from stored bitmaps (commit, bucket, bits)."""
    yes = union(bitmaps.join(include.select("commit"), "commit", "left_semi"))
    if exclude is None:
        return members(yes).select("pos")
    return difference(yes, union(bitmaps.join(exclude.select("commit"), "commit", "left_semi"))).select("pos")


def counts(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n): number of set positions."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.expr("bitmap_count(bits)")).cast("long").alias("n"))
