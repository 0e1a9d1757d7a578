"""Connected components as DataFrame joins (alternating large-star and small-star passes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm._store import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    ``edges`` has columns u and v of one orderable type. Each pass groups by node with a partial minimum and
    joins the minimum back. Minima are written before they are joined, so that both sides of the join are plain shuffles and the
    hot side of a node with very many edges is split over tasks. A pass's edges are written to the shared folder and the pass before it is deleted.
    """
    now = scratch.write(edges.where("u is not null and v is not null and u <> v").distinct(), "cc0", "snappy")
    last = None
    for i in range(1, most + 1):
        wide = _both(now)
        low = scratch.write(wide.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"low{i}", "snappy")
        large = wide.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = scratch.write(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"down{i}", "snappy")
        low = scratch.write(down.groupBy("u").agg(F.min("v").alias("m")), f"least{i}", "snappy")
        small = down.join(low, "u").select(F.col("v").alias("a"), "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.write(small, f"cc{i}", "snappy")
        for done in (f"cc{i - 1}", f"low{i}", f"down{i}", f"least{i}"):
            scratch.drop(done)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == (seen.n, seen.h):
            break
        last = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle within {most} passes")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
