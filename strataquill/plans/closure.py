"""Reachability and longest paths as semi-naive fixpoints of joins.

``closure`` writes the edges once. While the frontier is small it is broadcast and meets them level by level where they lie; a larger one is
joined with them, and a round then unrolls some expansions in one plan before it materialises the nodes it found, so a graph of depth d costs
about d / STRIDE jobs instead of d. Only the newest frontier meets the edges. ``longest`` gives each node its depth once, when all
its predecessors have theirs. Where a graph turns out to be deep, runs of nodes with one predecessor and one successor are
contracted to single weighted edges by pointer doubling, so that a run of length n costs about log n joins of its own rows. No depth is cut off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.plans.lineage import Materialised

STRIDE = 4
#: Rows up to which a frontier is broadcast, so that no level moves the edges.
NEAR = 100_000
#: Depth from which runs are contracted, in closures (of several levels a round) and in longest paths (of one).
DEEP, LEVELS = 32, 20
FOLD = 32


def _contracted(edges: DataFrame, stay: DataFrame, keep: Materialised) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, w) without inner nodes, inner nodes (node, top, back) with the node that their run starts behind, and how far).

    A node is inner if it has one edge in, one out and is not in ``stay`` (node). Runs that close on themselves can't be reached and are left out.
    """
    plain = keep(edges.select("src", "dst", F.lit(1).alias("w")))
    ends = plain.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(plain.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    inner = keep(ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").join(stay.select("node"), "node", "left_anti").select("node"))
    back = plain.join(inner.select(F.col("node").alias("dst")), "dst").select(F.col("dst").alias("node"), F.col("src").alias("top"), F.col("w").alias("back"))
    back = keep(back.join(inner.select(F.col("node").alias("top"), F.lit(True).alias("open")), "top", "left").select("node", "top", "back", F.coalesce("open", F.lit(False)).alias("open")))
    left, done = back.where("open"), [back.where("not open")]
    before = None
    while True:
        n = left.count()
        if n == 0 or n == before and not done[-1].take(1):
            break
        before = n
        # Pointers of all inner nodes are at the same distance or have arrived, so each turn doubles the distance.
        known = reduce(DataFrame.unionByName, [*done, left]).select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("back").alias("back2"), F.col("open").alias("open2"))
        left = keep(left.drop("open").join(known, "top").select("node", F.col("top2").alias("top"), (F.col("back") + F.col("back2")).alias("back"), F.col("open2").alias("open")))
        done.append(left.where("not open"))
        left = left.where("open")
    runs = keep(reduce(DataFrame.unionByName, done).select("node", "top", "back"))
    outer = plain.join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    first = outer.join(runs.select(F.col("node").alias("src"), "top", "back"), "src", "left")
    closed = inner.join(runs.select("node"), "node", "left_anti").select(F.col("node").alias("src"))
    return keep(first.join(closed, "src", "left_anti").select(F.coalesce("top", "src").alias("src"), "dst", (F.col("w") + F.coalesce("back", F.lit(0))).alias("w"))), runs


def closure(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None, max_depth: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, node, depth): every node that ``edges`` (src, dst) lead to from ``seeds`` (*keys, node), with its least depth.

    Nodes in ``stop`` (node) are neither entered nor expanded; ``max_depth`` bounds the number of edges. With ``keys`` each
    key has a closure of its own. Cycles are harmless.
    """
    spark = seeds.sparkSession
    keep = Materialised(spark, "closure")
    edges = keep(edges.select("src", "dst", F.lit(1).alias("w")))
    if stop is not None:
        stop = keep(stop.select("node").distinct())
    by = [*keys, "node"]
    start = seeds.select(*by).distinct().withColumn("depth", F.lit(0))
    if stop is not None:
        start = start.join(stop, "node", "left_anti").select(*by, "depth")
    seen = keep(start)
    frontier, depth = seen, 0
    n = frontier.count()
    parts, runs = [seen], None
    bound = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    while max_depth is None or depth < max_depth:
        if runs is None and depth >= DEEP:
            stay = frontier.select("node") if stop is None else frontier.select("node").unionByName(stop)
            edges, runs = _contracted(edges.distinct(), stay, keep)
        step = 1 if n <= NEAR else STRIDE
        levels, last = [], F.broadcast(frontier) if step == 1 else frontier
        for _ in range(step if max_depth is None or runs is not None else min(step, max_depth - depth)):
            last = last.join(edges, last["node"] == edges["src"]).select(*keys, F.col("dst").alias("node"), (F.col("depth") + F.col("w")).alias("depth")).where(bound)
            last = last.distinct() if runs is None else last.groupBy(*by).agg(F.min("depth").alias("depth"))
            if stop is not None:
                last = last.join(stop, "node", "left_anti").select(*by, "depth")
            levels.append(last)
        found = reduce(DataFrame.unionByName, levels).groupBy(*by).agg(F.min("depth").alias("depth"))
        if runs is None:
            found = keep(found.join(seen.select(*by), by, "left_anti"))
        else:  # weighted edges may find a node by more links at a smaller depth
            found = keep(found.join(seen.select(*by, F.col("depth").alias("known")), by, "left").where("known is null or depth < known").select(*by, "depth"))
        depth += step
        n = found.count()
        if n == 0:
            break
        parts = _folded(parts, found, keep, by)
        seen = reduce(DataFrame.unionByName, parts)
        if runs is not None:
            seen = seen.groupBy(*by).agg(F.min("depth").alias("depth"))
        frontier = found
        if runs is None and step > 1:
            frontier = found.where(F.col("depth") == depth)
            n = frontier.count()
    if runs is not None:
        below = seen.join(runs.withColumnRenamed("node", "sq_inner"), F.col("node") == F.col("top")).select(*keys, F.col("sq_inner").alias("node"), (F.col("depth") + F.col("back")).alias("depth")).where(bound)
        seen = keep(seen.unionByName(below).groupBy(*by).agg(F.min("depth").alias("depth")))
    return seen


def _folded(parts: list[DataFrame], found: DataFrame, keep: Materialised, by: list[str]) -> list[DataFrame]:
    """``parts`` and ``found``; each FOLD rounds' tables become one, so that a deep graph's plans stay small."""
    return [*parts, found] if len(parts) < FOLD else [keep(reduce(DataFrame.unionByName, [*parts, found]).groupBy(*by).agg(F.min("depth").alias("depth")))]


def longest(edges: DataFrame, roots: DataFrame, whole: bool = False) -> DataFrame:
    """(node, depth): the length of the longest path from ``roots`` (node) along ``edges`` (src, dst) of an acyclic graph.

    A node waits until all its predecessors have their depth, so it is met once for each edge. ``whole`` says that roots reach all edges, which
    saves finding those that they do. A cycle raises a ValueError.
    """
    keep = Materialised(roots.sparkSession, "longest")
    edges = edges.select("src", "dst").distinct()
    start = roots.select("node").distinct()
    if not whole:
        edges = edges.join(closure(edges, start).select(F.col("node").alias("src")), "src", "left_semi")
    edges = keep(edges.withColumn("w", F.lit(1)))
    need = keep(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")))
    # A root that other nodes lead to gets its depth from them.
    frontier = keep(start.join(need.select("node"), "node", "left_anti").withColumn("depth", F.lit(0)))
    parts, waiting, runs, round_ = [frontier], None, None, 0
    while True:
        if runs is None and round_ >= LEVELS:
            edges, runs = _contracted(edges, frontier.select("node"), keep)
        hits = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("depth") + F.col("w")).alias("depth"), F.lit(1).cast("long").alias("had"))
        if waiting is not None:
            hits = hits.unionByName(waiting.select("node", "depth", "had"))
        now = hits.groupBy("node").agg(F.max("depth").alias("depth"), F.sum("had").alias("had")).join(need, "node")
        now = keep(now.select("node", "depth", "had", (F.col("had") == F.col("need")).alias("ready")))
        frontier, waiting = now.where("ready").select("node", "depth"), now.where("not ready")
        round_ += 1
        if frontier.isEmpty():
            break
        parts = _folded(parts, frontier, keep, ["node"])
    found = reduce(DataFrame.unionByName, parts)
    if runs is not None:
        below = found.join(runs.withColumnRenamed("node", "sq_inner"), F.col("node") == F.col("top")).select(F.col("sq_inner").alias("node"), (F.col("depth") + F.col("back")).alias("depth"))
        found = keep(found.unionByName(below.join(found.select("node"), "node", "left_anti")))
    if not need.join(found.select("node"), "node", "left_anti").isEmpty():
        raise ValueError("longest: the graph has a cycle")
    return found
