"""Questions about the commit graph: ancestry, bases, generations, shallow cuts, bisection.

``parents`` is an edge table (commit, parent_no, parent); ids may be of any orderable type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.plans.closure import closure, longest
from strataquill.plans.lineage import Materialised
from strataquill.plans.ranking import numbered


def _up(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst")).where("dst is not null")


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(F.col(df.columns[0]).alias("node")).distinct()


def ancestors(parents: DataFrame, heads: DataFrame, stop: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of heads and all their ancestors."""
    return closure(_up(parents), _nodes(heads), None if stop is None else _nodes(stop), max_depth)


def ancestors_by(parents: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, node, depth) for heads (key, node): the closure of each key."""
    return closure(_up(parents), heads, keys=(key,))


def effective_parents(parents: DataFrame, grafts: DataFrame | None = None, shallow: DataFrame | None = None) -> DataFrame:
    """Parents after grafts (commit, parent_no, parent; a null parent means none) and shallow cuts (commit), in that precedence."""
    out = parents
    if shallow is not None:
        out = out.join(shallow.select("commit"), "commit", "left_anti")
    if grafts is not None:
        out = out.join(grafts.select("commit").distinct(), "commit", "left_anti").unionByName(grafts.where("parent is not null").select(*parents.columns))
    return out


def walk(parents: DataFrame, include: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(node): ancestors of ``include`` less ancestors of ``exclude``."""
    found = ancestors(parents, include).select("node")
    return found if exclude is None else found.join(ancestors(parents, exclude).select("node"), "node", "left_anti")


def generations(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit, generation): 1 for roots, else one more than the largest parent's; unknown parents count 0."""
    known = commits.select("commit")
    inside = parents.join(known.select(F.col("commit").alias("parent")), "parent", "left_semi").select("commit", "parent")
    roots = known.join(inside.select("commit").distinct(), "commit", "left_anti").select(F.col("commit").alias("node"))
    down = inside.select(F.col("parent").alias("src"), F.col("commit").alias("dst")).distinct()
    return longest(down, roots, whole=True).select(F.col("node").alias("commit"), (F.col("depth") + 1).alias("generation"))


def depth_of(parents: DataFrame, head: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row (depth): the number of commits on the longest path from ``head``, capped."""
    found = longest(_up(parents), _nodes(head)).agg((F.max("depth") + 1).alias("depth"))
    return found if max_depth is None else found.select(F.least("depth", F.lit(max_depth)).alias("depth"))


def shallow(parents: DataFrame, heads: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(commits at which a history of ``depth`` commits ends, commits before them), as (node); over all path lengths, so they may overlap."""
    up, keep = _up(parents), Materialised(heads.sparkSession, "shallow")
    levels = [keep(_nodes(heads))]
    for _ in range(depth - 1):
        last = levels[-1]
        levels.append(keep(last.join(up, last["node"] == up["src"]).select(F.col("dst").alias("node")).distinct()))
    return levels[-1], reduce(DataFrame.unionByName, levels[:-1]).distinct() if depth > 1 else levels[0].limit(0)


def lowest_common(parents: DataFrame, one: DataFrame, others: DataFrame) -> DataFrame:
    """(node): common ancestors of ``one`` and of any of ``others`` that are no ancestors of another such."""
    common = Materialised(one.sparkSession, "lca")(ancestors(parents, one).select("node").join(ancestors(parents, others).select("node"), "node", "left_semi"))
    above = _up(parents).join(common.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    # The common ancestors are closed under parents, so a common ancestor is not lowest exactly if it is a parent of one.
    return common.join(above, "node", "left_anti")


def merge_base(parents: DataFrame, commits: list) -> DataFrame:
    """(node): the lowest common ancestors of the first commit and the union of the rest."""
    spark = parents.sparkSession
    kind = dict(parents.dtypes)["commit"]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], f"node {kind}")
    if len(commits) == 1 or commits[0] in commits[1:]:
        return frame(commits[:1])
    return lowest_common(parents, frame(commits[:1]), frame(commits[1:]))


def octopus_base(parents: DataFrame, commits: list) -> DataFrame:
    """(node): lowest common ancestors folded over all commits."""
    if len(commits) <= 2:
        return merge_base(parents, commits)
    spark = parents.sparkSession
    kind = dict(parents.dtypes)["commit"]
    found = spark.createDataFrame([(commits[0],)], f"node {kind}")
    for c in commits[1:]:
        found = lowest_common(parents, spark.createDataFrame([(c,)], f"node {kind}"), found)
    return found


def is_ancestor(parents: DataFrame, ancestor: DataFrame, descendant: DataFrame) -> DataFrame:
    """One row (is_ancestor)."""
    hit = ancestors(parents, descendant).select("node").join(_nodes(ancestor), "node", "left_semi")
    return hit.agg((F.count("*") > 0).alias("is_ancestor"))


def independent(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """(node): heads that no other head has among its ancestors."""
    heads = _nodes(heads)
    up = _up(parents)
    first = up.join(heads, up["src"] == heads["node"], "left_semi").select(F.col("dst").alias("node"))
    return heads.join(closure(up, first).select("node"), "node", "left_anti")


def containing(parents: DataFrame, branches: DataFrame, commit: DataFrame) -> DataFrame:
    """(branch): branches (branch, node) whose tip descends from ``commit`` or is it; found from the commit downwards."""
    down = _up(parents).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return branches.join(closure(down, _nodes(commit)).select("node"), "node", "left_semi").select("branch").distinct()


def merged(parents: DataFrame, branches: DataFrame, head: DataFrame) -> DataFrame:
    """(branch, is_merged): whether each branch's tip is an ancestor of ``head``."""
    known = ancestors(parents, head).select("node", F.lit(True).alias("hit"))
    return branches.join(known, "node", "left").select("branch", F.coalesce("hit", F.lit(False)).alias("is_merged"))


def branch_matrix(parents: DataFrame, branches: DataFrame, names: list[str]) -> DataFrame:
    """(node, one boolean column for each branch, is_tip): which branches reach which commit."""
    reach = ancestors_by(parents, branches.where(F.col("branch").isin(names)).select("branch", "node"), "branch")
    rows = reach.groupBy("node").agg(*[F.bool_or(F.col("branch") == n).alias(n) for n in names])
    tips = branches.where(F.col("branch").isin(names)).select("node", F.lit(True).alias("tip")).distinct()
    return rows.join(tips, "node", "left").select("node", *names, F.coalesce("tip", F.lit(False)).alias("is_tip"))


def bisect_candidates(parents: DataFrame, bad: DataFrame, good: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(node, level, position): commits between bad and good by distance from bad, without bad; ancestors of good are not candidates."""
    stop = _nodes(good) if skip is None else _nodes(good).unionByName(_nodes(skip)).distinct()
    found = ancestors(parents, bad, stop).where("depth > 0").join(ancestors(parents, good).select("node"), "node", "left_anti")
    return numbered(found.select("node", F.col("depth").alias("level")), "level", "node")


def bisect_next(candidates: DataFrame) -> DataFrame:
    """(node, remaining, steps): the middle candidate and an estimate of the steps left."""
    counted = candidates.join(F.broadcast(candidates.agg(F.count("*").alias("remaining"))))  # one row
    return counted.where(F.col("position") == F.floor(F.col("remaining") / 2) + 1).select("node", "remaining", F.floor(F.log2("remaining")).cast("int").alias("steps"))


def topological(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """``commits`` (commit, commit_time) with position: no commit before its children, newest first among equals."""
    ranked = commits.join(generations(commits, parents), "commit")
    return numbered(ranked, F.desc("generation"), F.desc("commit_time"), "commit")


def wants_satisfied(parents: DataFrame, wants: DataFrame, haves: DataFrame, commits: DataFrame | None = None, earliest: int | None = None) -> DataFrame:
    """(want, satisfied): whether any of ``haves`` is among a want's ancestors not older than ``earliest``."""
    reach = ancestors_by(parents, wants.select(F.col(wants.columns[0]).alias("want"), F.col(wants.columns[0]).alias("node")), "want")
    if commits is not None and earliest is not None:
        reach = reach.join(commits.where(F.col("commit_time") >= earliest).select(F.col("commit").alias("node")), "node", "left_semi")
    hit = reach.join(_nodes(haves), "node", "left_semi").select("want").distinct().withColumn("hit", F.lit(True))
    return wants.select(F.col(wants.columns[0]).alias("want")).distinct().join(hit, "want", "left").select("want", F.coalesce("hit", F.lit(False)).alias("satisfied"))


def peel(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """(oid, peeled): each id (oid) followed through tags (tag, target) to what is no tag."""
    edges = tags.select(F.col("tag").alias("src"), F.col("target").alias("dst"))
    reach = closure(edges, ids.select(F.col("oid").alias("key"), F.col("oid").alias("node")), keys=("key",))
    ends = reach.join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    return ends.select(F.col("key").alias("oid"), F.col("node").alias("peeled"))


def reachable_objects(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of everything that refs reach over the unified edges (src, dst) of commits, trees and tags."""
    return closure(edges, _nodes(roots)).select("node")


def unreachable(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``objects`` (oid, …) that no root reaches."""
    return objects.join(reachable_objects(edges, roots).select(F.col("node").alias("oid")), "oid", "left_anti")


def prune(objects: DataFrame, edges: DataFrame, roots: DataFrame, before: int | None = None) -> DataFrame:
    """One row (pruned, freed_bytes) for unreachable objects (oid, size, mtime) that are older than ``before``."""
    gone = unreachable(objects, edges, roots)
    if before is not None:
        gone = gone.where(F.col("mtime") < before)
    return gone.agg(F.count("*").alias("pruned"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("freed_bytes"))


def missing_objects(edges: DataFrame, haves: DataFrame, wants: DataFrame) -> DataFrame:
    """(node): what ``wants`` reach and ``haves`` don't; edges behind objects that are had are not followed."""
    had = Materialised(wants.sparkSession, "had")(closure(edges, _nodes(haves)).select("node"))
    return closure(edges, _nodes(wants), stop=had).select("node")


def abbreviations(ids: DataFrame, least: int = 7) -> DataFrame:
    """(oid, abbrev): the shortest unique prefix of at least ``least`` characters of each distinct hexadecimal id.

    Ids are sorted within ranges of their first two characters; ids of different ranges differ there already.
    """
    order = Window.partitionBy(F.substring("oid", 1, 2)).orderBy("oid")
    near = ids.select("oid").distinct().select("oid", F.lag("oid").over(order).alias("a"), F.lead("oid").over(order).alias("b"))

    def common(other: str):
        at = F.filter(F.sequence(F.lit(1), F.length("oid")), lambda i: F.substr(F.col("oid"), i, F.lit(1)) != F.substr(F.col(other), i, F.lit(1)))
        return F.when(F.col(other).isNull(), 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, F.length("oid")))

    need = F.greatest(F.lit(least), common("a") + 1, common("b") + 1)
    return near.select("oid", F.substr(F.col("oid"), F.lit(1), need).alias("abbrev"))
