"""Reports over history: log, shortlog, describe, cherry, line search, attribution, matching of patch series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import diffs
from strataquill.functions import objects as O
from strataquill.functions._udf import SLICE, cuts
from strataquill.functions.globs import wildmatch
from strataquill.functions.text import split_lines
from strataquill.operators import graph
from strataquill.plans.lineage import Materialised
from strataquill.plans.ranking import numbered
from strataquill.shipping import ship


def log(commits: DataFrame, parents: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, author: str | None = None, committer: str | None = None, grep: str | None = None, since: int | None = None, until: int | None = None, merges: bool | None = None, paths: list[str] | None = None, changes: DataFrame | None = None, max_entries: int | None = None, reverse: bool = False, order: str = "date") -> DataFrame:
    """``commits`` (commit, author, committer, commit_time, message, …) in walk order with a column position.

    Filters come before the limit: both time bounds are inclusive, patterns ignore case, ``merges`` keeps or drops commits of several
    parents, ``paths`` keeps commits with a change (commit, path) in or below one of them. Order is date (newest first, ties by id) or topo.
    """
    out = commits
    if include is not None:
        out = out.join(graph.walk(parents, include, exclude).select(F.col("node").alias("commit")), "commit", "left_semi")
    if since is not None:
        out = out.where(F.col("commit_time") >= since)
    if until is not None:
        out = out.where(F.col("commit_time") <= until)
    for column, pattern in (("author", author), ("committer", committer), ("message", grep)):
        if pattern is not None:
            out = out.where(F.col(column).rlike(f"(?i){pattern}"))
    if merges is not None:
        several = parents.groupBy("commit").agg(F.count("*").alias("n")).where("n > 1").select("commit")
        out = out.join(several, "commit", "left_semi" if merges else "left_anti")
    if paths is not None:
        hit = F.lit(False)
        for p in paths:
            hit = hit | O.path_under(F.col("path"), p)
        out = out.join(changes.where(hit).select("commit"), "commit", "left_semi")
    keys = [F.desc("commit_time"), F.col("commit")]
    if order == "topo":
        out = out.join(graph.generations(commits, parents), "commit")
        keys = [F.desc("generation"), *keys]
    if max_entries is not None:
        out = out.orderBy(*keys).limit(max_entries)
    ranked = numbered(out, *keys)
    return ranked.orderBy(F.desc("position") if reverse else "position")


def shortlog(commits: DataFrame) -> DataFrame:
    """(author, commits, lines, messages): messages of each author in order of time, joined by line feeds, with both counts that one may sort by."""
    grouped = commits.groupBy("author").agg(F.count("*").alias("commits"), F.array_sort(F.collect_list(F.struct("commit_time", "commit", "message"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["message"]), "\n")
    return grouped.select("author", "commits", text.alias("messages")).withColumn("lines", F.size(F.split("messages", "\n")).cast("long"))


def describe(commits: DataFrame, parents: DataFrame, tags: DataFrame, head, abbrev: int = 7) -> DataFrame:
    """(description): tag, number of commits since and short id of the first tagged commit on the walk from ``head``; the short id if there is none."""
    spark = commits.sparkSession
    start = spark.createDataFrame([(head,)], f"node {dict(commits.dtypes)['commit']}")
    on = commits.join(graph.ancestors(parents, start).select(F.col("node").alias("commit")), "commit", "left_semi")
    tagged = on.join(tags.groupBy(F.col("oid").alias("commit")).agg(F.min("name").alias("tag")), "commit")
    first = tagged.select(F.struct((-F.col("commit_time")).alias("t"), F.col("commit").alias("c")).alias("key"), "tag").agg(F.min_by(F.struct("tag", "key"), "key").alias("x")).select("x.tag", "x.key")
    # What stands before the first tagged commit on the walk is counted, not numbered.
    newer = on.join(F.broadcast(first)).where(F.struct((-F.col("commit_time")).alias("t"), F.col("commit").alias("c")) < F.col("key"))
    hit = first.join(F.broadcast(newer.agg(F.count("*").alias("n")))).agg(F.first(F.struct("tag", "n")).alias("t"))
    short = F.substring(F.lit(str(head)), 1, abbrev)
    return hit.select(F.when(F.col("t.tag").isNull(), short).when(F.col("t.n") == 0, F.col("t.tag")).otherwise(F.concat(F.col("t.tag"), F.lit("-"), F.col("t.n").cast("string"), F.lit("-g"), short)).alias("description"))


def grep(files: DataFrame, blobs: DataFrame, pattern: str, ignore_case: bool = False, pathspecs: list[str] | None = None, max_depth: int | None = None, ignored: Column | None = None) -> DataFrame:
    """(path, line_no, line) of lines that match, in files (path, oid) of one revision; path filters come before contents are read."""
    keep = files
    if max_depth is not None:
        keep = keep.where(O.path_depth(F.col("path")) <= max_depth)
    if pathspecs:
        hit = F.lit(False)
        for p in pathspecs:
            hit = hit | F.col("path").startswith(p) | F.col("path").rlike(wildmatch(p, paths=False))
        keep = keep.where(hit)
    if ignored is not None:
        keep = keep.where(~ignored)
    lines = keep.join(blobs.select("oid", "data"), "oid").select("path", F.posexplode(F.split("data", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)).select("path", (F.col("n") + 1).alias("line_no"), "line")


def patch_ids(lines: DataFrame, key: str = "commit") -> DataFrame:
    """(key, patch_id) of diffs as lines (key, line_no, line): blanks and tabs of changed lines and hunk positions don't count."""
    body = lines.where(~F.col("line").rlike("^(index |diff |@@|\\\\)"))
    text = F.when(F.col("line").rlike("^[+-]"), F.regexp_replace("line", "[ \t]", "")).otherwise(F.col("line"))
    grouped = body.select(key, F.struct("line_no", text.alias("t")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(key, F.sha1(F.array_join(F.transform("xs", lambda x: x["t"]), "\n")).alias("patch_id"))


def cherry(mine: DataFrame, upstream: DataFrame) -> DataFrame:
    """(commit, sign) of commits (commit, patch_id): '-' if upstream has the patch, else '+'."""
    there = upstream.select("patch_id").distinct().withColumn("hit", F.lit("-"))
    return mine.join(there, "patch_id", "left").select("commit", F.coalesce("hit", F.lit("+")).alias("sign"))


def diffstat(lines: DataFrame) -> DataFrame:
    """(path, added, deleted, is_binary) of unified diffs as lines (line_no, line), or (diff, line_no, line) for several diffs.

    The lines of one diff are one ordered group; many diffs (one for each commit, say) spread over tasks.
    """
    head = F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", 2)
    keys = ["diff"] if "diff" in lines.columns else []
    order = Window.partitionBy(*keys).orderBy("line_no")
    tagged = lines.withColumn("path", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(order)).withColumn("hunk", F.last(F.when(F.col("line").startswith("diff --git"), 0).when(F.col("line").startswith("@@"), 1), ignorenulls=True).over(order))
    plus, minus = (F.col("hunk") == 1) & F.col("line").startswith("+"), (F.col("hunk") == 1) & F.col("line").startswith("-")
    return tagged.where("path is not null").groupBy(*keys, "path").agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("deleted"), F.bool_or(F.col("line").startswith("Binary files")).alias("is_binary"))


def diffstat_bars(stat: DataFrame, width: int = 40) -> DataFrame:
    """``stat`` with a histogram of additions and deletions, scaled to the largest change."""
    scaled = stat.crossJoin(F.broadcast(stat.agg(F.greatest(F.max(F.col("added") + F.col("deleted")), F.lit(1)).alias("most"))))
    part = lambda c: F.when(F.col("most") <= width, F.col(c)).otherwise(F.ceil(F.col(c) * width / F.col("most"))).cast("int")
    return scaled.withColumn("bar", F.concat(F.repeat(F.lit("+"), part("added")), F.repeat(F.lit("-"), part("deleted")))).drop("most")


def annotate(revisions: DataFrame) -> DataFrame:
    """(path, line_no, line, commit): who last changed each line of each path's newest revision (path, position, commit, data).

    Revisions of one path are folded in order of position as they come from the sort: a task holds one revision and the lines so far, and hands on lines in
    bounded batches. A path's history is one task's work.
    """
    ship(revisions.sparkSession)
    kind = dict(revisions.dtypes)["commit"]
    ordered = revisions.select("path", "position", "commit", "data").repartition("path").sortWithinPartitions("path", F.asc_nulls_last("position"))
    return ordered.mapInArrow(_annotated, f"path string, line_no long, line string, commit {kind}")


def _annotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the last revision of each path with their commits, from revisions (path, position, commit, data) in order."""
    path, begun, kind = None, False, None
    known: list[tuple[str, object]] = []
    rows: list[tuple[str, int, str, object]] = []
    held = 0

    def table() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), kind)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "line_no", "line", "commit"])

    def finished() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for n, (line, commit) in enumerate(known, 1):
            rows.append((path, n, line, commit))
            held += len(line) + 100
            if held > SLICE:
                yield table()
                rows.clear()
                held = 0

    for batch in batches:
        kind = batch.column(2).type
        for at, n in cuts(tuple(batch.columns)):
            part = batch.slice(at, n)
            for p, commit, data in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                if not begun or p != path:
                    yield from finished()
                    path, begun, known = p, True, []
                known = diffs.reattribute(known, diffs.lines_of(data or ""), commit)
    yield from finished()
    if rows:
        yield table()


def range_diff(old: DataFrame, new: DataFrame, creation_factor: int = 60) -> DataFrame:
    """(old_position, new_position, sign) of two patch series (position, patch_id, patch): '=' equal, '!' matched, '<' dropped, '>' new.

    Equal patches pair by order. Of the rest, only pairs whose diff costs no more than leaving both unmatched can be in a least-cost assignment. Such pairs
    fall into groups that share no patch, and each group is assigned for itself; the largest group is one task's work.
    """
    keep = Materialised(old.sparkSession, "range-diff")
    ship(old.sparkSession)
    order = lambda p: F.row_number().over(Window.partitionBy("patch_id").orderBy(p))
    a, b = keep(old.withColumn("n", order("position"))), keep(new.withColumn("n", order("position")))
    same = keep(a.select(F.col("position").alias("old_position"), "patch_id", "n").join(b.select(F.col("position").alias("new_position"), "patch_id", "n"), ["patch_id", "n"]).select("old_position", "new_position", F.lit("=").alias("sign")))
    left = lambda x, side: x.join(same.select(F.col(f"{side}_position").alias("position")), "position", "left_anti").select(F.lit(side).alias("side"), "position", F.coalesce("patch", F.lit("")).alias("patch"))
    rest = keep(left(a, "old").unionByName(left(b, "new")))
    groups = keep(_groups(_matchable(rest, creation_factor, keep), keep))
    kinds = f"old_position {dict(old.dtypes)['position']}, new_position {dict(new.dtypes)['position']}, sign string"

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        mine, other = (group[group["side"] == s].sort_values("position") for s in ("old", "new"))
        rows = diffs.assign_patches(list(mine["patch"]), list(other["patch"]), creation_factor)
        at = lambda x, i: None if i is None else x["position"].iloc[i]
        found = [(at(mine, i), at(other, j), "!" if i is not None and j is not None else "<" if j is None else ">") for i, j in rows]
        return pd.DataFrame({"old_position": pd.array([x for x, _, _ in found], "Int64"), "new_position": pd.array([y for _, y, _ in found], "Int64"), "sign": [s for _, _, s in found]})

    settled = rest.join(groups, ["side", "position"]).groupBy("label").applyInPandas(settle, kinds)
    alone = rest.join(groups, ["side", "position"], "left_anti")
    alone = alone.select(F.when(F.col("side") == "old", F.col("position")).cast(dict(old.dtypes)["position"]).alias("old_position"), F.when(F.col("side") == "new", F.col("position")).cast(dict(new.dtypes)["position"]).alias("new_position"), F.when(F.col("side") == "old", "<").otherwise(">").alias("sign"))
    return same.unionByName(settled).unionByName(alone)


def _matchable(rest: DataFrame, creation_factor: int, keep: Materialised) -> DataFrame:
    """(old, new): positions of patches (side, position, patch) whose diff has no more lines than leaving both without a partner costs.

    A diff names every line that the two don't share, so they share at least half the lines by which each is longer than its own cost. Lines stand in one order,
    the rarest first, and the first that two patches share has all that they share at or behind it.
    """
    sized = rest.withColumn("cost", F.floor(F.regexp_count("patch", F.lit("\n")) * creation_factor / 100))
    lines = F.when(F.col("patch") == "", F.array(F.lit(""))).otherwise(split_lines(F.col("patch")))
    each = sized.select("side", "position", (F.size(lines) - F.col("cost")).alias("over"), F.explode(lines).alias("line")).groupBy("side", "position", "over", "line").agg(F.count("*").alias("times"))
    met = each.withColumn("n", F.count("*").over(Window.partitionBy("line")))
    behind = F.sum("times").over(Window.partitionBy("side", "position").orderBy(F.desc("n"), F.desc("line")).rowsBetween(Window.unboundedPreceding, 0))
    early = keep(met.withColumn("behind", behind).where("2 * behind >= over").select("side", "position", "line"))
    a, b = sized.where("side = 'old'").select(F.col("position").alias("old"), F.col("patch").alias("p"), F.col("cost").alias("c")), sized.where("side = 'new'").select(F.col("position").alias("new"), F.col("patch").alias("q"), F.col("cost").alias("d"))
    if creation_factor > 100:  # patches that share nothing may match
        pairs = a.select("old").crossJoin(b.select("new"))
    else:
        pairs = early.where("side = 'old'").select("line", F.col("position").alias("old")).join(early.where("side = 'new'").select("line", F.col("position").alias("new")), "line").select("old", "new").distinct()
    return keep(pairs.join(a, "old").join(b, "new").where(diffs.diff_sizes("p", "q") <= F.col("c") + F.col("d")).select("old", "new"))


def _groups(pairs: DataFrame, keep: Materialised) -> DataFrame:
    """(side, position, label): patches of pairs (old, new) with a label for each connected group, by least labels and pointer jumps."""
    x, y = F.struct(F.lit("old").alias("side"), F.col("old").cast("long").alias("position")), F.struct(F.lit("new").alias("side"), F.col("new").cast("long").alias("position"))
    links = keep(pairs.select(x.alias("x"), y.alias("y")).unionByName(pairs.select(y.alias("x"), x.alias("y"))))
    labels = keep(links.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct())
    while True:
        near = links.join(labels, F.col("y") == F.col("node")).select(F.col("x").alias("node"), "label").unionByName(labels)
        low = keep(near.groupBy("node").agg(F.min("label").alias("label")))
        jumped = keep(low.join(low.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label")))
        if jumped.join(labels, ["node", "label"], "left_anti").isEmpty():
            return jumped.select("node.side", "node.position", "label")
        labels = jumped
