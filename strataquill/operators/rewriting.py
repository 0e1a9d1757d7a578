"""Rewritten histories: filtered commits, split subtrees, followed paths, exports and bundles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions import people
from strataquill.functions import text as X
from strataquill.operators import graph, store
from strataquill.plans.lineage import Materialised
from strataquill.shipping import ship
from strataquill.sources import files as stored
from strataquill.sources import packs


def commit_text(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """A commit's text from its parts; parents are an array of ids."""
    lines = F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), "")
    return F.concat(F.lit("tree "), tree, F.lit("\n"), lines, F.lit("author "), author, F.lit("\ncommitter "), committer, F.lit("\n\n"), message)


def rewrite(commits: DataFrame, parents: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None, drop: Column | None = None) -> DataFrame:
    """(commit, new, tree, parents, author, committer, message): every commit (commit, tree, author, committer, message) with its new id.

    ``change`` maps the table of commits to one with other trees, people or messages; commits for which ``drop`` holds are
    replaced by their rewritten parents. Ids depend on parents' ids, so generations are rewritten one after another.
    """
    keep = Materialised(commits.sparkSession, "rewrite")
    commits, parents = keep(commits), keep(parents.select("commit", "parent_no", "parent"))  # each generation reads them
    changed = change(commits) if change else commits
    levels = keep(changed.join(graph.generations(commits, parents), "commit").withColumn("sq_drop", F.coalesce(drop, F.lit(False)) if drop is not None else F.lit(False)))
    top = levels.agg(F.max("generation")).first()[0]
    done: list[DataFrame] = []
    maps: list[DataFrame] = []  # (commit, news): a dropped commit stands for several
    for g in range(1, (top or 0) + 1):
        here = levels.where(F.col("generation") == g)
        if maps:
            known = reduce(DataFrame.unionByName, maps)
            pairs = parents.join(here.select("commit"), "commit", "left_semi").join(known.select(F.col("commit").alias("parent"), "news"), "parent")
            new = pairs.groupBy("commit").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("parent_no", "news"))), lambda x: x["news"]))).alias("parents"))
            here = here.join(new, "commit", "left")
        else:
            here = here.withColumn("parents", F.lit(None).cast("array<string>"))
        here = here.withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
        row = here.withColumn("new", O.object_id("commit", commit_text(F.col("tree"), F.col("parents"), F.col("author"), F.col("committer"), F.col("message"))))
        row = keep(row)
        maps.append(row.select("commit", F.when(F.col("sq_drop"), F.col("parents")).otherwise(F.array("new")).alias("news")))
        done.append(row.where("not sq_drop").select("commit", "new", "tree", "parents", "author", "committer", "message"))
        if g % 32 == 0:  # few tables, so that a deep history's plans stay small
            maps, done = [keep(reduce(DataFrame.unionByName, maps))], [keep(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done)


def rewritten_refs(refs: DataFrame, rewritten: DataFrame, originals: bool = True) -> DataFrame:
    """(name, oid) of refs at rewritten commits, with the old ones below refs/original if asked."""
    moved = refs.join(rewritten.select(F.col("commit").alias("oid"), "new"), "oid").select("name", "oid", "new")
    out = moved.select("name", F.col("new").alias("oid"))
    return out.unionByName(moved.where("oid <> new").select(F.concat(F.lit("refs/original/"), "name").alias("name"), "oid")) if originals else out


def subtree_metadata(commits: DataFrame) -> DataFrame:
    """(commit, dir, split, mainline) of commits whose messages have subtree trailers."""
    parsed = commits.select("commit", X.parse_trailers(F.col("message")).alias("p"))
    value = lambda k: F.get(F.filter("p.trailers", lambda t: t["key"] == k), F.lit(0))["value"]
    return parsed.select("commit", value("git-subtree-dir").alias("dir"), value("git-subtree-split").alias("split"), value("git-subtree-mainline").alias("mainline")).where("dir is not null")


def subtree_splits(commits: DataFrame, parents: DataFrame, head: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """(commit, split) of merges of a prefix's splits in the history of ``head``, nearest first."""
    reach = graph.ancestors(parents, head)
    hit = subtree_metadata(commits).where(F.col("dir") == prefix).join(reach.select(F.col("node").alias("commit"), "depth"), "commit")
    out = hit.orderBy("depth", "commit")
    return (out if limit is None else out.limit(limit)).select("commit", "split")


def split_history(commits: DataFrame, parents: DataFrame, folders: DataFrame) -> DataFrame:
    """As rewrite, for the history of one folder: ``folders`` (commit, folder_tree) has its tree where it exists; commits that don't change it are dropped."""
    with_tree = commits.drop("tree").join(folders.select("commit", F.col("folder_tree").alias("tree")), "commit", "left")
    before = parents.join(folders.select(F.col("commit").alias("parent"), F.col("folder_tree").alias("old")), "parent", "left").groupBy("commit").agg(F.collect_set("old").alias("olds"), F.count("*").alias("n"))
    same = with_tree.join(before, "commit", "left").select("commit", (F.col("tree").isNull() | ((F.col("n") == 1) & F.array_contains("olds", F.col("tree")))).alias("sq_same"))
    rows = with_tree.join(same, "commit")
    return rewrite(rows, parents, drop=F.coalesce(F.col("sq_same"), F.lit(False)) | F.col("tree").isNull())


def follow(changes: DataFrame, order: DataFrame, path: str) -> DataFrame:
    """(commit, position, path): changes (commit, change_type, old_path, new_path) of a path, newest first by ``order`` (commit, position), followed through renames.

    Each turn reads the path's own changes and stops at the newest rename into it; a path has few renames.
    """
    spark, out, start = changes.sparkSession, [], 0
    ordered = Materialised(spark, "follow")(changes.join(order, "commit"))
    while True:
        own = ordered.where((F.col("new_path") == path) | (F.col("old_path") == path)).where(F.col("position") >= start)
        turn = own.where(F.col("change_type").isin("rename", "copy") & (F.col("new_path") == path)).orderBy("position").limit(1).collect()
        rows = own.select("commit", "position", F.lit(path).alias("path"))
        out.append(rows.where(F.col("position") <= turn[0]["position"]) if turn else rows)
        if not turn:
            break
        path, start = turn[0]["old_path"], turn[0]["position"] + 1
    return reduce(DataFrame.unionByName, out)


# Transfers ---------------------------------------------------------------------------------------------------


def pack_partitions(objects: DataFrame, window: int = 10, by: str | None = None) -> DataFrame:
    """(name, pack, idx): one pack and index for each partition of objects (type, path, size, data), in delta order within it.

    With ``by`` each value of that column within a partition gets a pack of its own, so a task holds one such pack however large its partition is.
    """
    import hashlib

    import pandas as pd

    ship(objects.sparkSession)
    key = F.lit(0) if by is None else F.col(by)
    ordered = objects.select(key.alias("sq_key"), "type", "path", "size", "data").sortWithinPartitions("sq_key", "type", "path", F.desc("size")).select("sq_key", "type", "data")

    def packed(rows):
        pack, entries = packs.write_pack(rows, window)
        return pd.DataFrame({"name": ["pack-" + hashlib.sha1(b"".join(bytes.fromhex(o) for o in sorted(e[0] for e in entries))).hexdigest()], "pack": [pack], "idx": [packs.write_index(entries, pack[-20:])]})

    def run(frames):
        now, rows = None, []
        for f in frames:
            for k, kind, data in zip(f["sq_key"], f["type"], f["data"]):
                if rows and k != now:
                    yield packed(rows)
                    rows = []
                now = k
                rows.append((kind, bytes(data)))
        if rows:
            yield packed(rows)

    return ordered.mapInPandas(run, "name string, pack binary, idx binary")


def bundle(objects: DataFrame, edges: DataFrame, refs: dict[str, str], prerequisites: list[tuple[str, str]], version: int = 2) -> bytes:
    """A bundle of what ``refs`` reach and the prerequisites don't; the file is assembled on the driver, as a bundle is one file."""
    spark: SparkSession = objects.sparkSession
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "node string")
    need = graph.missing_objects(edges, frame([o for o, _ in prerequisites]), frame(list(refs.values())))
    rows = store.subset(objects, need.select(F.col("node").alias("oid"))).select("type", "data").toLocalIterator()
    pack, _ = packs.write_pack([(r["type"], bytes(r["data"])) for r in rows])
    return stored.write_bundle(refs, prerequisites, pack, version)


def patch_mails(commits: DataFrame) -> DataFrame:
    """(number, file_name, mail) of commits (number, oid, author, time, offset, message, patch) as mailed patches."""
    total = F.broadcast(commits.agg(F.count("*").alias("n")))
    rows = commits.join(total)
    subject, body = F.substring_index("message", "\n", 1), F.regexp_replace(F.regexp_replace("message", r"^[^\n]*\n?", ""), r"^\n+", "")
    tag = F.when(F.col("n") == 1, "[PATCH]").otherwise(F.format_string("[PATCH %d/%d]", F.col("number").cast("long"), F.col("n")))
    local = F.timestamp_seconds(F.col("time") + F.col("offset"))
    date = F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss "), people.format_timezone(F.col("offset")))
    mail = F.concat(F.lit("From "), F.col("oid"), F.lit(" Mon Sep 17 00:00:00 2001\nFrom: "), F.col("author"), F.lit("\nDate: "), date, F.lit("\nSubject: "), tag, F.lit(" "), subject, F.lit("\n\n"), body, F.lit("---\n\n"), F.col("patch"), F.lit("-- \n1\n"))
    return rows.select("number", F.format_string("%04d-%s.patch", F.col("number").cast("long"), X.summary_slug(F.col("message"))).alias("file_name"), mail.alias("mail"))
