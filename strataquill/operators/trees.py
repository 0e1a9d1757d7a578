"""Directory snapshots as tables (path, oid, mode): comparison, merging, flattening and building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.plans.lineage import Materialised


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select(F.col("path"), F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"))
    b = new.select(F.col("path"), F.col("oid").alias("new_oid"), F.col("mode").alias("new_mode"))
    return a.join(b, "path", "full_outer")


def tree_changes(old: DataFrame, new: DataFrame, want_unchanged: bool = False, change_type_same: bool = False, paths: list[str] | None = None) -> DataFrame:
    """(change_type, old_path, old_oid, old_mode, new_path, new_oid, new_mode): one full outer join on the path.

    A change of the file's type is a deletion and an addition unless ``change_type_same``; ``paths`` keeps what is or lies below one of them.
    """
    if paths is not None:
        keep = reduce(lambda a, b: a | b, [O.path_under(F.col("path"), p) for p in paths], F.lit(False))
        old, new = old.where(keep), new.where(keep)
    both = _sides(old, new)
    retyped = F.col("old_mode").bitwiseAND(O.S_IFMT) != F.col("new_mode").bitwiseAND(O.S_IFMT)
    kind = (
        F.when(F.col("old_oid").isNull(), F.array(F.lit("add")))
        .when(F.col("new_oid").isNull(), F.array(F.lit("delete")))
        .when((F.col("old_oid") == F.col("new_oid")) & (F.col("old_mode") == F.col("new_mode")), F.array(F.lit("unchanged")))
        .when(F.lit(not change_type_same) & retyped, F.array(F.lit("delete"), F.lit("add")))
        .otherwise(F.array(F.lit("modify")))
    )
    rows = both.select(F.explode(kind).alias("change_type"), "*")
    if not want_unchanged:
        rows = rows.where("change_type <> 'unchanged'")

    def side(name: str, drop: str) -> list[Column]:
        there = F.col("change_type") != drop
        return [F.when(there & F.col(f"{name}_oid").isNotNull(), F.col("path")).alias(f"{name}_path"), F.when(there, F.col(f"{name}_oid")).alias(f"{name}_oid"), F.when(there, F.col(f"{name}_mode")).alias(f"{name}_mode")]

    return rows.select("change_type", *side("old", "add"), *side("new", "delete"))


def changes_for_merge(parents: list[DataFrame], merged: DataFrame) -> DataFrame:
    """Paths that differ from every parent, with their changes by parent: the conflicts of a merge.

    A path is kept if all parents changed it and not all of those changes are plain deletions.
    """
    each = [tree_changes(p, merged).select(F.coalesce("new_path", "old_path").alias("path"), F.lit(i).alias("parent"), "change_type", "old_oid", "new_oid") for i, p in enumerate(parents)]
    rows = reduce(DataFrame.unionByName, each)
    return (
        rows.groupBy("path")
        .agg(F.countDistinct("parent").alias("parents"), F.array_sort(F.collect_list(F.struct("parent", "change_type", "old_oid", "new_oid"))).alias("changes"), F.bool_and(F.col("change_type") == "delete").alias("gone"))
        .where((F.col("parents") == len(parents)) & ~F.col("gone"))
        .select("path", "changes")
    )


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, oid, mode, outcome) of a three-way merge of snapshots; outcome is clean, conflict or merge (both sides changed the content).

    Rows that the merge drops are left out, except conflicts, whose ``oid`` is what stays (null if nothing does).
    """
    return merge3_sides(base, ours, theirs).select("path", "oid", "mode", "outcome")


def merge3_sides(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """merge3() with base_oid, ours_oid and theirs_oid of each path, null where a side lacks it."""
    j = base.select("path", F.struct("oid", "mode").alias("b")).join(ours.select("path", F.struct("oid", "mode").alias("o")), "path", "full_outer").join(theirs.select("path", F.struct("oid", "mode").alias("t")), "path", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    nothing = F.lit(None).cast("struct<oid:string,mode:int>")
    gitlink = O.is_gitlink(o["mode"]) | O.is_gitlink(t["mode"])

    def verdict(take: Column, outcome: str) -> Column:
        return F.struct(take["oid"].alias("oid"), take["mode"].cast("int").alias("mode"), F.lit(outcome).alias("outcome"))

    same = lambda x, y: x.eqNullSafe(y)
    rule = (
        F.when(o.isNull() & t.isNull(), verdict(nothing, "drop"))
        .when(b.isNull() & same(o, t), verdict(o, "clean"))
        .when(b.isNull() & t.isNull(), verdict(o, "clean"))
        .when(b.isNull() & o.isNull(), verdict(t, "clean"))
        .when(b.isNull(), verdict(o, "conflict"))
        .when(o.isNotNull() & t.isNotNull() & (o["mode"] != t["mode"]), verdict(o, "conflict"))
        .when(o["oid"] == t["oid"], verdict(o, "clean"))
        .when((o["oid"] == b["oid"]) & t.isNotNull(), verdict(t, "clean"))
        .when((t["oid"] == b["oid"]) & o.isNotNull(), verdict(o, "clean"))
        .when(o.isNull(), F.when(t["oid"] == b["oid"], verdict(nothing, "drop")).otherwise(verdict(nothing, "conflict")))
        .when(t.isNull(), F.when(o["oid"] == b["oid"], verdict(nothing, "drop")).otherwise(verdict(o, "conflict")))
        .when(gitlink, verdict(o, "conflict"))
        .otherwise(verdict(o, "merge"))
    )
    return j.select("path", rule.alias("r"), b["oid"].alias("base_oid"), o["oid"].alias("ours_oid"), t["oid"].alias("theirs_oid")).select("path", "r.oid", "r.mode", "r.outcome", "base_oid", "ours_oid", "theirs_oid").where("outcome <> 'drop'")


def flatten(tree_entries: DataFrame, roots: DataFrame, include_trees: bool = False) -> DataFrame:
    """(root, path, mode, oid, depth) of everything below ``roots`` (root = id of a tree); submodules are not entered.

    ``tree_entries`` is (tree, name, mode, oid). One join per level of depth; every tree is expanded once per place it stands at.
    """
    keep = Materialised(roots.sparkSession, "flatten")
    level = roots.select("root", F.lit("").alias("path"), F.lit(O.S_IFDIR).alias("mode"), F.col("root").alias("oid"), F.lit(0).alias("depth"))
    out = []
    while True:
        dirs = level.where(O.is_dir(F.col("mode"))).select("root", F.col("path").alias("above"), F.col("oid").alias("tree"), "depth")
        path = F.when(F.col("above") == "", F.col("name")).otherwise(F.concat_ws("/", "above", "name"))
        level = keep(dirs.join(tree_entries.select("tree", "name", "mode", "oid"), "tree").select("root", path.alias("path"), "mode", "oid", (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            break
        out.append(level)
    found = reduce(DataFrame.unionByName, out) if out else level
    return found if include_trees else found.where(~O.is_dir(F.col("mode")))


def lookup_path(flat: DataFrame, path: str) -> DataFrame:
    """Row of one path of a flattened tree (with its folders)."""
    return flat.where(F.col("path") == path)


def under_paths(flat: DataFrame, include: list[str]) -> DataFrame:
    """Rows below each of the paths; overlapping paths repeat rows."""
    return reduce(DataFrame.unionByName, [flat.where(O.path_under(F.col("path"), p)) for p in include])


def submodules(flat: DataFrame) -> DataFrame:
    return flat.where(O.is_gitlink(F.col("mode")))


def build_trees(files: DataFrame, most: int = 200) -> DataFrame:
    """(path, oid, entries) of every folder's tree object for ``files`` (path, mode, oid), the root being path ''.

    Folders are built from the deepest up; a tree's bytes are its entries ``mode name NUL raw id`` in tree order.
    """
    spark = files.sparkSession
    keep = Materialised(spark, "trees")
    rows = keep(files.select("path", "mode", "oid").withColumn("depth", O.path_depth(F.col("path"))))
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "path string, oid string, entries array<struct<name:string,mode:int,oid:string>>")
    built, done = [], None
    for depth in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == depth).select("path", "mode", "oid")
        if done is not None:
            here = here.unionByName(done.where("path <> ''").select("path", F.lit(O.S_IFDIR).alias("mode"), "oid"))
        entry = F.struct(O.tree_sort_key(O.basename(F.col("path")), F.col("mode")).alias("key"), O.basename(F.col("path")).alias("name"), "mode", "oid")
        grouped = here.groupBy(O.dirname(F.col("path")).alias("folder")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        raw = F.aggregate("e", F.unhex(F.lit("")), lambda a, x: F.concat(a, F.concat(F.conv(x["mode"].cast("string"), 10, 8), F.lit(" "), x["name"], F.lit("\0")).cast("binary"), F.unhex(x["oid"])))
        done = keep(grouped.select(F.col("folder").alias("path"), O.object_id("tree", raw).alias("oid"), F.transform("e", lambda x: F.struct(x["name"], x["mode"], x["oid"])).alias("entries")))
        built.append(done)
    return reduce(DataFrame.unionByName, built)


def apply_changes(files: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """``files`` (path, mode, oid) after upserts of rows and deletions of paths; folders follow from the files."""
    gone = deletes.select("path").unionByName(upserts.select("path"))
    return files.select("path", "mode", "oid").join(gone, "path", "left_anti").unionByName(upserts.select("path", "mode", "oid"))


def extract_subtree(files: DataFrame, prefix: str) -> DataFrame:
    """Files below ``prefix``, with paths relative to it."""
    return files.where(F.col("path").startswith(prefix + "/")).withColumn("path", F.substr(F.col("path"), F.lit(len(prefix) + 2)))


def replace_subtree(files: DataFrame, prefix: str, subtree: DataFrame) -> DataFrame:
    """``files`` with everything below ``prefix`` replaced by ``subtree``."""
    rest = files.where(~O.path_under(F.col("path"), prefix)).select("path", "mode", "oid")
    return rest.unionByName(subtree.select(F.concat(F.lit(prefix + "/"), F.col("path")).alias("path"), "mode", "oid"))


def status(head: DataFrame, index: DataFrame, working: DataFrame) -> DataFrame:
    """(section, change_type, path): staged, unstaged and untracked paths of three snapshots."""
    staged = tree_changes(head, index, change_type_same=True).select(F.lit("staged").alias("section"), "change_type", F.coalesce("new_path", "old_path").alias("path"))
    unstaged = tree_changes(index, working, change_type_same=True).where("change_type <> 'add'").select(F.lit("unstaged").alias("section"), "change_type", F.col("old_path").alias("path"))
    untracked = working.join(index.select("path"), "path", "left_anti").select(F.lit("untracked").alias("section"), F.lit("add").alias("change_type"), "path")
    return staged.unionByName(unstaged).unionByName(untracked)


def case_only_renames(changes: DataFrame) -> DataFrame:
    """(old_path, new_path) of paths that went and came with the same letters in other cases."""
    gone = changes.where("change_type in ('delete', 'rename')").select("old_path", F.lower("old_path").alias("key"))
    came = changes.where("change_type in ('add', 'modify', 'rename', 'copy')").select("new_path", F.lower("new_path").alias("key"))
    return gone.join(came, "key").where("old_path <> new_path").select("old_path", "new_path")
