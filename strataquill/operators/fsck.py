"""Consistency checks as tables of violations (oid, problem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import objects as O


def _found(df: DataFrame, oid: str, **problems: Column) -> DataFrame:
    hits = F.filter(F.array(*[F.when(c, F.lit(n.replace("_", "-"))) for n, c in problems.items()]), lambda x: x.isNotNull())
    return df.select(F.col(oid).alias("oid"), F.explode(hits).alias("problem"))


def objects(rows: DataFrame) -> DataFrame:
    """Objects (oid, type, data) whose id isn't their digest, or whose type is unknown."""
    return _found(rows, "oid", wrong_id=O.object_id(F.col("type"), F.col("data")) != F.col("oid"), unknown_type=~F.col("type").isin("commit", "tree", "blob", "tag"))


def entries(tree_entries: DataFrame) -> DataFrame:
    """Trees (tree, name, mode, oid) with bad names, modes or ids, repeated names, or entries out of order (column at, if there)."""
    modes = [0o100644, 0o100755, 0o100664, 0o120000, 0o040000, 0o160000]
    name = F.col("name")
    out = _found(tree_entries, "tree", empty_name=name == "", bad_name=name.isin(".", "..", ".git") | name.contains("/"), bad_mode=~F.col("mode").isin(modes), bad_id=~O.valid_hexsha(F.col("oid")))
    twice = tree_entries.groupBy("tree", "name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("tree").alias("oid"), F.lit("repeated-name").alias("problem"))
    out = out.unionByName(twice)
    if "at" in tree_entries.columns:
        key = O.tree_sort_key(name, F.col("mode"))
        wrong = tree_entries.withColumn("key", key).withColumn("last", F.lag("key").over(Window.partitionBy("tree").orderBy("at"))).where("key < last")
        out = out.unionByName(wrong.select(F.col("tree").alias("oid"), F.lit("unsorted").alias("problem")))
    return out.distinct()


def commits(rows: DataFrame) -> DataFrame:
    """Commits (commit, tree, author, commit_time) without a valid tree, a well-formed author or a time that fits."""
    return _found(rows, "commit", bad_tree=~O.valid_hexsha(F.col("tree")), bad_author=~F.col("author").rlike(r"^[^<>\n]*<[^<>\n]*>$"), bad_time=F.col("commit_time").isNull() | (F.col("commit_time") < 0))


def links(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Objects with edges (src, dst) to ids that the store (oid) lacks."""
    return edges.join(known.select(F.col("oid").alias("dst")), "dst", "left_anti").select(F.col("src").alias("oid"), F.concat(F.lit("missing "), F.col("dst").cast("string")).alias("problem"))
