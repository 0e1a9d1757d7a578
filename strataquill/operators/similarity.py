"""Content similarity by shared blocks, and rename detection over it.

Similarity of every pair would be a cross join. Blocks are an inverted index instead: only pairs that share a block
meet, and with a threshold only those that share one of their rarer blocks and whose sizes allow a score above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions.text import blocks
from strataquill.operators.blocks import similar
from strataquill.operators.trees import tree_changes
from strataquill.plans.lineage import Materialised
from strataquill.plans.ranking import numbered


def count_blocks(blobs: DataFrame) -> DataFrame:
    """(oid, block, bytes): bytes of each distinct block of each blob (oid, data)."""
    each = blobs.select("oid", F.explode(blocks(F.col("data"))).alias("block"))
    return each.groupBy("oid", "block").agg(F.sum(F.length("block")).cast("long").alias("bytes"))


def similarity(left: DataFrame, right: DataFrame, threshold: int | None = None) -> DataFrame:
    """(left_oid, right_oid, score) of pairs of blobs (oid, data) that share a block: shared bytes * 100 / size of the larger, rounded down.

    Pairs that share nothing score 0 and are left out; two empty blobs score 100. With ``threshold`` only scores above it are returned,
    blobs whose sizes alone forbid it are never paired, and rows of one oid are one blob.
    """
    if threshold is not None:
        return similar(left, right, threshold)
    a = count_blocks(left).select(F.col("oid").alias("left_oid"), "block", F.col("bytes").alias("a"))
    b = count_blocks(right).select(F.col("oid").alias("right_oid"), "block", F.col("bytes").alias("b"))
    sa = left.select(F.col("oid").alias("left_oid"), F.octet_length("data").cast("long").alias("la")).distinct()
    sb = right.select(F.col("oid").alias("right_oid"), F.octet_length("data").cast("long").alias("lb")).distinct()
    shared = a.join(b, "block").groupBy("left_oid", "right_oid").agg(F.sum(F.least("a", "b")).alias("common")).join(sa, "left_oid").join(sb, "right_oid").withColumn("size", F.greatest("la", "lb"))
    scored = shared.select("left_oid", "right_oid", F.floor(F.col("common") * 100 / F.col("size")).cast("int").alias("score"))
    empty = sa.where("la = 0").join(sb.where("lb = 0"), F.col("la") == F.col("lb")).select("left_oid", "right_oid", F.lit(100).alias("score"))  # one empty blob a side
    return scored.unionByName(empty)


@dataclass(frozen=True)
class RenameDetector:
    """Rename and copy detection: exact by id, then by content, greedily by score.

    ``max_files``, if set, leaves contents uncompared where sources times additions exceed its square.
    """

    threshold: int = 60
    rewrite_threshold: int | None = None
    find_copies_harder: bool = False
    max_files: int | None = None

    def detect(self, old: DataFrame, new: DataFrame, blobs: DataFrame, want_unchanged: bool = False) -> DataFrame:
        """Changes as of tree_changes, with additions that match a deletion (or, for copies, another source) as rename or copy."""
        keep = Materialised(old.sparkSession, "renames")  # every step reads the one before it several times
        changes = keep(tree_changes(old, new, want_unchanged=want_unchanged or self.find_copies_harder))
        if self.rewrite_threshold is not None:
            changes = keep(self._split_rewrites(changes, blobs))
        adds = changes.where("change_type = 'add'").where(~O.is_gitlink(F.col("new_mode")))
        gone = changes.where("change_type = 'delete'").where(~O.is_gitlink(F.col("old_mode")))
        source = gone.select("old_path", "old_oid", "old_mode", F.lit(True).alias("moved"))
        if self.find_copies_harder:
            source = source.unionByName(changes.where("change_type in ('modify', 'unchanged')").select("old_path", "old_oid", "old_mode", F.lit(False).alias("moved")))
        exact = keep(exact_pairs(source, adds.select("new_path", "new_oid", "new_mode")))
        used_new = exact.select("new_path")
        used_old = exact.where("change_type = 'rename'").select("old_path")
        rest_new = adds.select("new_path", "new_oid", "new_mode").join(used_new, "new_path", "left_anti")
        rest_old = source.join(used_old, "old_path", "left_anti")
        rest_old, rest_new = keep(rest_old), keep(rest_new)
        many = self.max_files is not None and rest_old.count() * rest_new.count() > self.max_files**2
        found = exact if many else keep(exact.unionByName(self._content_pairs(rest_old, rest_new, blobs)))
        other = changes.where("change_type not in ('add', 'delete')" + ("" if want_unchanged else " and change_type <> 'unchanged'"))
        left_adds = changes.where("change_type = 'add'").join(found.select("new_path"), "new_path", "left_anti")
        left_gone = changes.where("change_type = 'delete'").join(found.where("change_type = 'rename'").select("old_path"), "old_path", "left_anti")
        out = keep(other.unionByName(left_adds).unionByName(left_gone).unionByName(found.select(*changes.columns)))
        return join_modifies(out) if self.rewrite_threshold is not None else out

    def _split_rewrites(self, changes: DataFrame, blobs: DataFrame) -> DataFrame:
        """Modifications with little in common as deletion and addition."""
        mods = changes.where("change_type = 'modify'").where("old_oid <> new_oid")
        pairs = mods.select(F.col("old_oid").alias("left_oid"), F.col("new_oid").alias("right_oid")).distinct()
        scores = similarity(blobs.join(pairs.select(F.col("left_oid").alias("oid")).distinct(), "oid"), blobs.join(pairs.select(F.col("right_oid").alias("oid")).distinct(), "oid"))
        scored = mods.join(scores, (mods["old_oid"] == scores["left_oid"]) & (mods["new_oid"] == scores["right_oid"]), "left").where(F.coalesce("score", F.lit(0)) < self.rewrite_threshold).select("old_path")
        split = changes.where("change_type = 'modify'").join(scored, "old_path", "left_semi")
        none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
        gone = split.select(F.lit("delete").alias("change_type"), "old_path", "old_oid", "old_mode", none_s.alias("new_path"), none_s.alias("new_oid"), none_i.alias("new_mode"))
        came = split.select(F.lit("add").alias("change_type"), none_s.alias("old_path"), none_s.alias("old_oid"), none_i.alias("old_mode"), "new_path", "new_oid", "new_mode")
        rest = changes.where("change_type <> 'modify'").unionByName(changes.where("change_type = 'modify'").join(scored, "old_path", "left_anti"))
        return rest.unionByName(gone).unionByName(came)

    def _content_pairs(self, old: DataFrame, new: DataFrame, blobs: DataFrame) -> DataFrame:
        scores = similarity(blobs.join(old.select(F.col("old_oid").alias("oid")), "oid", "left_semi"), blobs.join(new.select(F.col("new_oid").alias("oid")), "oid", "left_semi"), self.threshold)
        pairs = old.join(scores, old["old_oid"] == scores["left_oid"]).join(new, scores["right_oid"] == new["new_oid"]).where(F.col("old_mode").bitwiseAND(O.S_IFMT) == F.col("new_mode").bitwiseAND(O.S_IFMT))
        return greedy(pairs.select("old_path", "old_oid", "old_mode", "moved", "new_path", "new_oid", "new_mode", "score"))


def exact_pairs(source: DataFrame, adds: DataFrame) -> DataFrame:
    """Renames and copies of unchanged content: within one id the n-th deletion goes to the n-th addition; further additions copy the first."""
    mode = lambda c: F.col(c).bitwiseAND(O.S_IFMT)
    s = source.withColumn("kind", mode("old_mode")).withColumn("n", F.row_number().over(Window.partitionBy("old_oid", "kind").orderBy(F.desc("moved"), "old_path")))
    a = adds.withColumn("kind", mode("new_mode")).withColumn("n", F.row_number().over(Window.partitionBy("new_oid", "kind").orderBy("new_path")))
    keep = Materialised(adds.sparkSession, "exact")
    s, a = keep(s), keep(a)
    same = (F.col("old_oid") == F.col("new_oid")) & (s["kind"] == a["kind"])
    paired = a.join(s, same & (s["n"] == a["n"]) & s["moved"]).select(F.lit("rename").alias("change_type"), "old_path", "old_oid", "old_mode", "new_path", "new_oid", "new_mode")
    copies = a.join(paired.select("new_path"), "new_path", "left_anti").join(s.where("n = 1"), same).select(F.lit("copy").alias("change_type"), "old_path", "old_oid", "old_mode", "new_path", "new_oid", "new_mode")
    return paired.unionByName(copies)


def greedy(pairs: DataFrame) -> DataFrame:
    """One source for each new path by falling score (ties by paths); a source that is used again is copied.

    Taking pairs one after another, a new path is settled by its first pair, since a used source still serves for copies. So its
    best pair is its choice, whatever else was taken, and a source's best choice is its rename.
    """
    best = F.min(F.struct((-F.col("score")).alias("rank"), "old_path", "old_oid", "old_mode", "moved", "new_oid", "new_mode"))
    chosen = pairs.groupBy("new_path").agg(best.alias("best")).select("new_path", "best.*")
    first = F.row_number().over(Window.partitionBy("old_path").orderBy("rank", "new_path")) == 1
    return chosen.select(F.when(first & F.col("moved"), "rename").otherwise("copy").alias("change_type"), "old_path", "old_oid", "old_mode", "new_path", "new_oid", "new_mode")


def join_modifies(changes: DataFrame) -> DataFrame:
    """A deletion and an addition of one path of one type as a modification again."""
    gone = changes.where("change_type = 'delete'").select("old_path", "old_oid", "old_mode")
    came = changes.where("change_type = 'add'").select("new_path", "new_oid", "new_mode")
    same = (F.col("old_path") == F.col("new_path")) & (F.col("old_mode").bitwiseAND(O.S_IFMT) == F.col("new_mode").bitwiseAND(O.S_IFMT))
    both = gone.join(came, same).select(F.lit("modify").alias("change_type"), "old_path", "old_oid", "old_mode", "new_path", "new_oid", "new_mode")
    rest = changes.where("change_type not in ('add', 'delete')")
    rest = rest.unionByName(changes.where("change_type = 'delete'").join(both.select("old_path"), "old_path", "left_anti"))
    rest = rest.unionByName(changes.where("change_type = 'add'").join(both.select("new_path"), "new_path", "left_anti"))
    return rest.unionByName(both)


def sorted_changes(changes: DataFrame) -> DataFrame:
    return changes.orderBy(F.coalesce("old_path", "new_path"), F.coalesce("new_path", "old_path"))


#: Rows of one range of the delta order.
RANGE = 8192


def delta_order(objects: DataFrame) -> DataFrame:
    """``objects`` (oid, type, path, size) with position from 1 in delta order: by type, path, falling size."""
    return numbered(objects, "type", "path", F.desc("size"), "oid")


def delta_bases(objects: DataFrame, window: int = 10) -> DataFrame:
    """``objects`` (oid, type, path, size) with candidates: ids of up to ``window`` objects of the type before each in delta order.

    The order is cut into ranges of RANGE rows, each of which also gets the ``window`` rows before it, so a type with very many objects is many tasks' work.
    """
    placed = delta_order(objects).withColumn("sq_range", F.expr(f"(position - 1) div {RANGE}"))
    ahead = placed.where((F.col("position") - 1) % RANGE >= RANGE - window).withColumn("sq_range", F.col("sq_range") + 1).withColumn("sq_own", F.lit(False))
    both = placed.withColumn("sq_own", F.lit(True)).unionByName(ahead)
    order = Window.partitionBy("sq_range").orderBy("position").rowsBetween(-window, -1)
    near = F.collect_list(F.struct("type", "oid")).over(order)
    found = both.withColumn("sq_near", near).where("sq_own")
    same = F.transform(F.filter("sq_near", lambda x: x["type"].eqNullSafe(F.col("type"))), lambda x: x["oid"])
    return found.withColumn("candidates", same).select(*objects.columns, "candidates")


def reusable_deltas(entries: DataFrame, wanted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Stored deltas (oid, delta_base) of wanted ids (oid) whose base is wanted too or known to the receiver."""
    bases = wanted.select(F.col("oid").alias("delta_base"))
    if known is not None:
        bases = bases.unionByName(known.select(F.col("oid").alias("delta_base")))
    return entries.where("delta_base is not null").join(wanted.select("oid"), "oid", "left_semi").join(bases, "delta_base", "left_semi")
