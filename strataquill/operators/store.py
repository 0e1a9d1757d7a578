"""Object stores as tables (oid, type, size, …): lookups, unions of stores, batches, counts, notes and packing decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions import objects as O


def get(objects: DataFrame, oid: str) -> DataFrame:
    return objects.where(F.col("oid") == oid)


def prefix(objects: DataFrame, start: str, kind: str | None = None) -> DataFrame:
    """Distinct objects whose id starts so; the predicate reaches the files' statistics."""
    out = objects.where(F.col("oid").startswith(start))
    return (out if kind is None else out.where(F.col("type") == kind)).dropDuplicates(["oid"])


def subset(objects: DataFrame, ids: DataFrame) -> DataFrame:
    return objects.join(ids.select("oid"), "oid", "left_semi")


def absent(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ids that the store lacks."""
    return ids.select("oid").distinct().join(objects.select("oid"), "oid", "left_anti")


def overlay(stores: list[DataFrame]) -> DataFrame:
    """One store of several: an object comes from the first store that has it."""
    ranked = [s.withColumn("sq_rank", F.lit(i)) for i, s in enumerate(stores)]
    rows = reduce(DataFrame.unionByName, ranked)
    payload = [c for c in stores[0].columns if c != "oid"]
    best = rows.groupBy("oid").agg(F.min_by(F.struct(*payload), "sq_rank").alias("x"))
    return best.select("oid", "x.*").select(*stores[0].columns)


def add_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """New objects that the store does not have yet."""
    return new.dropDuplicates(["oid"]).join(objects.select("oid"), "oid", "left_anti")


def repack(packs: DataFrame, exclude: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """All packs as one, without excluded ids, in ranges of ids."""
    out = packs.dropDuplicates(["oid"])
    if exclude is not None:
        out = out.join(exclude.select("oid"), "oid", "left_anti")
    out = out.repartitionByRange(partitions, "oid") if partitions else out.repartitionByRange("oid")
    return out.sortWithinPartitions("oid")


def count_objects(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """One row: loose objects and bytes, packed objects, packs and bytes, objects that are both."""
    a = loose.agg(F.count("*").alias("loose"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("loose_bytes"))
    b = packed.agg(F.count("*").alias("packed"), F.countDistinct("pack").alias("packs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("packed_bytes"))
    both = loose.join(packed.select("oid"), "oid", "left_semi").agg(F.count("*").alias("prune_packable"))
    return a.join(b).join(both)  # three single rows


def complete_thin(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Entries of a pack with the external bases that its deltas need."""
    need = entries.where("delta_base is not null").select(F.col("delta_base").alias("oid")).distinct().join(entries.select("oid"), "oid", "left_anti")
    bases = subset(store, need).select(*[F.col(c) if c in store.columns else F.lit(None).cast(t).alias(c) for c, t in entries.dtypes])
    return entries.unionByName(bases)


def list_notes(notes_tree: DataFrame) -> DataFrame:
    """(object, note): files of a notes tree (path, oid), whose folders are parts of the ids."""
    return notes_tree.select(F.replace(F.col("path"), F.lit("/"), F.lit("")).alias("object"), F.col("oid").alias("note"))


def notes_level(notes_tree: DataFrame) -> DataFrame:
    return notes_tree.agg(O.note_fanout_level(F.count("*")).alias("level"))


def rebalance_notes(notes_tree: DataFrame) -> DataFrame:
    """(path, oid) of the notes at the fan-out that their number asks for."""
    rows = list_notes(notes_tree)
    levelled = rows.join(F.broadcast(rows.agg(F.count("*").alias("n"))))
    path = F.when(F.col("n") < 256, O.note_path(F.col("object"), 0)).when(F.col("n") < 65536, O.note_path(F.col("object"), 1)).otherwise(O.note_path(F.col("object"), 2))
    return levelled.select(path.alias("path"), F.col("note").alias("oid"))


def smudge(files: DataFrame, large: DataFrame) -> DataFrame:
    """Files (path, data) with pointers replaced by the large contents (oid, content) where they are present.

    Only pointers are joined. Files without one would all meet at one key, and so in one task.
    """
    pointed = files.withColumn("sq_pointer", O.lfs_pointer(F.col("data"))["oid"])
    joined = pointed.where("sq_pointer is not null").join(large.select(F.col("oid").alias("sq_pointer"), "content"), "sq_pointer", "left")
    return pointed.where("sq_pointer is null").select("path", "data").unionByName(joined.select("path", F.coalesce("content", "data").alias("data")))


def clean(files: DataFrame, least: int) -> DataFrame:
    """Files (path, data) with contents of ``least`` bytes and more replaced by pointers."""
    size = F.octet_length("data")
    return files.select("path", F.when(size >= least, O.lfs_pointer_text(F.sha2(F.col("data").cast("binary"), 256), size)).otherwise(F.col("data")).alias("data"))


def matching_bundles(bundles: DataFrame, spec: str | None) -> DataFrame:
    """Bundles whose filter is the one asked for; without one only unfiltered bundles."""
    return bundles.where(F.col("filter").eqNullSafe(F.lit(spec)))
