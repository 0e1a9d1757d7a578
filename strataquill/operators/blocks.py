"""Blobs as keys of their blocks, and pairs of blobs that can be similar, found and scored without moving texts.

A blob is read once. What is kept of a block is a key of KEY bytes (its BLAKE2b digest) and how many bytes the blob has of it. No step has rows of
blobs and blocks with ids and texts; the rows that seek pairs hold numbers only, and keys move once for each blob and bucket of partners.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions._udf import cuts
from strataquill.plans.lineage import Materialised
from strataquill.shipping import ship

#: Bytes of a block's key. The first eight are the number by which pairs are sought, the first four that by which blocks are counted.
KEY = 12
#: A block that makes no more pairs than this needs no place in the order of blocks.
FEW = 16
#: Blocks at most that have a place in that order by the pairs they make; all others stand before them. The order settles what a search costs, not what it finds.
PLACED = 1 << 19
#: Blocks of one group in which they are counted, and bytes of keys that a task holds at once when it scores pairs, about.
COUNTED, HELD = 1 << 21, 1 << 24
#: Blobs at most of which a task remembers that it has read them.
SEEN = 1 << 17
#: Pairs of one batch of results.
BATCH = 1 << 14

_BLOCK = re.compile(rb"[^\n]{0,63}\n|[^\n]{1,64}")


def signature(text: bytes) -> tuple[bytes, bytes, int]:
    """Keys of a blob's distinct blocks (those of functions.text.blocks), bytes of each as 32 bits, and their number."""
    held = Counter(_BLOCK.findall(text))
    sizes = np.fromiter((len(b) * n for b, n in held.items()), "<u4", len(held))
    return b"".join(blake2b(b, digest_size=KEY).digest() for b in held), sizes.tobytes(), len(held)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (is_left, id, oid, size, text) with keys, bytes and n instead of texts. Copies that a task meets again among SEEN blobs go here; the others' rows are equal."""
    seen: set[tuple[bool, str]] = set()
    for batch in batches:
        for at, n in cuts(tuple(batch.columns)):
            part = batch.slice(at, n)
            new = []
            for x in zip(part.column("is_left").to_pylist(), part.column("oid").to_pylist()):
                new.append(x not in seen)
                if len(seen) < SEEN:
                    seen.add(x)
            part = part.filter(pa.array(new))
            keys, held, blocks = zip(*[signature(t) for t in part.column("text").to_pylist()]) if len(part) else ((), (), ())
            columns = [*part.columns[:4], pa.array(keys, pa.binary()), pa.array(held, pa.binary()), pa.array(blocks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["is_left", "id", "oid", "size", "keys", "bytes", "n"])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as all their first bytes, then all second ones and so on, which packs well where they are small."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEY)


def _counts(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of each batch and side by their 32-bit numbers, in 2**bits ranges: rising numbers by their differences, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left in (True, False):
                keys = _keys(batch.column("keys").filter(pa.compute.equal(batch.column("is_left"), left)))
                found, n = np.unique(np.ascontiguousarray(keys[:, :4]).view(">u4").ravel().astype(np.uint32), return_counts=True)
                ends = np.searchsorted(found, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(32 - bits))
                rows = [(i, left, _planes(np.diff(x, prepend=np.uint32(0))), _planes(c)) for i, (x, c) in enumerate(zip(np.split(found, ends), np.split(n, ends))) if len(x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["range", "is_left", "numbers", "counts"])

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """Numbers of one range with more than FEW pairs of a left and a right blob that have them."""
    sides = []
    for left in (True, False):
        rows = table.filter(pa.compute.equal(table.column("is_left"), left)).to_pydict()
        found = np.concatenate([np.zeros(0, np.uint32)] + [np.cumsum(_numbers(x), dtype=np.uint32) for x in rows["numbers"]])
        n = np.concatenate([np.zeros(0, np.int64)] + [_numbers(c).astype(np.int64) for c in rows["counts"]])
        order = np.argsort(found, kind="stable")
        found, n = found[order], n[order]
        first = np.flatnonzero(np.diff(found, prepend=-1) != 0) if len(found) else np.zeros(0, np.int64)
        sides.append((found[first], np.add.reduceat(n, first) if len(first) else n))
    (a, x), (b, y) = sides
    number, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    pairs = x[i] * y[j]
    many = pairs > FEW
    return pa.table({"number": number[many].astype(np.int64), "pairs": pairs[many]})


def _order(whole: DataFrame, blocks: int, keep: Materialised) -> tuple[np.ndarray, np.ndarray]:
    """(rising 32-bit numbers, pairs each makes) of the blocks that make most pairs, PLACED at most."""
    bits = min(16, max(4, (blocks // COUNTED).bit_length()))
    ranges = whole.select("is_left", "keys").mapInArrow(_counts(bits), "range int, is_left boolean, numbers binary, counts binary")
    frequent = keep(ranges.groupBy("range").applyInArrow(_frequent, "number long, pairs long"))
    sizes = {r.size: r.n for r in frequent.groupBy(F.floor(F.log2("pairs")).alias("size")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, 0
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        if total > PLACED:
            least = size + 1
            break
    found = frequent.where(F.floor(F.log2("pairs")) >= least).toArrow()
    number, pairs = (found.column(c).to_numpy() for c in ("number", "pairs"))
    by = np.argsort(number)
    return number[by].astype(np.uint32), pairs[by]


def _early(threshold: int, number: np.ndarray, pairs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (is_left, no, before, id, size) of the blocks by which a blob is sought; ``before`` is the number of the block one place earlier, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("keys"))
            blob = np.repeat(np.arange(len(batch)), batch.column("n").to_numpy())
            held = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), "<u4").astype(np.int64)
            size = batch.column("size").to_numpy()
            no = np.ascontiguousarray(keys[:, :8]).view(">u8").ravel().astype(np.uint64)
            makes = np.zeros(len(no), np.int64)
            if len(number):
                short = (no >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(number, short), len(number) - 1)
                makes = np.where(number[at] == short, pairs[at], 0)
            order = np.lexsort((no, -makes, blob))  # in each blob the blocks that make most pairs first
            no, blob, held = no[order], blob[order], held[order]
            ends = np.cumsum(held)
            starts = np.searchsorted(blob, np.arange(len(batch)))
            behind = ends - (ends[starts[blob]] - held[starts[blob]]) if len(blob) else ends
            last = np.append((no[1:] != no[:-1]) | (blob[1:] != blob[:-1]), True)[: len(no)]  # one of blocks of one number in a blob
            no, blob, behind = no[last], blob[last], behind[last]
            early = behind * 100 >= size[blob] * (threshold + 1)
            none = np.append(blob[1:] != blob[:-1], True)[: len(no)]
            before = pa.array(np.append(no[1:], np.uint64(0))[: len(no)].view(np.int64), mask=none).filter(pa.array(early))
            of = pa.array(blob[early])
            yield pa.RecordBatch.from_arrays([batch.column("is_left").take(of), pa.array(no[early].view(np.int64)), before, batch.column("id").take(of), batch.column("size").take(of)], names=["is_left", "no", "before", "id", "size"])

    return run


def _scored(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores above ``threshold`` from a stream by buckets: right blobs, which are held, then left ones with the ids of right ones that they may match."""
    names = ["left_oid", "right_oid", "score"]

    def of(keys: bytes, held: bytes) -> Iterator[tuple[bytes, int]]:
        return zip(np.frombuffer(keys, f"S{KEY}").tolist(), np.frombuffer(held, "<u4").tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, right, found = None, {}, ([], [], [])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.string(), pa.int32()))], names=names)
        for batch in batches:
            for i in range(len(batch)):
                at, left, id_, oid, size, keys, held, partners = (c[i].as_py() for c in batch.columns)
                if at != bucket:
                    bucket, right = at, {}
                if not left:
                    right.setdefault(id_, {}).setdefault(oid, (size, keys, held))
                    continue
                mine = dict(of(keys, held))
                for partner in partners:
                    for other, (other_size, theirs, count) in right.get(partner, {}).items():
                        common = sum(min(n, mine.get(k, 0)) for k, n in of(theirs, count))
                        score = common * 100 // max(size, other_size)
                        if score > threshold:
                            for column, x in zip(found, (oid, other, score)):
                                column.append(x)
                    if len(found[0]) >= BATCH:
                        yield flush()
                        found = ([], [], [])
        if found[0]:
            yield flush()

    return run


def similar(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(left_oid, right_oid, score) of all pairs of blobs (oid, data) with a score above ``threshold``. Rows of one oid on one side are one blob.

    A score above it needs a share of each blob's bytes in common. Blocks stand in one order, those that make most pairs last. The first block
    that two blobs share has all their common bytes at or behind it, so pairs are sought only by blocks with that many bytes at or behind
    them in both blobs: a block that very many blobs have is used only by blobs that consist of such. Where both blobs also have the block one place
    before in common, that one has found the pair. What pairs have in common is counted over all their blocks, by their whole keys; right blobs go to
    buckets, and a left one goes once to each bucket that has partners of it, however many they are.
    """
    spark = left.sparkSession
    ship(spark)
    keep = Materialised(spark, "similar")
    sides = None
    for is_left, side in ((True, left), (False, right)):
        size, text = F.octet_length("data").cast("long"), F.encode("data", "UTF-8")
        part = side.where("data is not null").select(F.lit(is_left).alias("is_left"), F.xxhash64("oid").alias("id"), "oid", size.alias("size"), text.alias("text"))
        sides = part if sides is None else sides.unionByName(part)
    whole = keep(sides.mapInArrow(_signed, "is_left boolean, id long, oid string, size long, keys binary, bytes binary, n int"))
    blocks, held = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("if(is_left, 0, n)")), F.lit(0))).first()
    sought = "is_left boolean, no long, before long, id long, size long"
    early = whole.select("is_left", "id", "size", "keys", "bytes", "n").mapInArrow(_early(threshold, *_order(whole, blocks, keep)), sought)
    # Copies have equal rows. The rows are dealt by blocks first, so that what follows moves none of them.
    a, b = (early.where(f"is_left = {side}").select("no", "before", "id", "size").repartition("no").dropDuplicates().toDF("no", f"{x}_before", x, f"{x}_size") for side, x in (("true", "a"), ("false", "b")))
    fits = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * (threshold + 1)
    pairs = a.join(b, "no").where(fits & F.coalesce(F.col("a_before") != F.col("b_before"), F.lit(True))).select("a", "b")
    buckets = max(32, held * (KEY + 4) // HELD)
    bucket = lambda id_: F.expr(f"int(pmod({id_}, {buckets}))")
    partners = pairs.repartition("a").groupBy(F.col("a").alias("id"), bucket("b").alias("bucket")).agg(F.collect_set("b").alias("partners"))
    lefts = whole.where("is_left").repartition("id").dropDuplicates(["id", "oid"]).join(partners, "id")
    rights = whole.where("not is_left").withColumn("bucket", bucket("id")).withColumn("partners", F.lit(None).cast("array<long>"))
    columns = ["bucket", "is_left", "id", "oid", "size", "keys", "bytes", "partners"]
    stream = rights.select(*columns).unionByName(lefts.select(*columns)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "is_left")
    scored = stream.mapInArrow(_scored(threshold), "left_oid string, right_oid string, score int")
    empty = lambda side: whole.where(f"is_left = {side} and size = 0").select("oid").distinct()
    none = empty("true").select(F.col("oid").alias("left_oid")).join(empty("false").select(F.col("oid").alias("right_oid")), F.lit(100) > threshold)
    return scored.unionByName(none.select("left_oid", "right_oid", F.lit(100).alias("score")))
