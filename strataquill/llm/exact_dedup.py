"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Every input partition is a *sender*. Its rows are written once, in place, as a table bucketed by sender, so
   that later joins on the sender find them without a shuffle of texts.
2. A sender sorts its distinct fingerprints and sends each *owner* of a range of fingerprints the gaps between
   them in a Golomb code (parameter a power of two), with one bit for values that repeat within the sender.
3. The owner decodes all lists, marks values that more than one row holds and replies a bitmap per sender.
4. The sender turns its bitmaps into one bit per row. Only rows with a set bit (*suspects*) are shuffled, by
   digest, for verification of their bytes: a digest whose smallest and largest text are the same string is one
   class. Should a digest hold different texts, those rows are grouped again by the text itself.

A fingerprint has log2(rows) + 8 bits, so about one row in 256 becomes a suspect by chance; suspects that
turn out to be alone are whole classes of one. Nothing of a hot group meets in one task: senders list a value
once, and verification aggregates partially before it shuffles.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm._store import Scratch, shuffle_width

SPACES = r"[\x20\x09-\x0D]+"


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct values below 2**bits as n, k, unary quotients and k-bit remainders of their gaps."""
    n = len(values)
    if n == 0:
        return b"\0" * 5
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    mean = max(1.0, (1 << bits) / n * math.log(2))
    k = max(0, min(56, math.ceil(math.log2(mean))))
    top, low = gaps >> k, gaps & ((1 << k) - 1)
    ends = np.cumsum(top + 1)
    unary = np.zeros(int(ends[-1]), dtype=bool)
    unary[ends - 1] = True
    rest = ((low[:, None] >> np.arange(k)) & 1).astype(bool).ravel()
    return n.to_bytes(4, "little") + bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    """Inverse of golomb_encode."""
    n, k = int.from_bytes(blob[:4], "little"), blob[4]
    if n == 0:
        return np.zeros(0, np.int64)
    tail = (n * k + 7) // 8
    body = np.frombuffer(blob, np.uint8)[5:]
    ones = np.flatnonzero(np.unpackbits(body[: len(body) - tail]))
    top = np.diff(ones, prepend=-1) - 1
    low = np.zeros(n, np.int64)
    if k:
        low = (np.unpackbits(body[len(body) - tail :])[: n * k].reshape(n, k).astype(np.int64) << np.arange(k)).sum(axis=1)
    return np.cumsum((top.astype(np.int64) << k) + low + 1) - 1


def _send(shift: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        sender = table.column("sender")[0].as_py()
        values, counts = np.unique(table.column("fp").to_numpy(), return_counts=True)
        owners = values >> shift
        ids, at = np.unique(owners, return_index=True)
        cut = np.append(at, len(values))
        rows = [(sender, int(o), golomb_encode(values[a:b] - (int(o) << shift), shift), np.packbits(counts[a:b] > 1).tobytes()) for o, a, b in zip(ids, cut, cut[1:])]
        return pa.table({c: [r[i] for r in rows] for i, c in enumerate(("sender", "owner", "list", "again"))}, pa.schema([("sender", pa.int32()), ("owner", pa.int64()), ("list", pa.binary()), ("again", pa.binary())]))

    return send


def _own(table: pa.Table) -> pa.Table:
    lists = [golomb_decode(x) for x in table.column("list").to_pylist()]
    again = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(v)].astype(bool) for x, v in zip(table.column("again").to_pylist(), lists)]
    _, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    back = back.ravel()
    local = np.zeros(len(counts), bool)
    local[back[np.concatenate(again)]] = True
    hit, out, p = (local | (counts > 1))[back], [], 0
    for v in lists:
        out.append(np.packbits(hit[p : p + len(v)]).tobytes())
        p += len(v)
    return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "n": pa.array([len(v) for v in lists], pa.int32()), "bits": pa.array(out, pa.binary())})


def _apply(rows: pa.Table, replies: pa.Table) -> pa.Table:
    schema = pa.schema([("sender", pa.int32()), ("words", pa.list_(pa.int64()))])
    if rows.num_rows == 0:
        return schema.empty_table()
    _, back = np.unique(rows.column("fp").to_numpy(), return_inverse=True)
    replies = replies.sort_by("owner")
    hit = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for n, b in zip(replies.column("n").to_pylist(), replies.column("bits").to_pylist())]).astype(bool)
    pos = rows.column("pos").to_numpy()
    row = np.zeros((int(pos.max()) // 64 + 1) * 64, np.uint8)
    row[pos] = hit[back.ravel()]
    packed = np.packbits(row, bitorder="little").view("<i8")
    return pa.table({"sender": rows.column("sender").slice(0, 1), "words": pa.array([packed], schema.field("words").type)}, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra_bits: int = 8, digest_bytes: int = 32) -> DataFrame:
    """One row per input row: ``row`` (struct of all input columns), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; a null text counts
    as the empty text. Of equal texts the row with the smallest id stays (null ids come last, and among rows with
    one id exactly one stays). An empty table gives an empty result; further columns of any name are carried in
    ``row``. ``digest_bytes`` shortens the digest by which suspects are grouped, which tests use to force collisions.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    width = min(shuffle_width(spark), 65536)
    name = f"sq_rows_{uuid.uuid4().hex[:12]}"

    def norm(c):
        return F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " ")

    spread = docs.select(F.spark_partition_id().alias("sender"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"), F.unhex(F.sha2(norm(F.col(text_col)), 256)).alias("sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spread.write.option("compression", "zstd").option("path", scratch.path("rows")).bucketBy(width, "sender").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan knows files and buckets; the table's name need not stay in the catalog
    n = rows.count()
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2))) + extra_bits))
    shift = max(0, bits - int(math.log2(width)))
    fp = rows.select("sender", "pos", F.shiftrightunsigned(F.xxhash64("sha"), 64 - bits).alias("fp"))
    lists = fp.groupBy("sender").applyInArrow(_send(shift, bits), "sender int, owner long, list binary, again binary")
    replies = lists.groupBy("owner").applyInArrow(_own, "sender int, owner long, n int, bits binary")
    bitmaps = scratch.write(fp.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(_apply, "sender int, words array<long>"), "bitmaps")

    flagged = rows.join(bitmaps.hint("shuffle_hash"), "sender").withColumn("hit", F.expr("getbit(words[int(pos div 64)], int(pos % 64)) = 1")).drop("words").withColumn("key", F.substring("sha", 1, digest_bytes))
    hits = flagged.where("hit")
    doc_id, text = F.col("row").getField(id_col), norm(F.col("row").getField(text_col))
    first = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "sender", "pos")).alias("first")
    classes = scratch.write(hits.select("key", text.alias("text"), "row", "sender", "pos").groupBy("key").agg(F.min("text").alias("a"), F.max("text").alias("b"), first, F.count("*").alias("size")).select("key", (F.col("a") == F.col("b")).alias("same"), "first", "size"), "classes")

    def verdict(joined: DataFrame) -> DataFrame:
        kept = (F.col("first.sender") == F.col("sender")) & (F.col("first.pos") == F.col("pos"))
        return joined.select("row", F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    alone = flagged.where("not hit").select("row", doc_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    out = alone.unionByName(verdict(hits.join(classes.where("same"), "key")))
    if classes.where("not same").take(1):  # a digest with several texts
        mixed = hits.join(classes.where("not same").select("key"), "key", "left_semi").withColumn("text", text)
        by_text = mixed.groupBy("key", "text").agg(first, F.count("*").alias("size"))
        out = out.unionByName(verdict(mixed.join(by_text, ["key", "text"])))
    return out


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its class of equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
