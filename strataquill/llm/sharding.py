"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are permuted within their input partition (a local sort by a random number) and written with their
   partition and rank.
2. How many rows each partition sends to each shard is drawn at once: the matrix of counts that a uniformly random
   permutation would give, row by row from the multivariate hypergeometric law of what the shards still lack.
   Only the partitions' row counts reach the driver.
3. A row's rank and its partition's cumulative counts name its shard, without any sort over all rows.
4. Within each shard rows are permuted again: a second random number deals them to sub-blocks of bounded size, which
   are sorted one by one; a block's first slot is the number of rows in the shard's blocks before it.

Everything on the path of the rows is a DataFrame expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.llm._store import Scratch


def draw_matrix(rows_in: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts by partition and shard with the given row sums and column sums at most one apart."""
    total = sum(rows_in)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows_in), shards), np.int64)
    for p, n in enumerate(rows_in):
        # One hypergeometric count after another, so cost does not follow the row counts.
        rest = n
        for s in range(shards - 1):
            behind = int(left[s + 1 :].sum())
            x = int(_hypergeometric(rng, int(left[s]), behind, rest))
            out[p, s] = x
            rest -= x
        out[p, shards - 1] = rest
        left -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return min(sample, good)
    if good + bad < 1_000_000_000:  # the generator's own limit
        return int(rng.hypergeometric(good, bad, sample))
    return large_hypergeometric(rng, good, bad, sample)


def _stirling(n: float) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x * log(x / mean) + mean - x, without loss where the two are close."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        new = total + term / (2 * j + 1)
        if new == total:
            return new
        total, j = new, j + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log-probability of x of n, by Stirling's formula and deviances, as accurate for large numbers as for small ones."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    lead = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return lead - 0.5 * (math.log(2 * math.pi * x) + math.log1p(-x / n))


def log_hypergeometric(x: int, good: int, bad: int, sample: int) -> float:
    """Log-probability of x good ones in a sample."""
    p = sample / (good + bad)
    return _log_binomial(x, good, p) + _log_binomial(sample - x, bad, p) - _log_binomial(sample, good + bad, p)


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric count of any size by rejection from a bound that holds for every log-concave law: flat around the mode, then exponential."""
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    mode = (sample + 1) * (good + 1) // (good + bad + 2)
    top = log_hypergeometric(mode, good, bad, sample)
    peak = math.exp(top)
    flat = 1 + peak / 2
    while True:
        far = rng.random() * flat / peak if rng.random() <= flat / (1 + flat) else (flat + rng.exponential()) / peak
        x = mode + (1 if rng.random() < 0.5 else -1) * round(far)
        if low <= x <= high:
            bound = min(0.0, flat - peak * far)
            if math.log(rng.random() or 5e-324) + bound <= log_hypergeometric(x, good, bad, sample) - top:
                return x


def shard(df: DataFrame, shards: int = 16, seed: int = 7, block_rows: int = 65536) -> DataFrame:
    """All columns of ``df`` with shard (int, from 0) and slot (long, from 0 without gaps in each shard).

    Shards' row counts differ by one at most, whatever the rows hold: nulls, equal rows and hot values have no part in
    the assignment; very long texts are carried as they are. An empty table gives an empty result. Input columns of any name are carried in a
    struct, so none clashes; an input column named shard or slot is returned as own_shard or own_slot.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    local = df.select(row, F.rand(seed).alias("u1"), F.rand(seed + 1).alias("u2")).sortWithinPartitions("u1")
    local = local.select("row", "u2", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("rank"))
    local = scratch.write(local, "local")
    counts = sorted((r.part, r.n) for r in local.groupBy("part").agg(F.count("*").alias("n")).collect())
    matrix = draw_matrix([n for _, n in counts], shards, seed)
    total = int(matrix.sum())
    bounds = spark.createDataFrame([(p, np.cumsum(m).tolist()) for (p, _), m in zip(counts, matrix)], "part int, bounds array<long>")
    # 128 bytes for each input partition: sent whole up to 64 K partitions (8 MB), else joined by partition.
    joined = local.join(F.broadcast(bounds) if len(counts) <= 65536 else bounds, "part")
    dealt = joined.withColumn("shard", sum((F.col("rank") >= F.col("bounds")[s]).cast("int") for s in range(shards)).cast("int"))
    blocks = max(1, -(-total // (shards * block_rows)))
    dealt = dealt.select("row", "u2", "part", "rank", "shard", F.least(F.floor(F.col("u2") * blocks).cast("int"), F.lit(blocks - 1)).alias("block"))
    sizes = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "block", F.coalesce("first", F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("u2", "part", "rank")) - 1
    placed = dealt.withColumn("inside", inside).join(before, ["shard", "block"])
    return placed.select(*[F.col("row").getField(c).alias(f"own_{c}" if c.lower() in ("shard", "slot") else c) for c in df.columns], "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"))


def op4_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``, with its size and checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
