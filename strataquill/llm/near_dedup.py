"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of the set and a signature of
   ``TREES * DEPTH`` minima. Texts with one digest are one node from here on.
2. Each tree is one sorted order of the nodes: by its own ``DEPTH`` minima. Rows are range-partitioned on tree and key, so
   a key that very many nodes share spreads over many tasks.
3. Nodes with a common prefix are a region. A region of at most ``BLOCK`` nodes is compared at once by the
   signatures' agreement. A larger one is met twice: its nodes are set against the region's most typical
   node, in blocks, and the region is divided by the next minimum, as deep as needed. At full depth it is cut
   into overlapping blocks; ties are in another order in each tree.
4. What agrees well enough forms candidate groups, bounded in nodes and in shingles. Equal groups of several trees are one. The
   groups' full shingle sets are fetched and intersected exactly; confirmed links become edges to the group's root.
5. Connected components over the edges give each node its class so far.
6. What large regions, region borders and partition borders left out is met after that, so that the result hangs on none of them:
   the signature is read again as ``BANDS`` cells, and in each cell all nodes of different classes are compared, whatever the cell's
   size. Large cells are dealt out as pairs of blocks over tasks; the nodes of the cell's largest class need not meet each other,
   so a family that hangs together costs nothing. A pair is taken up in the first cell that it shares only. Candidates are confirmed
   as before, and their links join classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm import _text
from strataquill.llm._graph import components
from strataquill.llm._store import Scratch, shuffle_width

TREES = 8
DEPTH = 12
BLOCK = 256
#: How far below the threshold the agreement of two signatures may lie: over four standard deviations.
SLACK = 0.17
#: How far above the threshold the agreement with the typical node of a region must lie for a node to leave the region: it is then linked as a rule,
#: and what its links are needed for is met in the cells.
SURE = 0.02
#: Cells of four minima (their lowest bytes): a link of similarity s has no common cell with odds (1 - s**4)**24, 2e-8 at 0.85 and 3e-6 at 0.8.
BANDS = 24
#: Nodes in each of the two blocks that meet in one unit of a large cell.
HALF = 1024
#: Nodes of a group that is confirmed at once.
GROUP = 1024
#: Sets up to which a shingle's pairs of sets are counted one by one.
FEW = 24
#: Shingles whose sets are held at once to confirm a group; a longer text stands alone or with one other.
FULL = 1 << 18
#: Wanted nodes up to which their texts are found by a bitmap (8 MB at most); beyond, by a join.
MARKED = 1 << 22
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle of all."""
    data, offsets = _text.utf8(texts)
    hashes, _, _, text = _text.words(data, offsets)
    n = len(offsets) - 1
    cut = _text.spans(text, n)
    weights = _text.mix(np.arange(1, size + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if len(hashes) >= size:
        m = len(hashes) - size + 1
        rolled = np.zeros(m, _U)
        for i in range(size):
            rolled += hashes[i : i + m] * weights[i]
        rolled = _text.mix(rolled)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(_text.mix((hashes[a:b] * weights[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], count: int, seed: int = 11) -> np.ndarray:
    """MinHash values (one row for each set) as 32-bit numbers; an empty set has the largest number everywhere."""
    out = np.full((len(sets), count), 0xFFFFFFFF, np.uint32)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (size < 100_000 or end == at):
            size += len(sets[full[end]])
            end += 1
        rows = full[at:end]
        x = (np.concatenate([sets[i] for i in rows]) >> _U(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])[:-1]])
        for j in range(count):
            h = x * a[j]
            h += b[j]
            h ^= h >> np.uint32(15)
            out[rows, j] = np.minimum.reduceat(h * np.uint32(0x2C1B3C6D), starts)
        at = end
    return out


def _sign(size: int, id_type: str):
    schema = f"doc_id {id_type}, text string, n_shingles long, node binary, sig binary, low binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, 1):
            sets = shingle_sets(batch.column(1), size)
            sig = signatures(sets, TREES * DEPTH)
            wide = sig.astype(">u4").tobytes()
            low = (sig & np.uint32(255)).astype(np.uint8).tobytes()
            w = 4 * TREES * DEPTH
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([wide[i * w : (i + 1) * w] for i in range(len(sets))], pa.binary()),
                    pa.array([low[i * w // 4 : (i + 1) * w // 4] for i in range(len(sets))], pa.binary()),
                ],
                ["doc_id", "text", "n_shingles", "node", "sig", "low"],
            )

    return run, schema


def _labels(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix, as the smallest index in it."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(index: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """``index`` cut into blocks of at most ``most`` nodes and FULL shingles; a larger node is a block of its own."""
    ends, at, out = np.cumsum(sizes[index]), 0, []
    while at < len(index):
        before = int(ends[at - 1]) if at else 0
        end = min(at + most, max(at + 1, int(np.searchsorted(ends, before + FULL, side="right"))))
        out.append(index[at:end])
        at = end
    return out


def tiles(label: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, last: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Groups that hold each candidate pair (left, right) at least once: a component each, or pairs of its blocks if it is large.

    ``label`` is the component of each node under the pairs; nodes in ``last`` have no pair among themselves and go to blocks of their own, as far as may be.
    """
    if not len(left):
        return
    order = np.argsort(label[left], kind="stable")
    left, right = left[order], right[order]
    cut = np.flatnonzero(np.diff(label[left])) + 1
    for a, b in zip(np.split(left, cut), np.split(right, cut)):
        nodes = np.unique(np.concatenate([a, b]))
        if len(nodes) <= GROUP and (len(nodes) == 2 or sizes[nodes].sum() <= FULL):
            yield nodes
            continue
        block = np.zeros(nodes[-1] + 1, np.int64)
        if last is not None:
            nodes = nodes[np.argsort(last[nodes], kind="stable")]
        for i, part in enumerate(_blocks(nodes, sizes, GROUP // 2)):
            block[part] = i
        x, y = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
        pair = x * (block.max() + 1) + y
        order = np.argsort(pair, kind="stable")
        at = np.flatnonzero(np.diff(pair[order])) + 1
        for one, other in zip(np.split(a[order], at), np.split(b[order], at)):
            yield np.unique(np.concatenate([one, other]))


class _Regions:
    """Candidate groups of one sorted stretch of nodes that share a tree and the first minimum."""

    def __init__(self, keys: np.ndarray, low: np.ndarray, nodes: list[bytes], sizes: np.ndarray, least: float):
        self.keys, self.low, self.nodes, self.sizes, self.least = keys, low, nodes, sizes, least
        self.groups: list[list[bytes]] = []

    def emit(self, index: np.ndarray) -> None:
        self.groups.append([self.nodes[i] for i in index.tolist()])

    def compare(self, index: np.ndarray) -> None:
        low = self.low[index]
        if len(index) == 2:
            if (low[0] == low[1]).mean() >= self.least:
                self.emit(index)
            return
        near = (low[:, None, :] == low[None, :, :]).mean(axis=2) >= self.least
        left, right = np.nonzero(np.triu(near, 1))
        for part in tiles(_labels(near), left, right, self.sizes[index]):
            self.emit(index[part])

    def typical(self, index: np.ndarray) -> int:
        """The node that agrees most with the commonest value of each place."""
        low = self.low[index]
        mode = np.array([np.bincount(c, minlength=256).argmax() for c in low.T], np.uint8)
        return int(index[(low == mode).sum(axis=1).argmax()])

    def divide(self, index: np.ndarray, depth: int, before: int = -1) -> None:
        """Groups of one region; ``before`` is the typical node of the region around it, with which it has been met."""
        while depth < DEPTH and len(index) > BLOCK and (self.keys[index, depth] == self.keys[index[0], depth]).all():
            depth += 1
        if len(index) < 2:
            return
        if len(index) <= BLOCK:
            self.compare(index)
            return
        middle = self.typical(index)
        agree = (self.low[index] == self.low[middle]).mean(axis=1)
        around = index[(agree >= self.least) & (index != middle)] if middle != before else index[:0]
        for part in _blocks(around, self.sizes, BLOCK):
            self.emit(np.concatenate([[middle], part]))
        rest = index[(agree < self.least + SLACK + SURE) | (index == middle)]
        if depth >= DEPTH or len(rest) <= BLOCK:
            for at in range(0, max(1, len(rest) - 1), BLOCK - 1):
                self.compare(rest[at : at + BLOCK])
            return
        at = np.flatnonzero(np.diff(self.keys[rest, depth].astype(np.int64), prepend=-1))
        for part in np.split(rest, at[1:]):
            self.divide(part, depth + 1, middle)


def _candidates(least: float, stretch: int = 32768):
    """Candidate groups from rows sorted by tree and key; a region over ``stretch`` rows is handled in stretches, which meet in cells only."""
    schema = "gid binary, nodes array<binary>"
    out_schema = pa.schema([("gid", pa.binary()), ("nodes", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(rows: list[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]):
            keys, low = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            nodes, sizes = [x for r in rows for x in r[2]], np.concatenate([r[3] for r in rows])
            at = np.flatnonzero(np.diff(keys[:, 0], prepend=-1))
            ends = np.append(at[1:], len(keys))
            many = np.flatnonzero(ends - at > 1)
            found = _Regions(keys[:, 1:], low, nodes, sizes, least)
            for i in many.tolist():
                found.divide(np.arange(at[i], ends[i]), 1)
            unique = {hashlib.blake2b(b"".join(sorted(g)), digest_size=16).digest(): g for g in found.groups}
            return pa.RecordBatch.from_arrays([pa.array(list(unique), pa.binary()), pa.array(list(unique.values()), out_schema.field("nodes").type)], schema=out_schema)

        held: list = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(batch.num_rows, DEPTH).astype(np.uint32)
            tree = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint32)
            low = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, TREES * DEPTH)
            first = tree.astype(np.int64) << 32 | key[:, 0]
            keys = np.column_stack([first, key.astype(np.int64)])
            held.append((keys, low, batch.column(2).to_pylist(), batch.column(5).to_numpy()))
            size += batch.num_rows
            last = np.flatnonzero(first != first[-1])
            if size >= stretch or (size >= stretch // 4 and len(last)):
                if len(last) and last[-1] + 1 < batch.num_rows:  # the last region may go on in the next batch
                    cut = int(last[-1]) + 1
                    rows = held.pop()
                    yield groups([*held, tuple(x[:cut] for x in rows)])
                    held, size = [tuple(x[cut:] for x in rows)], batch.num_rows - cut
                else:
                    yield groups(held)
                    held, size = [], 0
        if held:
            yield groups(held)

    return run, schema


def _meeting(root: np.ndarray, low: np.ndarray, band: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of the pairs in one unit that agree, have different roots and share no cell before ``band``."""
    names, counts = np.unique(root, return_counts=True)
    top = root == names[counts.argmax()]
    order = np.concatenate([np.flatnonzero(~top), np.flatnonzero(top)])  # rows of the largest class don't meet each other
    low, root, rest = low[order], root[order], int((~top).sum())
    cells = np.ascontiguousarray(low).view(np.uint32)
    lefts, rights = [], []
    step = max(1, 16_000_000 // (low.shape[1] * len(low)))
    for at in range(0, rest, step):
        end = min(rest, at + step)
        near = (low[at:end, None, :] == low[None, at:, :]).sum(axis=2, dtype=np.int32) >= least * low.shape[1]
        i, j = np.nonzero(near)
        i, j = i[j > i] + at, j[j > i] + at
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            first = (cells[a, : band + 1] == cells[b, : band + 1]).argmax(axis=1) == band
            lefts.append(order[a[first]])
            rights.append(order[b[first]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *lefts]), np.concatenate([empty, *rights])


def _components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that pairs lead to, of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(least: float):
    """Candidate groups among nodes of different classes, from rows (unit, node, root, low, n_shingles, band) sorted by unit; a unit is held whole."""
    schema = "gid binary, nodes array<binary>"
    out_schema = pa.schema([("gid", pa.binary()), ("nodes", pa.list_(pa.binary()))])

    def groups(table: pa.Table, at: list[int]) -> pa.RecordBatch:
        nodes, found = table.column(1).to_pylist(), {}
        root, sizes, band = (table.column(i).to_numpy() for i in (2, 4, 5))
        low = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)
        for a, b in zip(at, [*at[1:], len(nodes)]):
            left, right = _meeting(root[a:b], low[a:b], int(band[a]), least)
            names, counts = np.unique(root[a:b], return_counts=True)
            for part in tiles(_components(b - a, left, right), left, right, sizes[a:b], root[a:b] == names[counts.argmax()]):
                g = [nodes[a + i] for i in part.tolist()]
                found[hashlib.blake2b(b"".join(sorted(g)), digest_size=16).digest()] = g
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), out_schema.field("nodes").type)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            unit = table.column(0).to_numpy()
            at = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])).tolist()
            if at[-1]:
                yield groups(table.slice(0, at[-1]), at[:-1])
            held = table.slice(at[-1]).to_batches()  # the last unit may go on in the next batch
        if held:
            yield groups(pa.Table.from_batches(held), [0])

    return run, schema


def _units(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, node, root, low, n_shingles, band): each two nodes of different classes that share a cell are in one unit at least, of about 2 * HALF rows at most.

    Cells whose nodes are all of one class are found by one aggregate over fixed-width numbers and leave at once. ``root`` is a 64-bit hash.
    """
    wide = TREES * DEPTH // BANDS
    nodes = nodes.select("node", "low", "n_shingles", F.xxhash64("root").alias("root"))
    cell = F.explode(F.array(*[F.struct(F.lit(b).cast("byte").alias("band"), F.xxhash64(F.lit(b), F.substring("low", wide * b + 1, wide)).alias("cell")) for b in range(BANDS)]))
    cells = nodes.select(cell.alias("c"), "root", "node").select("c.cell", "c.band", "root", "node")
    mixed = cells.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("cell")
    rows = scratch.write(cells.join(mixed, "cell", "left_semi"), "mixed", "snappy")
    large = rows.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", "n").alias("top")).where(F.col("n") > 2 * HALF)
    rows = rows.join(scratch.write(large, "large", "snappy"), "cell", "left")
    rows = rows.withColumn("tops", F.ceil(F.col("most") / HALF)).withColumn("rests", F.ceil((F.col("n") - F.col("most")) / HALF)).withColumn("h", F.xxhash64("cell", "node"))
    rows = rows.withColumn("is_top", F.col("root") == F.col("top")).withColumn("at", F.when(F.col("is_top"), -1 - F.expr("pmod(h, tops)")).otherwise(F.expr("pmod(h, rests)")))
    pair = lambda a, b: F.xxhash64("cell", a, b)
    rests = F.transform(F.expr("sequence(0L, rests - 1)"), lambda r: F.when(F.col("is_top"), pair(r, F.col("at"))).otherwise(pair(F.least(r, "at"), F.greatest(r, "at"))))
    tops = F.when(F.col("is_top"), F.expr("array()").cast("array<bigint>")).otherwise(F.transform(F.expr("sequence(1L, tops)"), lambda t: pair(F.col("at"), -t)))
    unit = F.when(F.col("n").isNull(), F.array("cell")).otherwise(F.concat(rests, tops))
    return rows.select(F.explode(unit).alias("unit"), "node", "root", "band").join(nodes.select("node", "low", "n_shingles"), "node").select("unit", "node", "root", "low", "n_shingles", "band")


def confirm(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component of each set (smallest index) under links with den * intersection >= num * union."""
    n = len(sets)
    _, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(back, kind="stable")
    owner = np.repeat(np.arange(n), [len(s) for s in sets])[order]
    starts = np.cumsum(counts) - counts
    common = np.zeros((n, n))
    # Shingles of few sets: each pair of their owners is counted.
    held: list[np.ndarray] = []
    for c in range(2, FEW + 1):
        at = starts[counts == c]
        if len(at):
            own = owner[at[:, None] + np.arange(c)]
            for i in range(c - 1):
                held.append((own[:, i, None] * n + own[:, i + 1 :]).ravel())
                if sum(map(len, held)) > 4_000_000:
                    common += np.bincount(np.concatenate(held), minlength=n * n).reshape(n, n)
                    held = []
    if held:
        common += np.bincount(np.concatenate(held), minlength=n * n).reshape(n, n)
    common += common.T
    # Shingles of many sets: columns of a matrix, some at a time.
    many = np.flatnonzero(counts > FEW)
    step = max(1, 8_000_000 // n)
    for at in range(0, len(many), step):
        some = many[at : at + step]
        part = np.zeros((n, len(some)), np.float32)
        rows = np.concatenate([owner[starts[v] : starts[v] + counts[v]] for v in some])
        part[rows, np.repeat(np.arange(len(some)), counts[some])] = 1
        common += part @ part.T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[:, None] + size[None, :] - common
    return _labels(den * common >= num * union)


def _confirm(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        label = confirm([np.frombuffer(x, _U) for x in table.column("members").to_pylist()], num, den)
        pairs = [(nodes[i], nodes[x]) for i, x in enumerate(label.tolist()) if i != x]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.binary()), "v": pa.array([p[1] for p in pairs], pa.binary())})

    return run


def _fetch(size: int, bits: int, bitmap: bytes | None):
    """Shingle sets of texts, by (node, text); with a bitmap, of those whose node may be wanted: it lets through few others."""
    held = None if bitmap is None else np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first: dict[bytes, int] = {}
                for i, x in enumerate(batch.column(0).to_pylist()):
                    p = int.from_bytes(x[:6], "big") & ((1 << bits) - 1)
                    if held is None or held[p >> 3] >> (p & 7) & 1:
                        first.setdefault(x, i)
                if first:
                    yield batch.take(pa.array(list(first.values())))

        for batch in _text.slices(some(batches), 1):
            sets = shingle_sets(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])

    return run


def _bitmap(nodes: DataFrame, bits: int) -> bytes:
    """2**bits bits with those of the nodes' first 48 bits set, built by partial bitmaps; at most 16 MB."""
    place = F.conv(F.hex(F.substring("node", 1, 6)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    parts = nodes.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).collect()
    out = bytearray(max(1, (1 << bits) // 8))
    for r in parts:
        out[r.b * 4096 : r.b * 4096 + 4096] = r.m[: min(4096, len(out))]
    return bytes(out)


def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", stretch: int = 32768) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every input row.

    Documents are linked when den * |intersection| >= num * |union| of their sets of ``words``-word shingles; a text
    of fewer words is one shingle; a null or empty text has none and is linked with nothing. component_id is the smallest id
    of the documents that links reach, itself included; ids may be of any orderable type; rows with one id and one class are all kept or
    all dropped together. A null id is its own component only if every id of the class is null.
    Very long texts are read whole; two of them at once are the most that one task must hold to confirm a link.
    An empty table gives an empty result; other columns are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    run, schema = _sign(words, dict(docs.dtypes)[id_col])
    signed = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "signed")
    full = signed.where("n_shingles > 0")
    classes = scratch.write(full.groupBy("node").agg(F.first("sig").alias("sig"), F.first("low").alias("low"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least")), "classes", "snappy")
    trees = classes.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("key")) for t in range(TREES)])).alias("x"), "low", "node", "n_shingles")
    trees = trees.select("x.key", "low", "node", "x.tree", F.xxhash64("x.tree", "node").alias("tie"), "n_shingles")
    trees = trees.repartitionByRange(shuffle_width(spark), "tree", "key", "tie", "node").sortWithinPartitions("tree", "key", "tie", "node")
    run, schema = _candidates(num / den - SLACK, stretch)
    groups = scratch.write(trees.mapInArrow(run, schema).groupBy("gid").agg(F.first("nodes").alias("nodes")), "groups", "snappy")

    def confirmed(groups: DataFrame) -> DataFrame:
        members = groups.select("gid", F.explode("nodes").alias("node"))
        wanted = members.select("node").distinct()
        n, texts = wanted.count(), full.select("node", "text")
        if n <= MARKED:
            bits = max(15, (16 * max(1, n)).bit_length())
            sets = texts.mapInArrow(_fetch(words, bits, _bitmap(wanted, bits)), "node binary, members binary")
        else:
            sets = texts.join(wanted, "node", "left_semi").mapInArrow(_fetch(words, 0, None), "node binary, members binary")
        sets = sets.groupBy("node").agg(F.first("members").alias("members"))
        return members.join(sets, "node").groupBy("gid").applyInArrow(_confirm(num, den), "u binary, v binary")

    linked = components(confirmed(groups), scratch)
    nodes = classes.select("node", "low", "n_shingles", "least").join(linked, "node", "left")
    nodes = scratch.write(nodes.select("node", "low", "n_shingles", "least", F.coalesce("root", "node").alias("root")), "nodes", "snappy")
    run, schema = _meet(num / den - SLACK)
    units = _units(nodes, scratch).repartition(shuffle_width(spark), "unit").sortWithinPartitions("unit", "node")
    more = units.mapInArrow(run, schema).groupBy("gid").agg(F.first("nodes").alias("nodes")).join(groups.select("gid"), "gid", "left_anti")
    more = scratch.write(more, "more", "snappy")
    labelled = nodes.select("node", "least", "root")
    if not more.isEmpty():
        edges = scratch.write(confirmed(more), "edges", "snappy")
        if not edges.isEmpty():
            for end in ("u", "v"):
                edges = edges.join(nodes.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
            joined = components(edges.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")), Scratch(spark, "near-dedup-more"))
            joined = joined.select(F.col("node").alias("root"), F.col("root").alias("whole"))
            labelled = scratch.write(labelled.join(joined, "root", "left").select("node", "least", F.coalesce("whole", "root").alias("root")), "labelled", "snappy")
    lowest = labelled.where("root <> node").groupBy("root").agg(F.min("least").alias("other"))
    roots = labelled.where("root = node").join(lowest, "root", "left").select("root", F.least("least", "other").alias("component"))
    of_node = scratch.write(labelled.join(roots, "root").select("node", "component"), "of_node", "snappy")
    some = full.select("doc_id", "n_shingles", "node").join(of_node, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    for done in ("classes", "groups", "nodes", "mixed", "large", "more", "edges", "labelled"):
        scratch.drop(done)
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash_lsh_forest(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and its class of near copies."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(x) AS x FROM (
    SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
      ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS x FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s t ON s.x = t.x AND s.doc_id <> t.doc_id GROUP BY 1, 2) p
  JOIN n ON n.doc_id = p.a JOIN n m ON m.doc_id = p.b WHERE 100 * p.c >= 85 * (n.n + m.n - p.c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
