"""Packs, pack indexes, multi-pack indexes and bitmap files, as rows and back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import codecs
from strataquill.functions import objects as O
from strataquill.plans.lineage import Materialised
from strataquill.shipping import ship

TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs_delta", 7: "ref_delta"}
NUMBERS = {v: k for k, v in TYPES.items()}
_MAGIC = b"\377tOc"
#: Names of the hash by its width.
HASHES = {20: "sha1", 32: "sha256"}


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(file, …) rows that ``decode`` gives for each file (path, content); a file is one task's work."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                found = list(decode(bytes(content)))
                if found:
                    out = pd.DataFrame(found, columns=[n.strip() for n in names])
                    out.insert(0, "file", name)
                    yield out

    return files.select("path", "content").mapInPandas(run, f"file string, {schema}")


def encoded(rows: DataFrame, key: str, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(path, content): a file for each value of ``key``, made of its rows in one task, so a key must not have more rows than a file should hold."""
    ship(rows.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(frame[key].iloc[0])], "content": [encode(frame)]})

    return rows.groupBy(key).applyInPandas(run, "path string, content binary")


def rows_of(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(file, …) rows that ``decode`` gives for each file's bytes; files are spread over tasks."""
    return decoded(spark.read.format("binaryFile").load(path), decode, schema)


# Indexes -----------------------------------------------------------------------------------------------------


def parse_index(data: bytes, id_bytes: int = 20) -> Iterator[tuple[str, int, int | None]]:
    """(id, offset, crc32) of a pack index of version 1, 2 or 3, in order of ids."""
    if not data.startswith(_MAGIC):
        (n,) = struct.unpack_from(">L", data, 255 * 4)
        for i in range(n):
            at = 1024 + i * (4 + id_bytes)
            yield data[at + 4 : at + 4 + id_bytes].hex(), struct.unpack_from(">L", data, at)[0], None
        return
    (version,) = struct.unpack_from(">L", data, 4)
    head, width = 8, id_bytes
    if version == 3:
        kind, width = struct.unpack_from(">LL", data, 8)
        head = 16
        if kind not in (1, 2):
            raise ValueError(f"hash format {kind}")
    elif version != 2:
        raise ValueError(f"index version {version}")
    (n,) = struct.unpack_from(">L", data, head + 255 * 4)
    ids = head + 1024
    crcs, offsets = ids + n * width, ids + n * width + 4 * n
    large = offsets + 4 * n
    for i in range(n):
        (offset,) = struct.unpack_from(">L", data, offsets + 4 * i)
        if offset & 0x80000000:
            (offset,) = struct.unpack_from(">Q", data, large + 8 * (offset & 0x7FFFFFFF))
        yield data[ids + i * width : ids + (i + 1) * width].hex(), offset, struct.unpack_from(">L", data, crcs + 4 * i)[0]


def write_index(entries: list[tuple[str, int, int | None]], pack_sha: bytes, version: int = 2) -> bytes:
    """A pack index of (id, offset, crc32) rows."""
    rows = sorted(entries)
    ids = [bytes.fromhex(o) for o, _, _ in rows]
    counts = [0] * 256
    for o in ids:
        counts[o[0]] += 1
    fan, total = [], 0
    for c in counts:
        total += c
        fan.append(total)
    out = struct.pack(">256L", *fan)
    if version == 1:
        if any(o > 0xFFFFFFFF for _, o, _ in rows):
            raise ValueError("offset too large for version 1")
        out += b"".join(struct.pack(">L", off) + o for o, (_, off, _) in zip(ids, rows))
    else:
        head = _MAGIC + struct.pack(">L", version)
        if version == 3:
            head += struct.pack(">LL", {20: 1, 32: 2}[len(pack_sha)], len(pack_sha))
        large = [off for _, off, _ in rows if off >= 1 << 31]
        place = {off: i for i, off in enumerate(large)}
        out = head + out + b"".join(ids) + b"".join(struct.pack(">L", c or 0) for _, _, c in rows)
        out += b"".join(struct.pack(">L", off if off < 1 << 31 else 0x80000000 | place[off]) for _, off, _ in rows)
        out += b"".join(struct.pack(">Q", off) for off in large)
    out += pack_sha
    return out + hashlib.sha1(out).digest()


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """(file, oid, offset, crc32) of all pack indexes at a path."""
    return rows_of(spark, path, parse_index, "oid string, offset long, crc32 long")


# Packs -------------------------------------------------------------------------------------------------------


def inflated(view: memoryview, at: int, size: int) -> tuple[bytes, int]:
    """(bytes of a compressed stream at ``at``, the place after it), fed in windows, so that a pack is read once."""
    z, out, window = zlib.decompressobj(), [], max(4096, min(size, 1 << 20))
    while not z.eof:
        piece = view[at : at + window]
        if not len(piece):
            raise ValueError("a compressed stream ends too early")
        out.append(z.decompress(piece))
        at += len(piece) - len(z.unused_data)
    return b"".join(out), at


def parse_pack(data: bytes, id_bytes: int = 20) -> Iterator[tuple]:
    """(offset, kind, size, base_offset, base_oid, crc32, data) of every stored entry; deltas stay deltas. Ids have 20 or 32 bytes."""
    if data[:4] != b"PACK":
        raise ValueError("not a pack")
    view = memoryview(data)
    version, n = struct.unpack_from(">LL", data, 4)
    if version not in (2, 3):
        raise ValueError(f"pack version {version}")
    at = 12
    for _ in range(n):
        start = at
        byte = data[at]
        at += 1
        kind, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte & 128:
            byte = data[at]
            at += 1
            size |= (byte & 127) << shift
            shift += 7
        base_offset = base_oid = None
        if kind == 6:
            back, at = codecs.read_offset_varint(data, at)
            base_offset = start - back
        elif kind == 7:
            base_oid, at = data[at : at + id_bytes].hex(), at + id_bytes
        body, at = inflated(view, at, size)
        if len(body) != size:
            raise ValueError(f"entry at {start} has {len(body)} bytes for {size}")
        yield start, TYPES[kind], size, base_offset, base_oid, zlib.crc32(view[start:at]), body
    if hashlib.new(HASHES[id_bytes], view[:at]).digest() != data[at : at + id_bytes]:
        raise ValueError("pack checksum differs")


def entry_header(kind: int, size: int) -> bytes:
    out = bytearray([kind << 4 | size & 15])
    size >>= 4
    while size:
        out[-1] |= 128
        out.append(size & 127)
        size >>= 7
    return bytes(out)


def write_pack(objects: list[tuple[str, bytes]], window: int = 0, level: int = -1, id_bytes: int = 20) -> tuple[bytes, list[tuple[str, int, int]]]:
    """(pack, index entries) of (type, data) objects; with a ``window`` each is a delta against one of the last if that is shorter."""
    out = bytearray(b"PACK" + struct.pack(">LL", 2, len(objects)))
    entries, recent = [], []
    for kind, data in objects:
        oid = hashlib.new(HASHES[id_bytes], f"{kind} {len(data)}\0".encode() + data).hexdigest()
        start = len(out)
        best: tuple[bytes, int] | None = None
        for at, k, other in recent[-window:] if window else []:
            if k == kind and len(change := codecs.create_delta(other, data)) < (len(best[0]) if best else len(data) // 2):
                best = change, at
        if best:
            out += entry_header(6, len(best[0])) + codecs.offset_varint(start - best[1]) + zlib.compress(best[0], level)
        else:
            out += entry_header(NUMBERS[kind], len(data)) + zlib.compress(data, level)
            recent.append((start, kind, data))
        entries.append((oid, start, zlib.crc32(out[start:])))
    out += hashlib.new(HASHES[id_bytes], out).digest()
    return bytes(out), entries


def read_packs(spark: SparkSession, path: str, id_bytes: int = 20) -> DataFrame:
    """(file, offset, kind, size, base_offset, base_oid, crc32, data) of all packs at a path. A pack is one task's work and below 2 GB."""
    return rows_of(spark, path, partial(parse_pack, id_bytes=id_bytes), "offset long, kind string, size long, base_offset long, base_oid string, crc32 long, data binary")


def resolve(entries: DataFrame, external: DataFrame | None = None, algorithm: str = "sha1") -> DataFrame:
    """(file, offset, type, oid, data) of all entries with deltas applied, from bases outwards; one join for each link of the longest chain, however long.

    ``external`` (oid, type, data) holds bases outside the packs. Entries whose base is nowhere are left out.
    """
    keep = Materialised(entries.sparkSession, "resolve")

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("oid", O.object_id(F.col("type"), F.col("data"), algorithm)).select("file", "offset", "type", "oid", "data")

    done = keep(named(entries.where("kind not in ('ofs_delta', 'ref_delta')").withColumn("type", F.col("kind"))))
    out, level = [done], done
    deltas = entries.where("kind in ('ofs_delta', 'ref_delta')").select("file", "offset", "base_offset", "base_oid", F.col("data").alias("change"))
    bases = external.select("oid", "type", F.col("data").alias("base")) if external is not None else None
    while True:
        known = level.select("file", F.col("offset").alias("base_offset"), "oid", "type", F.col("data").alias("base"))
        by_place = deltas.join(known.drop("oid"), ["file", "base_offset"])
        ids = known.select(F.col("oid").alias("base_oid"), "type", "base")
        if len(out) == 1 and bases is not None:
            ids = ids.unionByName(bases.select(F.col("oid").alias("base_oid"), "type", "base"))
        by_id = deltas.join(ids.dropDuplicates(["base_oid"]), "base_oid")
        both = by_place.select("file", "offset", "type", "base", "change").unionByName(by_id.select("file", "offset", "type", "base", "change")).dropDuplicates(["file", "offset"])
        level = keep(named(both.select("file", "offset", "type", codecs.undelta(F.col("base"), F.col("change")).alias("data"))).join(out[0].select("file", "offset") if len(out) == 1 else _places(out), ["file", "offset"], "left_anti"))
        if level.isEmpty():
            break
        out.append(level)
        if len(out) > 32:  # few tables, so that a long chain's plans stay small
            out = [keep(reduce(DataFrame.unionByName, out)), level.limit(0)]
    return reduce(DataFrame.unionByName, out)


def _places(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("file", "offset") for p in parts])


# Several packs -----------------------------------------------------------------------------------------------


def chunks(data: bytes, at: int, n: int) -> dict[bytes, tuple[int, int]]:
    """(start, end) of each chunk of a chunked file by its name."""
    rows = [(data[at + 12 * i : at + 12 * i + 4], struct.unpack_from(">Q", data, at + 12 * i + 4)[0]) for i in range(n + 1)]
    return {name: (start, rows[i + 1][1]) for i, (name, start) in enumerate(rows[:-1])}


def chunked(head: bytes, parts: list[tuple[bytes, bytes]]) -> bytes:
    """A chunked file behind ``head``, with its checksum."""
    at = len(head) + 12 * (len(parts) + 1)
    table = b""
    for name, body in parts:
        table += name + struct.pack(">Q", at)
        at += len(body)
    out = head + table + b"\0\0\0\0" + struct.pack(">Q", at) + b"".join(b for _, b in parts)
    return out + hashlib.sha1(out).digest()


def _fan(ids: list[bytes]) -> bytes:
    counts = [0] * 256
    for i in ids:
        counts[i[0]] += 1
    total, out = 0, []
    for c in counts:
        total += c
        out.append(total)
    return struct.pack(">256L", *out)


def parse_midx(data: bytes) -> Iterator[tuple[str, str, int]]:
    """(id, pack, offset) of a multi-pack index."""
    if data[:4] != b"MIDX":
        raise ValueError("not a multi-pack index")
    width = {1: 20, 2: 32}[data[5]]
    part = chunks(data, 12, data[6])
    names = data[part[b"PNAM"][0] : part[b"PNAM"][1]].rstrip(b"\0").split(b"\0")
    (n,) = struct.unpack_from(">L", data, part[b"OIDF"][0] + 255 * 4)
    ids, places = part[b"OIDL"][0], part[b"OOFF"][0]
    for i in range(n):
        pack, offset = struct.unpack_from(">LL", data, places + 8 * i)
        if offset & 0x80000000 and b"LOFF" in part:
            (offset,) = struct.unpack_from(">Q", data, part[b"LOFF"][0] + 8 * (offset & 0x7FFFFFFF))
        yield data[ids + i * width : ids + (i + 1) * width].hex(), names[pack].decode(), offset


def write_midx(packs: dict[str, list[tuple[str, int]]]) -> bytes:
    """A multi-pack index of (id, offset) rows by pack; an id in several packs is taken from the first name."""
    names = sorted(packs)
    best: dict[str, tuple[int, int]] = {}
    for k, name in enumerate(names):
        for oid, offset in packs[name]:
            best.setdefault(oid, (k, offset))
    rows = sorted(best.items())
    ids = [bytes.fromhex(o) for o, _ in rows]
    large = [off for _, (_, off) in rows if off >= 1 << 31]
    place = {off: i for i, off in enumerate(large)}
    name = b"".join(n.encode() + b"\0" for n in names)
    name += b"\0" * (-len(name) % 4)
    parts = [(b"PNAM", name), (b"OIDF", _fan(ids)), (b"OIDL", b"".join(ids)), (b"OOFF", b"".join(struct.pack(">LL", k, off if off < 1 << 31 else 0x80000000 | place[off]) for _, (k, off) in rows))]
    if large:
        parts.append((b"LOFF", b"".join(struct.pack(">Q", o) for o in large)))
    return chunked(b"MIDX" + bytes([1, 1, len(parts), 0]) + struct.pack(">L", len(names)), parts)


def read_midx(spark: SparkSession, path: str) -> DataFrame:
    return rows_of(spark, path, parse_midx, "oid string, pack string, offset long")


# Bitmaps -----------------------------------------------------------------------------------------------------


def write_bitmaps(pack_sha: bytes, types: dict[str, set[int]], entries: list[tuple[int, set[int]]], size: int) -> bytes:
    """A bitmap file: four bitsets by type, then (position of the commit, reachable positions) rows."""
    out = b"BITM" + struct.pack(">HHL", 1, 1, len(entries)) + pack_sha
    out += b"".join(codecs.ewah_encode(types.get(t, set()), size) for t in ("commit", "tree", "blob", "tag"))
    for at, bits in entries:
        out += struct.pack(">LBB", at, 0, 0) + codecs.ewah_encode(bits, size)
    return out + hashlib.sha1(out).digest()


def parse_bitmaps(data: bytes) -> Iterator[tuple[str, int | None, list[int]]]:
    """(kind, commit position, set positions): kind is a type of objects, or 'reach'; compressed entries are resolved."""
    if data[:4] != b"BITM":
        raise ValueError("not a bitmap file")
    version, _, n = struct.unpack_from(">HHL", data, 4)
    if version != 1:
        raise ValueError(f"bitmap version {version}")
    at = 32
    for kind in ("commit", "tree", "blob", "tag"):
        bits, at = codecs.ewah_decode(data, at)
        yield kind, None, sorted(bits)
    done: list[set[int]] = []
    for _ in range(n):
        place, back, _ = struct.unpack_from(">LBB", data, at)
        bits, at = codecs.ewah_decode(data, at + 6)
        if back:
            bits = bits ^ done[-back]
        done.append(bits)
        yield "reach", place, sorted(bits)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return rows_of(spark, path, parse_bitmaps, "kind string, commit_pos long, positions array<long>")


# Commit graphs -----------------------------------------------------------------------------------------------

_NONE, _MORE, _LAST = 0x70000000, 0x80000000, 0x80000000


def write_commit_graph(rows: list[tuple[str, str, list[str], int, int]]) -> bytes:
    """A commit graph of (id, tree, parents, generation, time) rows; parents outside are left out."""
    rows = sorted(rows)
    at = {r[0]: i for i, r in enumerate(rows)}
    ids = [bytes.fromhex(r[0]) for r in rows]
    data, extra = b"", []
    for _, tree, parents, generation, time in rows:
        places = [at[p] for p in parents if p in at]
        one = places[0] if places else _NONE
        two = _NONE if len(places) < 2 else places[1]
        if len(places) > 2:
            two = _MORE | len(extra)
            extra += [*places[1:-1], places[-1] | _LAST]
        data += bytes.fromhex(tree) + struct.pack(">LLQ", one, two, generation << 34 | time)
    parts = [(b"OIDF", _fan(ids)), (b"OIDL", b"".join(ids)), (b"CDAT", data)]
    if extra:
        parts.append((b"EDGE", struct.pack(f">{len(extra)}L", *extra)))
    return chunked(b"CGPH" + bytes([1, 1, len(parts), 0]), parts)


def parse_commit_graph(data: bytes) -> Iterator[tuple[str, str, list[str], int, int]]:
    """(id, tree, parents, generation, time) of a commit graph."""
    if data[:4] != b"CGPH":
        raise ValueError("not a commit graph")
    width = {1: 20, 2: 32}[data[5]]
    part = chunks(data, 8, data[6])
    (n,) = struct.unpack_from(">L", data, part[b"OIDF"][0] + 255 * 4)
    ids = [data[part[b"OIDL"][0] + i * width : part[b"OIDL"][0] + (i + 1) * width].hex() for i in range(n)]
    for i in range(n):
        at = part[b"CDAT"][0] + i * (width + 16)
        one, two, packed = struct.unpack_from(">LLQ", data, at + width)
        places = [] if one == _NONE else [one]
        if two & _MORE:
            edge = part[b"EDGE"][0] + 4 * (two & 0x7FFFFFFF)
            while True:
                (e,) = struct.unpack_from(">L", data, edge)
                places.append(e & 0x7FFFFFFF)
                edge += 4
                if e & _LAST:
                    break
        elif two != _NONE:
            places.append(two)
        yield ids[i], data[at : at + width].hex(), [ids[p] for p in places], packed >> 34, packed & (1 << 34) - 1


def read_commit_graphs(spark: SparkSession, path: str) -> DataFrame:
    return rows_of(spark, path, parse_commit_graph, "oid string, tree string, parents array<string>, generation long, commit_time long")
