"""Staging indexes, ref tables, bundles, fast-export streams and archives, as rows and back."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from strataquill.functions import codecs
from strataquill.sources import packs

# Staging index -----------------------------------------------------------------------------------------------

INDEX_FIELDS = ("ctime", "ctime_ns", "mtime", "mtime_ns", "dev", "ino", "mode", "uid", "gid", "size", "oid", "flags", "extended", "path", "stage")
INDEX_SCHEMA = "ctime long, ctime_ns long, mtime long, mtime_ns long, dev long, ino long, mode int, uid long, gid long, size long, oid string, flags int, extended int, path string, stage int"


def parse_staging(data: bytes) -> Iterator[tuple]:
    """INDEX_FIELDS of every entry of a staging index of version 2, 3 or 4."""
    if data[:4] != b"DIRC":
        raise ValueError("not a staging index")
    version, n = struct.unpack_from(">LL", data, 4)
    if version not in (2, 3, 4):
        raise ValueError(f"staging index version {version}")
    at, path = 12, b""
    for _ in range(n):
        start = at
        numbers = struct.unpack_from(">10L", data, at)
        oid = data[at + 40 : at + 60].hex()
        (flags,) = struct.unpack_from(">H", data, at + 60)
        at += 62
        extended = 0
        if flags & 0x4000:
            (extended,) = struct.unpack_from(">H", data, at)
            at += 2
        if version == 4:
            cut, at = codecs.read_offset_varint(data, at)
            end = data.index(b"\0", at)
            path = path[: len(path) - cut] + data[at:end]
            at = end + 1
        else:
            end = data.index(b"\0", at)
            path = data[at:end]
            at = start + ((end - start + 8) // 8) * 8
        yield (*numbers, oid, flags, extended, path.decode("utf-8", "surrogateescape"), flags >> 12 & 3)


def write_staging(rows: list[dict], version: int = 2) -> bytes:
    """A staging index of rows with path, oid, mode and, if known, the other fields."""
    out = bytearray(b"DIRC" + struct.pack(">LL", version, len(rows)))
    last = b""
    for r in sorted(rows, key=lambda r: (r["path"].encode(), r.get("stage", 0))):
        path, start = r["path"].encode(), len(out)
        extended = r.get("extended", 0) if version > 2 else 0
        flags = min(len(path), 0xFFF) | r.get("stage", 0) << 12 | (0x4000 if extended else 0) | (r.get("flags", 0) & 0x8000)
        out += struct.pack(">10L", *[r.get(f, 0) for f in INDEX_FIELDS[:10]]) + bytes.fromhex(r["oid"]) + struct.pack(">H", flags)
        if extended:
            out += struct.pack(">H", extended)
        if version == 4:
            same = len(posixpath.commonprefix([last, path]))
            out += codecs.offset_varint(len(last) - same) + path[same:] + b"\0"
            last = path
        else:
            out += path
            out += b"\0" * (8 - (len(out) - start) % 8)
    return bytes(out + hashlib.sha1(out).digest())


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    return packs.rows_of(spark, path, parse_staging, INDEX_SCHEMA)


# Ref tables --------------------------------------------------------------------------------------------------

REF_SCHEMA = "name string, update_index long, oid string, peeled string, symref string, deleted boolean"


def write_reftable(rows: list[tuple[str, int, str | None, str | None, str | None]], low: int = 1, high: int = 1, block_size: int = 4096) -> bytes:
    """A ref table of (name, update_index, oid, peeled, symref) rows; one without id and target is a deletion."""
    head = b"REFT" + bytes([1]) + block_size.to_bytes(3, "big") + struct.pack(">QQ", low, high)
    records, last, restarts = bytearray(), b"", [0]
    body: list[bytes] = []

    def close(first: bool) -> None:
        nonlocal records, last, restarts
        lead = len(head) if first else 0
        table = b"".join((lead + 4 + r).to_bytes(3, "big") for r in restarts) + struct.pack(">H", len(restarts))
        size = lead + 4 + len(records) + len(table)
        block = b"r" + size.to_bytes(3, "big") + bytes(records) + table
        body.append(block.ljust(max(len(block), block_size - lead), b"\0"))
        records, last, restarts = bytearray(), b"", [0]

    for name, index, oid, peeled, symref in sorted(rows):
        raw = name.encode()
        kind = 3 if symref else 2 if peeled else 1 if oid else 0
        value = b"" if kind == 0 else codecs.offset_varint(len(symref.encode())) + symref.encode() if kind == 3 else bytes.fromhex(oid) + (bytes.fromhex(peeled) if peeled else b"")
        same = len(posixpath.commonprefix([last, raw]))
        record = codecs.offset_varint(same) + codecs.offset_varint((len(raw) - same) << 3 | kind) + raw[same:] + codecs.offset_varint(index - low) + value
        if records and len(records) + len(record) + 40 + len(head) > block_size:
            close(not body)
            record = codecs.offset_varint(0) + codecs.offset_varint(len(raw) << 3 | kind) + raw + codecs.offset_varint(index - low) + value
        records += record
        last = raw
    if records:
        close(not body)
    foot = head + struct.pack(">QQQQQ", 0, 0, 0, 0, 0)
    return head + b"".join(body) + foot + struct.pack(">L", zlib.crc32(foot))


def parse_reftable(data: bytes) -> Iterator[tuple]:
    """(name, update_index, oid, peeled, symref, deleted) of a ref table."""
    if data[:4] != b"REFT" or data[4] != 1:
        raise ValueError("not a ref table of version 1")
    block_size, (low,) = int.from_bytes(data[5:8], "big"), struct.unpack_from(">Q", data, 8)
    foot = len(data) - 68
    if zlib.crc32(data[foot : foot + 64]) != struct.unpack_from(">L", data, foot + 64)[0]:
        raise ValueError("footer checksum differs")
    at, first = 24, True
    while at < foot and data[at : at + 1] == b"r":
        base = 0 if first else at
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        end = base + size
        (count,) = struct.unpack_from(">H", data, end - 2)
        stop, p, name = end - 2 - 3 * count, at + 4, b""
        while p < stop:
            same, p = codecs.read_offset_varint(data, p)
            packed, p = codecs.read_offset_varint(data, p)
            name, p = name[:same] + data[p : p + (packed >> 3)], p + (packed >> 3)
            index, p = codecs.read_offset_varint(data, p)
            kind, oid, peeled, symref = packed & 7, None, None, None
            if kind in (1, 2):
                oid, p = data[p : p + 20].hex(), p + 20
            if kind == 2:
                peeled, p = data[p : p + 20].hex(), p + 20
            if kind == 3:
                n, p = codecs.read_offset_varint(data, p)
                symref, p = data[p : p + n].decode(), p + n
            yield name.decode(), low + index, oid, peeled, symref, kind == 0
        at = base + max(size, block_size) if block_size else end
        first = False


def read_reftables(spark: SparkSession, path: str) -> DataFrame:
    return packs.rows_of(spark, path, parse_reftable, REF_SCHEMA)


# Bundles -----------------------------------------------------------------------------------------------------


def parse_bundle(data: bytes) -> dict:
    """version, capabilities, prerequisites, references and pack of a bundle of version 2 or 3."""
    head, _, pack = data.partition(b"\n\n")
    lines = head.decode().split("\n")
    m = re.fullmatch(r"# v([23]) git bundle", lines[0])
    if not m:
        raise ValueError("not a bundle")
    out: dict = {"version": int(m[1]), "capabilities": {}, "prerequisites": [], "references": {}, "pack": pack}
    for line in lines[1:]:
        if line.startswith("@"):
            k, sign, v = line[1:].partition("=")
            out["capabilities"][k] = v if sign else None
        elif line.startswith("-"):
            oid, _, comment = line[1:].partition(" ")
            out["prerequisites"].append((oid, comment))
        elif line:
            oid, _, name = line.partition(" ")
            out["references"][name] = oid
    return out


def write_bundle(references: dict[str, str], prerequisites: list[tuple[str, str]], pack: bytes, version: int = 2, capabilities: dict[str, str | None] | None = None) -> bytes:
    caps = "".join(f"@{k}\n" if v is None else f"@{k}={v}\n" for k, v in (capabilities or {}).items()) if version == 3 else ""
    head = f"# v{version} git bundle\n{caps}" + "".join(f"-{o} {c}\n" for o, c in prerequisites) + "".join(f"{o} {n}\n" for n, o in sorted(references.items()))
    return head.encode() + b"\n" + pack


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References (file, oid, name), prerequisites (file, oid, comment) and packed entries of bundles."""
    refs = packs.rows_of(spark, path, lambda d: ((o, n) for n, o in parse_bundle(d)["references"].items()), "oid string, name string")
    need = packs.rows_of(spark, path, lambda d: iter(parse_bundle(d)["prerequisites"]), "oid string, comment string")
    entries = packs.rows_of(spark, path, lambda d: packs.parse_pack(parse_bundle(d)["pack"]), "offset long, kind string, size long, base_offset long, base_oid string, crc32 long, data binary")
    return refs, need, entries


# Fast-export streams -----------------------------------------------------------------------------------------


def export_stream(blobs: list[tuple[str, bytes]], commits: list[dict]) -> bytes:
    """A fast-export stream: blobs (id, data) with marks, then commits with ref, author, committer, message, parents and files."""
    marks: dict[str, int] = {}
    out = bytearray()
    for oid, data in blobs:
        marks[oid] = len(marks) + 1
        out += b"blob\nmark :%d\ndata %d\n" % (marks[oid], len(data)) + data + b"\n"
    for c in commits:
        marks[c["oid"]] = len(marks) + 1
        message = c["message"].encode()
        out += f"commit {c['ref']}\nmark :{marks[c['oid']]}\nauthor {c['author']}\ncommitter {c['committer']}\n".encode() + b"data %d\n" % len(message) + message + b"\n"
        for i, p in enumerate(c.get("parents", [])):
            out += f"{'merge' if i else 'from'} :{marks[p]}\n".encode()
        for path, change in sorted(c.get("files", {}).items()):
            out += f"D {path}\n".encode() if change is None else f"M {change[0]:o} :{marks[change[1]]} {path}\n".encode()
        out += b"\n"
    return bytes(out)


def import_stream(data: bytes) -> Iterator[tuple]:
    """(kind, mark, ref, author, committer, parents, text, files) of every command of a fast-import stream, in order."""
    at = 0

    def line() -> str | None:
        nonlocal at
        if at >= len(data):
            return None
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        out = data[at:end].decode("utf-8", "surrogateescape")
        at = end + 1
        return out

    def block(head: str) -> bytes:
        nonlocal at
        word = head.removeprefix("data ")
        if word.startswith("<<"):
            end = data.index(b"\n" + word[2:].encode() + b"\n", at - 1)
            out, at = data[at : end + 1], end + len(word)
            return out
        out = data[at : at + int(word)]
        at += int(word)
        if data[at : at + 1] == b"\n":
            at += 1
        return out

    row = line()
    while row is not None:
        if row == "blob":
            mark = None
            while (row := line()) is not None and not row.startswith("data "):
                mark = row.removeprefix("mark ") if row.startswith("mark ") else mark
            yield "blob", mark, None, None, None, [], block(row or "data 0").decode("utf-8", "surrogateescape"), []
            row = line()
        elif row.startswith("commit "):
            ref, mark, author, committer, parents, text, files = row[7:], None, None, None, [], "", []
            while (row := line()) is not None:
                word, _, rest = row.partition(" ")
                if word == "mark":
                    mark = rest
                elif word == "author":
                    author = rest
                elif word == "committer":
                    committer = rest
                elif word == "data":
                    text = block(row).decode("utf-8", "surrogateescape")
                elif word in ("from", "merge"):
                    parents.append(rest)
                elif word in ("M", "D", "R", "C") or row == "deleteall":
                    files.append(row)
                elif row:
                    break
                elif files or parents or text:
                    row = line()
                    break
            yield "commit", mark, ref, author, committer, parents, text, files
        elif row.startswith(("reset ", "tag ")):
            kind, _, ref = row.partition(" ")
            parents, text = [], ""
            while (row := line()) is not None and row and row.split(" ")[0] in ("from", "tagger", "data", "mark"):
                if row.startswith("from "):
                    parents.append(row[5:])
                elif row.startswith("data "):
                    text = block(row).decode("utf-8", "surrogateescape")
            yield kind, None, ref, None, None, parents, text, []
        else:
            row = line()


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    return packs.rows_of(spark, path, import_stream, "kind string, mark string, ref string, author string, committer string, parents array<string>, text string, files array<string>")


# Archives ----------------------------------------------------------------------------------------------------


def tar_archive(files: list[tuple[str, int, bytes]], mtime: int = 0, prefix: str = "", kind: str = "") -> bytes:
    """A tar archive of (path, mode, data) in order of paths; ``kind`` is '', 'gz', 'bz2' or 'xz'. Paths that leave the archive are refused."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=f"w:{kind}", format=tarfile.PAX_FORMAT) as tar:
        for path, mode, data in sorted(files):
            if path.startswith("/") or ".." in path.split("/") or "\0" in path:
                raise ValueError(f"unsafe path {path!r}")
            info = tarfile.TarInfo(prefix + path)
            info.mtime, info.mode = mtime, mode & 0o777
            if mode & 0o170000 == 0o120000:
                info.type, info.linkname = tarfile.SYMTYPE, data.decode()
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return buffer.getvalue()
