"""Queries that write whole tables in stored formats and read them back: each row goes through a writer and a reader.

Files stand as rows (path, content) of a table here; tables are dealt into files of about a thousand rows by hashes of their keys.
"""

from __future__ import annotations

import hashlib
import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from strataquill.functions import codecs, diffs
from strataquill.functions import objects as O
from strataquill.operators import rewriting
from strataquill.plans.lineage import Materialised, scratch_dir
from strataquill.queries import query
from strataquill.sources import files, lines, packs


def _blobs(v):
    """Distinct blobs (oid, type, path, size, data) with the first path of each."""
    return v.blobs.groupBy("oid").agg(F.min(F.struct("path", "size", "data")).alias("x")).select("oid", F.lit("blob").alias("type"), "x.path", "x.size", F.col("x.data").cast("binary").alias("data"))


# Packs and their indexes ---------------------------------------------------------------------------------------


@query("SELECT DISTINCT oid, 'blob' AS type, size, sha1(data) AS data_sha1 FROM blobs")
def packed_objects(v):
    """Every blob written to packs, with deltas against its neighbours, and read from them with deltas resolved."""
    rows = v.chunked(_blobs(v), "path").repartition("chunk")
    stored = Materialised(v.spark, "packs")(rewriting.pack_partitions(rows, 1, by="chunk"))
    entries = packs.decoded(stored.select(F.col("name").alias("path"), F.col("pack").alias("content")), packs.parse_pack, "offset long, kind string, size long, base_offset long, base_oid string, crc32 long, data binary")
    return packs.resolve(entries).select("oid", "type", F.octet_length("data").cast("long").alias("size"), F.sha1("data").alias("data_sha1"))


@query("SELECT oid, true AS same_place, true AS same_crc32 FROM blobs GROUP BY oid")
def indexed_packs(v):
    """Every entry of packs found through their indexes: each index's offsets and checksums are those of the pack itself."""
    rows = v.chunked(_blobs(v), "path").repartition("chunk")
    stored = Materialised(v.spark, "packs")(rewriting.pack_partitions(rows, 0, by="chunk"))
    index = packs.decoded(stored.select(F.col("name").alias("path"), F.col("idx").alias("content")), packs.parse_index, "oid string, offset long, crc32 long")
    entries = packs.decoded(stored.select(F.col("name").alias("path"), F.col("pack").alias("content")), packs.parse_pack, "offset long, kind string, size long, base_offset long, base_oid string, crc32 long, data binary")
    found = entries.select("file", "offset", O.object_id("blob", F.col("data")).alias("oid"), F.col("crc32").alias("own"))
    return index.join(found, ["file", "oid"], "left").select("oid", (index["offset"] == found["offset"]).alias("same_place"), (F.col("crc32") == F.col("own")).alias("same_crc32"))


@query("""
WITH o AS (SELECT oid, min(doc_id) * 4000000 + 12 AS place FROM blobs GROUP BY oid)
SELECT n AS version, oid, CASE WHEN n = 1 THEN place % 4294967296 ELSE place END AS "offset", CASE WHEN n > 1 THEN place % 1000003 END AS crc32 FROM o, (SELECT unnest([1, 2, 3]) AS n)
""")
def index_entries(v):
    """Entries of pack indexes of versions 1, 2 and 3, with offsets beyond two gigabytes where the version has them."""
    place = F.col("doc_id") * 4_000_000 + 12
    rows = v.chunked(v.blobs.groupBy("oid").agg(F.min("doc_id").alias("doc_id")), "oid").select("oid", place.alias("place"), "chunk")
    out = None
    for version in (1, 2, 3):
        offset = F.col("place") % (1 << 32) if version == 1 else F.col("place")
        written = packs.encoded(rows.select("chunk", "oid", offset.alias("offset"), (F.col("place") % 1000003).alias("crc")), "chunk", lambda f, n=version: packs.write_index(list(zip(f["oid"], f["offset"].tolist(), f["crc"].tolist())), b"\1" * 20, n))
        read = packs.decoded(written, packs.parse_index, "oid string, offset long, crc32 long").select(F.lit(version).alias("version"), "oid", "offset", "crc32")
        out = read if out is None else out.unionByName(read)
    return out


@query("""
SELECT oid, pack, "offset" FROM (SELECT oid, 'pack-' || lang AS pack, doc_id * 4000000 + 12 AS "offset", row_number() OVER (PARTITION BY oid ORDER BY lang, doc_id) AS k FROM blobs JOIN documents USING (doc_id)) WHERE k = 1
""")
def multi_pack_entries(v):
    """Entries of multi-pack indexes over packs by language; an id in several packs is the first pack's."""
    rows = v.blobs.join(v.table("documents").select("doc_id", "lang"), "doc_id").groupBy("oid", "lang").agg(F.min("doc_id").alias("doc_id"))
    rows = v.chunked(rows, "oid").select("chunk", "oid", F.concat(F.lit("pack-"), F.col("lang")).alias("pack"), (F.col("doc_id") * 4_000_000 + 12).alias("place"))

    def write(f: pd.DataFrame) -> bytes:
        return packs.write_midx({p: list(zip(g["oid"], g["place"].tolist())) for p, g in f.groupby("pack")})

    return packs.decoded(packs.encoded(rows, "chunk", write), packs.parse_midx, "oid string, pack string, offset long").select("oid", "pack", "offset")


_CHUNK = 4096


@query(f"""
WITH c AS (SELECT id, id // {_CHUNK} AS chunk, sha1(CAST(id AS VARCHAR)) AS oid, commit_time FROM commits)
SELECT oid, sha1('tree' || id) AS tree, array_to_string(list_transform(list_filter([id - 1, id - 2, id - 3][1:(id % 4)], lambda p: p >= 1 AND p // {_CHUNK} = chunk), lambda p: sha1(CAST(p AS VARCHAR))), ' ') AS parents, id % {_CHUNK} + 1 AS generation, commit_time FROM c
""")
def commit_graph_rows(v):
    """Every commit through commit-graph files of contiguous commits, with none to three of the commits before it as parents."""
    sha = lambda c: F.sha1(c.cast("string"))
    near = F.filter(F.slice(F.array(*[F.col("commit") - k for k in (1, 2, 3)]), F.lit(1), (F.col("commit") % 4).cast("int")), lambda p: (p >= 1) & (F.floor(p / _CHUNK) == F.floor(F.col("commit") / _CHUNK)))
    rows = v.commits.select(F.floor(F.col("commit") / _CHUNK).alias("chunk"), sha(F.col("commit")).alias("oid"), sha(F.concat(F.lit("tree"), F.col("commit").cast("string"))).alias("tree"), F.transform(near, sha).alias("parents"), (F.col("commit") % _CHUNK + 1).alias("generation"), "commit_time")

    def write(f: pd.DataFrame) -> bytes:
        return packs.write_commit_graph([(o, t, list(p), int(g), int(s)) for o, t, p, g, s in zip(f["oid"], f["tree"], f["parents"], f["generation"], f["commit_time"])])

    read = packs.decoded(packs.encoded(rows, "chunk", write), packs.parse_commit_graph, "oid string, tree string, parents array<string>, generation long, commit_time long")
    return read.select("oid", "tree", F.array_join("parents", " ").alias("parents"), "generation", "commit_time")


@query(f"""
WITH c AS (SELECT id // {_CHUNK} AS chunk, id % {_CHUNK} AS pos, id % 4 AS t FROM commits), s AS (SELECT chunk, pos FROM c WHERE pos % 64 = 0)
SELECT chunk, ['commit', 'tree', 'blob', 'tag'][t + 1] AS kind, CAST(NULL AS BIGINT) AS commit_pos, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM c GROUP BY ALL
UNION ALL SELECT s.chunk, 'reach', s.pos, count(*), CAST(sum(c.pos) AS BIGINT) FROM s JOIN c ON c.chunk = s.chunk AND c.pos <= s.pos GROUP BY ALL
""")
def bitmap_rows(v):
    """Bitmap files of contiguous objects: sets by type, and everything before each 64th."""
    rows = v.commits.select(F.floor(F.col("commit") / _CHUNK).alias("chunk"), (F.col("commit") % _CHUNK).alias("pos"), (F.col("commit") % 4).alias("t"))

    def write(f: pd.DataFrame) -> bytes:
        kinds = {k: set(f["pos"][f["t"] == i].tolist()) for i, k in enumerate(("commit", "tree", "blob", "tag"))}
        every = sorted(f["pos"].tolist())
        return packs.write_bitmaps(b"\2" * 20, kinds, [(p, {q for q in every if q <= p}) for p in every if p % 64 == 0], _CHUNK)

    read = packs.decoded(packs.encoded(rows, "chunk", write), packs.parse_bitmaps, "kind string, commit_pos long, positions array<long>").where(F.size("positions") > 0)
    return read.select(F.col("file").cast("long").alias("chunk"), "kind", "commit_pos", F.size("positions").cast("long").alias("n"), F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""
WITH g AS (SELECT id // 4096 AS chunk, id % 4096 AS pos, CASE WHEN id % 4096 < 1000 THEN 1 ELSE id % 5 END AS k FROM commits)
SELECT chunk, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM g WHERE k = 1 GROUP BY chunk
""")
def compressed_bitsets(v):
    """Run-length compressed bitsets with long runs and scattered bits, read back."""
    rows = v.commits.select(F.floor(F.col("commit") / _CHUNK).alias("chunk"), (F.col("commit") % _CHUNK).alias("pos"), F.when(F.col("commit") % _CHUNK < 1000, 1).otherwise(F.col("commit") % 5).alias("k")).where("k = 1").select("chunk", "pos")
    written = packs.encoded(rows, "chunk", lambda f: codecs.ewah_encode(set(f["pos"].tolist()), _CHUNK))
    read = packs.decoded(written, lambda d: iter([(p,) for p in sorted(codecs.ewah_decode(d)[0])]), "pos long")
    return read.groupBy(F.col("file").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


# Staging index, ref tables, bundles, streams, archives ---------------------------------------------------------


@query("SELECT v AS version, path, oid, 33188 AS mode, size, doc_id AS mtime, CAST(doc_id % 3 AS INTEGER) AS stage FROM blobs, (SELECT unnest([2, 3, 4]) AS v)")
def staged_entries(v):
    """Every document's path through staging indexes of versions 2, 3 and 4 (with shared prefixes of paths)."""
    rows = v.chunked(v.blobs, "path").select("chunk", "path", "oid", F.lit(0o100644).alias("mode"), "size", F.col("doc_id").alias("mtime"), (F.col("doc_id") % 3).alias("stage"))
    out = None
    for version in (2, 3, 4):
        written = packs.encoded(rows, "chunk", lambda f, n=version: files.write_staging([{"path": p, "oid": o, "mode": m, "size": s, "mtime": t, "stage": g} for p, o, m, s, t, g in zip(f["path"], f["oid"], f["mode"], f["size"], f["mtime"], f["stage"])], n))
        read = packs.decoded(written, files.parse_staging, files.INDEX_SCHEMA).select(F.lit(version).alias("version"), "path", "oid", "mode", "size", "mtime", "stage")
        out = read if out is None else out.unionByName(read)
    return out


@query("""
SELECT 'refs/heads/' || branch AS name, node % 100 + 1 AS update_index, CASE WHEN node % 4 < 2 THEN sha1(CAST(node AS VARCHAR)) END AS oid, CASE WHEN node % 4 = 1 THEN sha1('peeled' || node) END AS peeled,
  CASE WHEN node % 4 = 2 THEN 'refs/heads/main' END AS symref, node % 4 = 3 AS deleted FROM branches
""")
def ref_table_rows(v):
    """Every branch through ref tables: plain, peeled, symbolic and deleted ones."""
    k = F.col("node") % 4
    rows = v.branches.select(F.concat(F.lit("refs/heads/"), F.col("branch")).alias("name"), (F.col("node") % 100 + 1).alias("update_index"), F.when(k < 2, F.sha1(F.col("node").cast("string"))).alias("oid"), F.when(k == 1, F.sha1(F.concat(F.lit("peeled"), F.col("node").cast("string")))).alias("peeled"), F.when(k == 2, "refs/heads/main").alias("symref"))

    def write(f: pd.DataFrame) -> bytes:
        none = lambda x: None if x is None or x != x else x
        return files.write_reftable([(n, int(u), none(o), none(p), none(s)) for n, u, o, p, s in zip(f["name"], f["update_index"], f["oid"], f["peeled"], f["symref"])], 1, 100, 1024)

    return packs.decoded(packs.encoded(v.chunked(rows, "name"), "chunk", write), files.parse_reftable, files.REF_SCHEMA).drop("file")


@query("""
SELECT 'reference' AS kind, sha1(CAST(node AS VARCHAR)) AS oid, 'refs/heads/' || branch AS name FROM branches
UNION ALL SELECT 'prerequisite', sha1('before' || node), 'before ' || branch FROM branches WHERE node % 3 = 0 UNION ALL SELECT 'blob', sha1('blob ' || strlen(branch) || chr(0) || branch), branch FROM branches
""")
def bundled_rows(v):
    """Every branch in bundles: its reference, what some need, and a packed blob of its name."""
    rows = v.chunked(v.branches, "branch").select("chunk", "branch", "node", F.sha1(F.col("node").cast("string")).alias("oid"), F.when(F.col("node") % 3 == 0, F.sha1(F.concat(F.lit("before"), F.col("node").cast("string")))).alias("need"))

    def write(f: pd.DataFrame) -> bytes:
        pack, _ = packs.write_pack([("blob", b.encode()) for b in f["branch"]])
        need = [(o, f"before {b}") for o, b in zip(f["need"], f["branch"]) if isinstance(o, str)]
        return files.write_bundle({f"refs/heads/{b}": o for b, o in zip(f["branch"], f["oid"])}, need, pack, 3, {"object-format": "sha1"})

    def read(data: bytes):
        found = files.parse_bundle(data)
        yield from (("reference", o, n) for n, o in found["references"].items())
        yield from (("prerequisite", o, c) for o, c in found["prerequisites"])
        for e in packs.parse_pack(found["pack"]):
            yield "blob", hashlib.sha1(b"blob %d\0" % len(e[-1]) + e[-1]).hexdigest(), e[-1].decode()

    return packs.decoded(packs.encoded(rows, "chunk", write), read, "kind string, oid string, name string").drop("file")


@query("""
SELECT 'blob' AS kind, NULL AS ref, NULL AS author, sha1(data) AS text_sha1, NULL AS path FROM blobs
UNION ALL SELECT 'commit', 'refs/heads/main', 'A <a@x.org> ' || doc_id || ' +0000', sha1('Add ' || path || chr(10)), path FROM blobs
""")
def exported_stream_rows(v):
    """Every document exported as a blob and a commit that adds it, and imported again."""
    rows = v.chunked(v.blobs, "path").select("chunk", "doc_id", "path", "data", F.concat_ws("-", "oid", F.col("doc_id").cast("string")).alias("oid"))

    def write(f: pd.DataFrame) -> bytes:
        commits = [{"oid": f"c{d}", "ref": "refs/heads/main", "author": f"A <a@x.org> {d} +0000", "committer": f"A <a@x.org> {d} +0000", "message": f"Add {p}\n", "files": {p: (0o100644, o)}} for d, p, o in zip(f["doc_id"], f["path"], f["oid"])]
        return files.export_stream([(o, t.encode()) for o, t in zip(f["oid"], f["data"])], commits)

    read = packs.decoded(packs.encoded(rows, "chunk", write), files.import_stream, "kind string, mark string, ref string, author string, committer string, parents array<string>, text string, files array<string>")
    return read.select("kind", "ref", "author", F.sha1("text").alias("text_sha1"), F.regexp_extract(F.get("files", F.lit(0)), r"^M 100644 :\d+ (.*)$", 1).alias("path"))


@query("SELECT 'gz' AS kind, 'top/' || path AS path, sha1(data) AS data_sha1, size FROM blobs")
def archived_files(v):
    """Every document in compressed archives, listed from them."""
    rows = v.chunked(v.blobs, "path").select("chunk", "path", "data")
    written = packs.encoded(rows, "chunk", lambda f: files.tar_archive([(p, 0o100644, d.encode()) for p, d in zip(f["path"], f["data"])], prefix="top/", kind="gz"))

    def read(data: bytes):
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for m in tar:
                yield m.name, hashlib.sha1(tar.extractfile(m).read()).hexdigest(), m.size

    return packs.decoded(written, read, "path string, data_sha1 string, size long").select(F.lit("gz").alias("kind"), "path", "data_sha1", "size")


@query("SELECT path, 'blob' AS type, size, sha1(data) AS data_sha1 FROM blobs")
def loose_objects(v):
    """Every document as a loose object's file, read back."""
    rows = v.blobs.select("path", "data").withColumn("content", F.lit(None).cast("binary")).drop("content")

    def write(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [lines.loose_bytes("blob", d.encode()) for d in f["data"]]})

    read = packs.decoded(rows.mapInPandas(write, "path string, content binary"), lines.parse_loose, "type string, size long, data binary")
    return read.select(F.col("file").alias("path"), "type", "size", F.sha1("data").alias("data_sha1"))


# Text files ----------------------------------------------------------------------------------------------------


def _named_refs(v):
    return v.branches.select(F.concat(F.lit("refs/heads/"), F.col("branch")).alias("name"), F.sha1(F.col("node").cast("string")).alias("oid"), F.when(F.col("node") % 2 == 0, F.sha1(F.concat(F.lit("peeled"), F.col("node").cast("string")))).alias("peeled"))


_REFS = "SELECT 'refs/heads/' || branch AS name, sha1(CAST(node AS VARCHAR)) AS oid, CASE WHEN node % 2 = 0 THEN sha1('peeled' || node) END AS peeled FROM branches"


@query(_REFS)
def packed_ref_rows(v):
    """Every branch through a file of packed refs, with peeled values."""
    path = scratch_dir(v.spark, "packed-refs")
    lines.packed_ref_lines(_named_refs(v)).write.text(path)
    return lines.packed_refs(lines.numbered(v.spark, path)).select("name", "oid", "peeled")


@query(_REFS)
def server_info_rows(v):
    """Every branch through a server's list of refs, with peeled values."""
    path = scratch_dir(v.spark, "info-refs")
    lines.info_ref_lines(_named_refs(v)).write.text(path)
    return lines.info_refs(v.spark, path).select("name", "oid", "peeled")


@query("""
SELECT CASE WHEN old < 0 THEN repeat('0', 40) ELSE sha1(CAST(old AS VARCHAR)) END AS old, sha1(CAST(new AS VARCHAR)) AS new, ref || ' <' || ref || '@x.org>' AS committer, ts, CAST((new % 27 - 12) * 1800 AS INTEGER) AS tz, CASE WHEN new % 5 = 0 THEN '' ELSE 'commit: step ' || new END AS message FROM reflog
""")
def reflog_rows(v):
    """Every update of every branch as a line of a log, parsed again."""
    sha = lambda c: F.sha1(F.col(c).cast("string"))
    who = F.concat(F.col("ref"), F.lit(" <"), F.col("ref"), F.lit("@x.org>"))
    message = F.when(F.col("new") % 5 != 0, F.concat(F.lit("commit:\n step "), F.col("new").cast("string")))
    line = lines.reflog_line(F.when(F.col("old") >= 0, sha("old")), sha("new"), who, F.col("ts"), ((F.col("new") % 27 - 12) * 1800).cast("int"), message)
    path = scratch_dir(v.spark, "reflog")
    v.reflog.select(line.alias("value")).write.text(path)
    return v.spark.read.text(path).select(lines.reflog_columns(F.col("value")).alias("x")).select("x.*")


# Codecs --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, size // 52 * 67 + CASE WHEN size % 52 > 0 THEN 2 + 5 * ((size % 52 + 3) // 4) ELSE 0 END AS chars, sha1(data) AS back FROM blobs")
def base85_texts(v):
    """Every document in base 85, and back."""
    coded = v.blobs.select("doc_id", codecs.base85(F.col("data").cast("binary")).alias("c"))
    return coded.select("doc_id", F.length("c").cast("long").alias("chars"), F.sha1(codecs.unbase85(F.col("c"))).alias("back"))


@query("SELECT doc_id, sha1('new first line' || chr(10) || data || chr(10) || 'new last line') AS target_sha1 FROM blobs")
def deltas_applied(v):
    """Every document with two lines more as a delta against the document, applied again."""
    base, target = F.col("data").cast("binary"), F.concat(F.lit("new first line\n"), F.col("data"), F.lit("\nnew last line")).cast("binary")
    changed = v.blobs.select("doc_id", base.alias("base"), codecs.delta(base, target).alias("change"))
    return changed.select("doc_id", F.sha1(codecs.undelta(F.col("base"), F.col("change"))).alias("target_sha1"))


@query("SELECT doc_id, sha1('first' || chr(10) || data || 'last' || chr(10)) AS patched_sha1, CAST(2 AS BIGINT) + CASE WHEN data <> '' AND NOT suffix(data, chr(10)) THEN 1 ELSE 0 END AS added FROM blobs")
def patches_applied(v):
    """Every document against the same with a line before it and text behind it as a unified diff, applied again."""
    new = F.concat(F.lit("first\n"), F.col("data"), F.lit("last\n"))
    d = v.blobs.select("doc_id", "data", diffs.unified_diff(F.col("data"), new).alias("patch"))
    plus = F.regexp_count("patch", F.lit(r"(?m)^\+(?!\+\+ b$)"))
    return d.select("doc_id", F.sha1(diffs.patched(F.col("data"), F.col("patch"))).alias("patched_sha1"), (plus + F.when((F.col("data") != "") & ~F.col("data").endswith("\n"), 1).otherwise(0)).cast("long").alias("added"))
