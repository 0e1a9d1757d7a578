"""Round trips of binary and text forms."""

import hashlib
import random
import tarfile
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataquill.functions import codecs, records
from strataquill.functions import text as X
from strataquill.sources import files, packs


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300), st.binary(max_size=200))
def test_delta(shared, a, b):
    base, target = shared + a + shared, b + shared + a[:50] + shared
    assert codecs.apply_delta(base, codecs.create_delta(base, target)) == target


@given(st.integers(0, 1 << 60))
def test_varints(n):
    assert codecs.read_size_varint(codecs.size_varint(n), 0)[0] == n
    assert codecs.read_offset_varint(codecs.offset_varint(n), 0)[0] == n


@given(st.binary(max_size=200))
def test_base85(data):
    assert codecs.base85_decode(codecs.base85_encode(data)) == data


@given(st.sets(st.integers(0, 900)))
def test_ewah(bits):
    assert codecs.ewah_decode(codecs.ewah_encode(bits, 1000))[0] == bits


def test_ewah_runs():
    bits = set(range(64, 640)) | {700}
    assert codecs.ewah_decode(codecs.ewah_encode(bits))[0] == bits


def objects():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(3000))
    return [("blob", (base[: i * 7] + f"edit {i}\n" + base[i * 7 :]).encode()) for i in range(12)] + [("tree", records.serialise_tree([(b"b", 0o100644, "1" * 40), (b"a", 0o040000, "2" * 40)])), ("blob", b"")]


@pytest.mark.parametrize("version", [1, 2, 3])
def test_pack_and_index(spark, tmp_path, version):
    found = objects()
    pack, entries = packs.write_pack(found, window=10)
    (tmp_path / "p").mkdir()
    (tmp_path / "i").mkdir()
    (tmp_path / "p/a.pack").write_bytes(pack)
    (tmp_path / "i/a.idx").write_bytes(packs.write_index(entries, pack[-20:], version))
    stored = packs.read_packs(spark, f"{tmp_path}/p")
    assert stored.where("kind = 'ofs_delta'").count() > 5
    got = {(r.oid, r.type, bytes(r.data)) for r in packs.resolve(stored).collect()}
    want = {(hashlib.sha1(f"{k} {len(d)}\0".encode() + d).hexdigest(), k, d) for k, d in found}
    assert got == want
    rows = packs.read_indexes(spark, f"{tmp_path}/i").collect()
    assert {(r.oid, r.offset) for r in rows} == {(o, off) for o, off, _ in entries}
    assert version == 1 or {r.crc32 for r in rows} == {c for _, _, c in entries}


def test_large_offsets():
    rows = [("aa" * 20, 12, 1), ("bb" * 20, 1 << 33, 2)]
    assert list(packs.parse_index(packs.write_index(rows, b"\1" * 20, 2))) == rows


def test_thin_pack_resolves_from_outside(spark, tmp_path):
    base, target = b"x" * 100 + b"y" * 100, b"x" * 100 + b"z" + b"y" * 100
    oid = hashlib.sha1(b"blob 200\0" + base).hexdigest()
    change = codecs.create_delta(base, target)
    body = packs.entry_header(7, len(change)) + bytes.fromhex(oid) + __import__("zlib").compress(change)
    raw = b"PACK" + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + body
    (tmp_path / "thin.pack").write_bytes(raw + hashlib.sha1(raw).digest())
    outside = spark.createDataFrame([(oid, "blob", bytearray(base))], "oid string, type string, data binary")
    assert bytes(packs.resolve(packs.read_packs(spark, str(tmp_path)), outside).first().data) == target


def test_midx_graph_bitmaps():
    ids = [hashlib.sha1(bytes([i])).hexdigest() for i in range(20)]
    midx = packs.write_midx({"b.idx": [(o, 12 + i) for i, o in enumerate(ids)], "a.idx": [(ids[3], 99), (ids[4], 1 << 34)]})
    rows = {o: (p, off) for o, p, off in packs.parse_midx(midx)}
    assert len(rows) == 20 and rows[ids[3]] == ("a.idx", 99) and rows[ids[4]] == ("a.idx", 1 << 34) and rows[ids[5]] == ("b.idx", 17)
    graph = [(ids[i], "0" * 40, ids[max(0, i - 3) : i], i + 1, 1700000000 + i) for i in range(20)]
    assert sorted(packs.parse_commit_graph(packs.write_commit_graph(graph))) == sorted(graph)
    found = list(packs.parse_bitmaps(packs.write_bitmaps(b"\2" * 20, {"commit": {0, 3}, "blob": {1, 2, 70}}, [(0, {0, 1}), (3, set(range(71)))], 71)))
    assert found[0] == ("commit", None, [0, 3]) and found[2] == ("blob", None, [1, 2, 70]) and found[-1] == ("reach", 3, list(range(71)))


@pytest.mark.parametrize("version", [2, 3, 4])
def test_staging_index(version):
    rows = [{"path": p, "oid": "ab" * 20, "mode": 0o100644, "size": 5, "stage": s} for p, s in (("a/b.txt", 0), ("a/bc.txt", 0), ("c", 1), ("c", 2), ("longer/path/with/parts.txt", 0))]
    got = [dict(zip(files.INDEX_FIELDS, r)) for r in files.parse_staging(files.write_staging(rows, version))]
    assert [(g["path"], g["stage"], g["oid"], g["size"], g["mode"]) for g in got] == [(r["path"], r["stage"], r["oid"], 5, 0o100644) for r in rows]


def test_reftable():
    rows = [(f"refs/heads/branch-{i:04}", 2, f"{i:040x}", None, None) for i in range(400)] + [("HEAD", 1, None, None, "refs/heads/branch-0001"), ("refs/tags/v1", 3, "a" * 40, "b" * 40, None), ("refs/heads/gone", 3, None, None, None)]
    got = list(files.parse_reftable(files.write_reftable(rows, 1, 3, 1024)))
    assert sorted((n, i, o, p, s) for n, i, o, p, s, _ in got) == sorted(rows, key=lambda r: r[0])
    assert [n for n, *_, d in got if d] == ["refs/heads/gone"]


def test_bundle_and_stream():
    pack, _ = packs.write_pack(objects())
    b = files.parse_bundle(files.write_bundle({"refs/heads/main": "1" * 40}, [("2" * 40, "old")], pack, 3, {"object-format": "sha1"}))
    assert b["pack"] == pack and b["references"] == {"refs/heads/main": "1" * 40} and b["prerequisites"] == [("2" * 40, "old")] and b["capabilities"] == {"object-format": "sha1"}
    stream = files.export_stream([("x", b"one\ntwo")], [{"oid": "c1", "ref": "refs/heads/a", "author": "A <a> 1 +0000", "committer": "A <a> 1 +0000", "message": "first\n", "files": {"f": (0o100644, "x")}}, {"oid": "c2", "ref": "refs/heads/a", "author": "A <a> 2 +0000", "committer": "A <a> 2 +0000", "message": "second", "parents": ["c1"], "files": {"f": None}}])
    rows = list(files.import_stream(stream))
    assert [r[0] for r in rows] == ["blob", "commit", "commit"] and rows[0][6] == "one\ntwo"
    assert rows[1][6] == "first\n" and rows[1][7] == ["M 100644 :1 f"] and rows[2][5] == [":2"] and rows[2][7] == ["D f"]


def test_archive():
    data = files.tar_archive([("b", 0o100755, b"2"), ("a/x", 0o100644, b"1"), ("l", 0o120000, b"b")], prefix="p/")
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert t.getnames() == ["p/a/x", "p/b", "p/l"] and t.extractfile("p/a/x").read() == b"1"
    with pytest.raises(ValueError):
        files.tar_archive([("../x", 0o100644, b"")])


def test_records():
    c = records.CommitRecord("1" * 40, ["2" * 40, "3" * 40], b"A <a@b> 5 +0000", b"C <c@d> 6 -0130", None, b"-----BEGIN PGP SIGNATURE-----\n\nabc\n-----END", [], [("note", b"x\ny")], b"subject\n\nbody\n")
    raw = records.serialise_commit(c)
    assert records.parse_commit(raw) == c
    payload, signature, kind = records.split_signature(raw)
    assert signature == c.gpgsig and kind == "pgp" and b"gpgsig" not in payload
    entries = [(b"a", 0o040000, "1" * 40), (b"a.b", 0o100644, "2" * 40)]
    assert records.parse_tree(records.serialise_tree(entries)) == [entries[1], entries[0]]


def test_mail():
    raw = records.mail_patch("1" * 40, "A B <a@b>", "Mon, 1 Jan 2024 00:00:00 +0000", "Subject line\n\nBody text\n", "diff --git a/x b/x\n", (2, 3))
    m = records.mail_info(raw.split("\n", 1)[1])
    assert (m["author"], m["email"], m["subject"], m["message"]) == ("A B", "a@b", "Subject line", "Body text\n") and m["patch"].startswith("---")
    assert len(records.split_mbox(raw + raw)) == 2


def test_trailers():
    message = "Subject\n\nBody\n\nSigned-off-by: A\nReviewed-by: B\n"
    body, found = X.split_trailers(message)
    assert body == "Subject\n\nBody\n" and found == [("Signed-off-by", "A", ":"), ("Reviewed-by", "B", ":")]
    assert X.with_trailer(message, "Acked-by", "C").endswith("Reviewed-by: B\nAcked-by: C\n")
    assert X.with_trailer(message, "Reviewed-by", "B") == message
    assert X.with_trailer(message, "Signed-off-by", "Z", if_exists="replace").count("Signed-off-by: Z") == 1
    assert X.with_trailer("Subject\n", "Key", "v") == "Subject\n\nKey: v\n"
    assert X.split_trailers("no trailers here")[1] == []


def test_sha256_packs(spark, tmp_path):
    """Ids, index and trailer of 32 bytes."""
    found = objects()
    pack, entries = packs.write_pack(found, window=10, id_bytes=32)
    assert pack[-32:] == hashlib.sha256(pack[:-32]).digest() and all(len(o) == 64 for o, _, _ in entries)
    (tmp_path / "a.pack").write_bytes(pack)
    got = {(r.oid, bytes(r.data)) for r in packs.resolve(packs.read_packs(spark, str(tmp_path), 32), algorithm="sha256").collect()}
    assert got == {(hashlib.sha256(f"{k} {len(d)}\0".encode() + d).hexdigest(), d) for k, d in found}
    index = packs.write_index(entries, pack[-32:], 3)
    assert list(packs.parse_index(index)) == sorted(entries)
    with pytest.raises(ValueError):
        list(packs.parse_pack(pack, 20))


def test_a_chain_of_105_deltas(spark):
    texts = [b"start of it all, and some more of it to copy from"]
    rows = [("f", 0, "blob", len(texts[0]), None, None, 0, texts[0])]
    for i in range(1, 106):
        texts.append(texts[-1] + b" step %d" % i)
        rows.append(("f", i, "ofs_delta", 0, i - 1, None, 0, codecs.create_delta(texts[-2], texts[-1])))
    entries = spark.createDataFrame(rows, "file string, offset long, kind string, size long, base_offset long, base_oid string, crc32 long, data binary").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = {r.offset: bytes(r.data) for r in packs.resolve(entries).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict(enumerate(texts))


def test_entries_are_inflated_in_windows():
    data = random.Random(1).randbytes(3_000_000)
    pack, entries = packs.write_pack([("blob", data), ("blob", b""), ("blob", b"x" * 5_000_000)])
    assert [(e[0], e[2], e[6]) for e in packs.parse_pack(pack)] == [(entries[0][1], len(data), data), (entries[1][1], 0, b""), (entries[2][1], 5_000_000, b"x" * 5_000_000)]
    with pytest.raises(ValueError):
        packs.inflated(memoryview(pack)[: entries[0][1] + 1000], entries[0][1] + 4, len(data))


def test_bytes_of_the_formats():
    """Forms written down byte by byte from the formats' descriptions, so that reader and writer are not each other's only witness."""
    empty = b"PACK" + b"\0\0\0\2" + b"\0\0\0\0"
    assert list(packs.parse_pack(empty + hashlib.sha1(empty).digest())) == [] and packs.write_pack([])[0] == empty + hashlib.sha1(empty).digest()
    import zlib

    one = b"PACK" + b"\0\0\0\2" + b"\0\0\0\1" + b"\x35" + zlib.compress(b"hello")  # type 3 (blob) in bits 4 to 6, size 5 in the low four
    row = list(packs.parse_pack(one + hashlib.sha1(one).digest()))[0]
    assert (row[0], row[1], row[2], row[6]) == (12, "blob", 5, b"hello")
    assert packs.entry_header(3, 5) == b"\x35" and packs.entry_header(1, 300) == bytes([0b10011100, 0b00010010])
    # copy 5 bytes from 6: opcode with offset byte 0 and size byte 0; then insert 2 bytes
    assert codecs.apply_delta(b"hello world", bytes([11, 7, 0b10010001, 6, 5, 2]) + b"!!") == b"world!!"
    assert codecs.offset_varint(128) == b"\x80\x00" and codecs.size_varint(300) == b"\xac\x02"
    head = b"DIRC" + b"\0\0\0\2" + b"\0\0\0\1"
    entry = b"\0" * 24 + b"\0\0\x81\xa4" + b"\0" * 8 + b"\0\0\0\7" + b"\x11" * 20 + b"\0\5" + b"a.txt" + b"\0" * 5
    index = head + entry
    got = list(files.parse_staging(index + hashlib.sha1(index).digest()))[0]
    assert (got[6], got[9], got[10], got[13], got[14]) == (0o100644, 7, "11" * 20, "a.txt", 0)
    assert files.write_staging([{"path": "a.txt", "oid": "11" * 20, "mode": 0o100644, "size": 7}])[: len(index)] == index
    words = (5).to_bytes(4, "big") + (2).to_bytes(4, "big") + (1 << 33).to_bytes(8, "big") + (0b10011).to_bytes(8, "big") + (0).to_bytes(4, "big")
    assert codecs.ewah_decode(words)[0] == {0, 1, 4} and codecs.ewah_encode({0, 1, 4}, 5) == words
