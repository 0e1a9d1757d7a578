"""Merges, rewriting, matching, renames, reflogs and sources on small cases with known answers."""

import os

import pytest
from pyspark.sql import functions as F

from strataquill import plugins
from strataquill.functions import dates, people
from strataquill.functions import objects as O
from strataquill.functions.text import blocks
from strataquill.operators import history, matching, merging, object_filters, refs, rewriting, similarity, store, trees
from strataquill.plans import revspec
from strataquill.sources import config, lines, packs
from strataquill.streaming import logs, transfers

FILE, EXE, LINK, DIR, SUB = 0o100644, 0o100755, 0o120000, 0o040000, 0o160000


def snap(spark, **files):
    return spark.createDataFrame([(p.replace("__", "/"), *(v if isinstance(v, tuple) else (v, FILE))) for p, v in files.items()], "path string, oid string, mode int")


def column(spark, expr, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def changes(df):
    return sorted((r.change_type, r.old_path, r.new_path) for r in df.collect())


def test_renames(spark):
    none = spark.createDataFrame([], "oid string, data string")
    find = lambda a, b, blobs=none, **k: [c for c in changes(similarity.RenameDetector(**k).detect(a, b, blobs)) if c[0] != "unchanged"]
    assert find(snap(spark, a="1"), snap(spark, b="1", c="1")) == [("copy", "a", "c"), ("rename", "a", "b")]
    assert find(snap(spark, a="1", b="1"), snap(spark, c="1")) == [("delete", "b", None), ("rename", "a", "c")]
    assert find(snap(spark, a="1", b="1"), snap(spark, c="1", d="1", e="1")) == [("copy", "a", "e"), ("rename", "a", "c"), ("rename", "b", "d")]
    assert [c[0] for c in changes(trees.tree_changes(snap(spark, a="1"), snap(spark, a=("1", LINK))))] == ["add", "delete"]
    blobs = spark.createDataFrame([("1", "a\nb\nc\nd\n"), ("2", "a\nb\nc\ne\n"), ("3", "x\ny\n")], "oid string, data string")
    assert find(snap(spark, a="1"), snap(spark, b="2"), blobs) == [("rename", "a", "b")]
    assert find(snap(spark, a="1"), snap(spark, b="3"), blobs) == [("add", None, "b"), ("delete", "a", None)]
    assert find(snap(spark, a="1"), snap(spark, a="1", b="2"), blobs, find_copies_harder=True) == [("copy", "a", "b")]
    assert find(snap(spark, a="1", b="3"), snap(spark, a="3", c="1"), blobs, rewrite_threshold=20) != []


def test_similarity_scores(spark):
    texts = {"b0": "", "b1": "ab\ncd\ncd\n", "b2": "ab\n", "b3": "cd\n", "b4": "cd\ncd\n"}
    df = spark.createDataFrame(list(texts.items()), "oid string, data string")
    got = {(r.left_oid, r.right_oid): r.score for r in similarity.similarity(df, df).collect()}
    want = {("b0", "b0"): 100, ("b1", "b2"): 33, ("b1", "b3"): 33, ("b1", "b4"): 66, ("b3", "b4"): 50}
    assert all(got[k] == v and got[k[::-1]] == v for k, v in want.items()) and ("b2", "b3") not in got and ("b0", "b1") not in got
    assert column(spark, blocks, "a\nb\na\n", "a\na", "a" * 64 + "xxx\ny\n") == [["a\n", "b\n", "a\n"], ["a\n", "a"], ["a" * 64, "xxx\n", "y\n"]]


def test_merges(spark):
    base, ours, theirs = snap(spark, a="1", b="1", c="1", d="1", e="1"), snap(spark, a="2", b="1", d="2", e=("1", EXE), n="9"), snap(spark, a="1", b="2", c="1", d="3", e="1", n="9")
    got = {r.path: (r.oid, r.outcome) for r in trees.merge3(base, ours, theirs).collect()}
    assert got == {"a": ("2", "clean"), "b": ("2", "clean"), "d": ("2", "merge"), "e": ("1", "conflict"), "n": ("9", "clean")}
    blobs = spark.createDataFrame([("1", "a\nb\nc\n"), ("2", "A\nb\nc\n"), ("3", "a\nb\nC\n"), ("9", "n\n")], "oid string, data string")
    merged, new = merging.merge_files(snap(spark, d="1"), snap(spark, d="2"), snap(spark, d="3"), blobs)
    assert new.first().data == "A\nb\nC\n" and not merged.first().conflict
    merged, new = merging.merge_files(snap(spark, d="1"), snap(spark, d="2"), snap(spark, d="9"), blobs)
    assert merged.first().conflict and "<<<<<<<" in new.first().data
    _, new = merging.merge_files(snap(spark, d="1"), snap(spark, d="2"), snap(spark, d="9"), blobs, "union")
    assert "<<<<<<<" not in new.first().data
    out, _, bad = merging.octopus_merge(snap(spark, d="1"), [snap(spark, d="1", x="5"), snap(spark, d="2"), snap(spark, d="1", y="6")], blobs)
    assert bad is None and {r.path for r in out.collect()} == {"d", "x", "y"}
    _, _, bad = merging.octopus_merge(snap(spark, d="1"), [snap(spark, d="2"), snap(spark, d="9")], blobs)
    assert bad == 1
    out, _, bad = merging.replay(snap(spark, d="2"), [(snap(spark, d="1"), snap(spark, d="3"))], blobs)
    assert bad is None and out.count() == 1
    out, _ = merging.recursive_merge([snap(spark, d="1"), snap(spark, d="1")], snap(spark, d="2"), snap(spark, d="1"), blobs)
    assert out.first().oid == "2"


def test_trees(spark):
    blob = "ce013625030ba8dba906f756967f9e9ca394464a"  # "hello\n"
    files = spark.createDataFrame([("a.txt", FILE, blob), ("d/e/x", FILE, blob), ("d/y", EXE, blob)], "path string, mode int, oid string")
    built = {r.path: r for r in trees.build_trees(files).collect()}
    assert column(spark, lambda x: O.blob_id(x), "hello\n") == [blob] and set(built) == {"", "d", "d/e"}
    entries = spark.createDataFrame([(b.oid, e["name"], e["mode"], e["oid"]) for b in built.values() for e in b.entries], "tree string, name string, mode int, oid string")
    flat = trees.flatten(entries, spark.createDataFrame([(built[""].oid,)], "root string"))
    assert {(r.path, r.mode, r.oid) for r in flat.collect()} == {("a.txt", FILE, blob), ("d/e/x", FILE, blob), ("d/y", EXE, blob)}
    assert built["d/e"].oid == __import__("hashlib").sha1(b"tree 29\0" + b"100644 x\0" + bytes.fromhex(blob)).hexdigest()
    assert {r.path for r in trees.extract_subtree(files, "d").collect()} == {"e/x", "y"}
    assert {r.path for r in trees.replace_subtree(files, "d", snap(spark, z="1")).collect()} == {"a.txt", "d/z"}
    assert trees.build_trees(files.limit(0)).count() == 0


def test_people_and_dates(spark):
    assert column(spark, people.parse_timezone, "+0530", "-0000", "-0130", "x") == [(19800, False), (0, True), (-5400, False), None]
    assert column(spark, people.parse_timezone_broken, "0530", "--700") == [(19800, False), (-25200, False)]
    entry = column(spark, people.parse_time_entry, "A B <a@b> 12 +0100", "A B <a@b>")
    assert tuple(entry[0]) == ("A B <a@b>", 12, 3600, False) and tuple(entry[1]) == ("A B <a@b>", None, None, False)
    assert [tuple(r) for r in column(spark, people.parse_identity, "A B <a@b>", "<a@b>", "A")] == [("A B", "a@b"), (None, "a@b"), ("A", None)]
    now = 1_700_000_000
    assert dates.approxidate("2 weeks ago", now) == now - 1209600 and dates.approxidate("1 month ago", now) == now - 2592000
    assert dates.approxidate("2024-01-02 03:04:05") == 1704164645 and dates.approxidate("yesterday", now) == 1699833600 and dates.approxidate("123") == 123
    with pytest.raises(ValueError):
        dates.approxidate("someday")


def test_rules(spark):
    ignored = lambda rules, *paths: column(spark, lambda p: matching.is_ignored(p, rules), *paths)
    assert ignored(["*.o", "!keep.o", "build/", "/top"], "a.o", "x/keep.o", "build/x", "top", "x/top", "y") == [True, False, True, True, None, None]
    assert ignored(["d/", "!d/x"], "d/x", "d/") == [True, True]
    assert ignored(["a/**/z", "doc/*.txt", "[a-c]?"], "a/z", "a/b/c/z", "doc/n.txt", "doc/s/n.txt", "bz", "dz") == [True, True, True, None, True, None]
    assert column(spark, lambda p: matching.sparse_included(p, ["/*", "!/*/", "/d/"]), "top", "d/x", "e/x") == [True, True, False]
    assert column(spark, lambda p: matching.cone_included(p, ["/*", "!/*/", "/d/e/"]), "top", "d/e/x", "d/x") == [True, True, False]
    assert column(spark, lambda p: matching.attributes(p, ["*.c text eol=lf", "x.c -text !eol"]), "a.c", "x.c", "n") == [{"text": "true", "eol": "lf"}, {"text": "false"}, {}]
    assert object_filters.parse("combine:blob:none+tree:3").spec == "combine:blob:none+tree:3"
    for bad in ("blob:some", "tree:x", "combine:", "sparse:oid=a"):
        with pytest.raises(ValueError):
            object_filters.parse(bad)


def test_refs_and_logs(spark):
    log = spark.createDataFrame([("r", i, str(i - 1), str(i), 100 * i) for i in range(1, 5)], "ref string, seq long, old string, new string, ts long")
    rows = lambda df: sorted((r.seq, r.old, r.new) for r in df.collect())
    assert rows(refs.drop_entry(log, 0, True)) == [(1, "0", "1"), (2, "1", "2"), (3, "2", "3")]
    assert rows(refs.drop_entry(log, 1, True)) == [(1, "0", "1"), (2, "1", "2"), (4, "2", "4")]
    assert rows(refs.expire(log, 300)) == [(3, "2", "3"), (4, "3", "4")]
    assert refs.at_index(log, 1).first().new == "3"
    probe = spark.createDataFrame([("r", 250), ("r", 50)], "ref string, at long")
    assert {r.at: r.oid for r in refs.at_time(log, probe).collect()} == {250: "2", 50: "0"}
    rows_ = spark.createDataFrame([("HEAD", None, "refs/heads/a"), ("refs/heads/a", "1", None), ("loop", None, "loop"), ("refs/tags/a", "2", None)], "name string, oid string, symref string")
    assert {r.name: r.oid for r in refs.resolve(rows_).collect()} == {"HEAD": "1", "refs/heads/a": "1", "refs/tags/a": "2"}
    assert refs.lookup(rows_, "a").first().name == "refs/tags/a"
    alias = refs.alias_rows(spark.createDataFrame([(0, "Jane <jane@x>"), (1, "Joe <joe@x> <bugs@y>"), (2, "Both <b@x> Nick <n@y> # note"), (3, "# c")], "no int, line string"))
    who = spark.createDataFrame([("J", "jane@x"), ("any", "bugs@y"), ("Nick", "n@y"), ("Other", "n@y")], "name string, email string")
    assert {(r.name, r.to_name, r.to_email) for r in refs.canonical(who, alias).collect()} == {("J", "Jane", "jane@x"), ("any", "Joe", "joe@x"), ("Nick", "Both", "b@x"), ("Other", "Other", "n@y")}


def test_line_sources(spark, tmp_path):
    (tmp_path / "packed").write_text("# pack-refs with: peeled\n" + "1" * 40 + " refs/heads/a\n" + "2" * 40 + " refs/tags/v\n^" + "3" * 40 + "\n")
    got = lines.packed_refs(lines.numbered(spark, f"{tmp_path}/packed"))
    assert {(r.name, r.oid[0], r.peeled and r.peeled[0]) for r in got.collect()} == {("refs/heads/a", "1", None), ("refs/tags/v", "2", "3")}
    assert [r.value for r in lines.packed_ref_lines(got).collect()][1:] == ["1" * 40 + " refs/heads/a", "2" * 40 + " refs/tags/v\n^" + "3" * 40]
    os.makedirs(tmp_path / "logs/refs/heads")
    (tmp_path / "logs/refs/heads/a").write_text("0" * 40 + " " + "1" * 40 + " A <a@b> 5 +0100\tfirst\n" + "1" * 40 + " " + "2" * 40 + " A <a@b> 90000 -0000\n")
    log = lines.read_reflogs(spark, f"{tmp_path}/logs/refs/heads")
    assert [(r.ref, r.seq, r.ts, r.tz, r.message) for r in log.orderBy("seq").collect()] == [("refs/heads/a", 0, 5, 3600, "first"), ("refs/heads/a", 1, 90000, 0, "")]
    line = log.orderBy("seq").select(lines.reflog_line(F.col("old"), F.col("new"), F.col("committer"), F.col("ts"), F.col("tz"), F.col("message"))).first()[0]
    assert line == "0" * 40 + " " + "1" * 40 + " A <a@b> 5 +0100\tfirst"
    os.makedirs(tmp_path / "objects/ce")
    (tmp_path / "objects/ce/013625030ba8dba906f756967f9e9ca394464a").write_bytes(lines.loose_bytes("blob", b"hello\n"))
    row = lines.read_loose(spark, f"{tmp_path}/objects").first()
    assert (row.oid, row.type, bytes(row.data)) == ("ce013625030ba8dba906f756967f9e9ca394464a", "blob", b"hello\n")
    (tmp_path / "info").write_text("1\trefs/tags/v\n2\trefs/tags/v^{}\n")
    assert [tuple(r) for r in lines.info_refs(spark, f"{tmp_path}/info").collect()] == [("1", "refs/tags/v", "2")]
    (tmp_path / "box").write_text("From a\nSubject: [PATCH] one\nFrom: A <a@b>\n\nbody\n---\ndiff --git a/x b/x\nFrom b\nSubject: two\n\nx\n")
    mails = lines.mail_columns(lines.read_mbox(spark, f"{tmp_path}/box").select("no", "message"))
    assert [(r.subject, r.author) for r in mails.orderBy("no").collect()] == [("one", "A"), ("two", None)]


def test_streams(spark, tmp_path):
    os.makedirs(tmp_path / "logs")
    (tmp_path / "logs/main").write_text("".join(f"{'0' * 40} {i:040d} A <a@b> {i * 50000} +0000\tm\n" for i in range(6)))
    stream = logs.read_stream(spark, f"{tmp_path}/logs")
    q = logs.newest_values(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("newest").first().oid == f"{5:040d}"
    q = logs.moves_per_window(logs.read_stream(spark, f"{tmp_path}/logs")).writeStream.outputMode("update").format("memory").queryName("moves").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.moves for r in spark.table("moves").collect()) == 6
    os.makedirs(tmp_path / "packs")
    pack, _ = packs.write_pack([("blob", b"a" * 100 + bytes([i])) for i in range(3)], 5)
    (tmp_path / "packs/a.pack").write_bytes(pack)
    transfers.resolve_batches(transfers.read_pack_stream(spark, f"{tmp_path}/packs"), f"{tmp_path}/objects", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/objects").count() == 3


def test_revision_expressions(spark):
    h = lambda c: c * 40
    objects = spark.createDataFrame([(h(c), "commit") for c in "abcd"] + [(h("e"), "tree"), ("ab" * 20, "blob")], "oid string, type string")
    parents = spark.createDataFrame([(h("d"), 1, h("c")), (h("d"), 2, h("b")), (h("c"), 1, h("a")), (h("b"), 1, h("a"))], "commit string, parent_no int, parent string")
    names = spark.createDataFrame([("HEAD", h("d")), ("refs/heads/main", h("d")), ("refs/tags/v", h("f"))], "name string, oid string")
    log = spark.createDataFrame([("refs/heads/main", 0, h("0"), h("c"), 100), ("refs/heads/main", 1, h("c"), h("d"), 200)], "ref string, seq long, old string, new string, ts long")
    entries = spark.createDataFrame([(h("e"), "dir", DIR, h("7")), (h("7"), "f", FILE, h("8"))], "tree string, name string, mode int, oid string")
    commits = spark.createDataFrame([(h("d"), h("e")), (h("c"), h("e"))], "commit string, tree string")
    tags = spark.createDataFrame([(h("f"), h("c"))], "tag string, target string")
    repo = revspec.Repository(objects, parents, names, tags, commits, entries, log)
    got = {s: revspec.resolve(repo, s)[0] for s in ("HEAD", "main~1", "main^2", "HEAD~2", "v^{}", "v~1", "main@{0}", "main@{1}", "main@{1970-01-01 00:02:30}", "HEAD:dir/f", "cccc", "main^2~1")}
    assert got == {"HEAD": "d", "main~1": "c", "main^2": "b", "HEAD~2": "a", "v^{}": "c", "v~1": "a", "main@{0}": "d", "main@{1}": "c", "main@{1970-01-01 00:02:30}": "c", "HEAD:dir/f": "8", "cccc": "c", "main^2~1": "a"}
    assert sorted(r.node[0] for r in revspec.commit_range(repo, "main~1..main").collect()) == ["b", "d"]
    assert revspec.flatten(repo, "HEAD").first().path == "dir/f" and revspec.parse_refspec("+a:b") == ("a", "b", True)
    for bad in ("nothing", "HEAD~9", "HEAD^3", "HEAD^{", "HEAD:no"):
        with pytest.raises(revspec.RevisionError):
            revspec.resolve(repo, bad)


def test_rewriting(spark):
    commits = spark.createDataFrame([(c, "1" * 40, "A <a> 1 +0000", "A <a> 1 +0000", f"{c}\n") for c in ("a", "b", "c", "d")], "commit string, tree string, author string, committer string, message string")
    parents = spark.createDataFrame([("b", 1, "a"), ("c", 1, "b"), ("d", 1, "c"), ("d", 2, "a")], "commit string, parent_no int, parent string")
    plain = {r.commit: r for r in rewriting.rewrite(commits, parents).collect()}
    assert plain["d"].parents == [plain["c"].new, plain["a"].new]
    upper = {r.commit: r for r in rewriting.rewrite(commits, parents, lambda d: d.withColumn("message", F.upper("message"))).collect()}
    assert upper["a"].new != plain["a"].new and upper["d"].message == "D\n"
    cut = {r.commit: r for r in rewriting.rewrite(commits, parents, drop=F.col("commit") == "b").collect()}
    assert set(cut) == {"a", "c", "d"} and cut["c"].parents == [cut["a"].new]
    refs_ = rewriting.rewritten_refs(spark.createDataFrame([("refs/heads/x", "d")], "name string, oid string"), rewriting.rewrite(commits, parents))
    assert {r.name for r in refs_.collect()} == {"refs/heads/x", "refs/original/refs/heads/x"}
    folders = spark.createDataFrame([("b", "2" * 40), ("c", "2" * 40), ("d", "3" * 40)], "commit string, folder_tree string")
    assert {r.commit for r in rewriting.split_history(commits, parents, folders).collect()} == {"b", "d"}
    made = spark.createDataFrame([("m", "Merge\n\ngit-subtree-dir: lib\ngit-subtree-split: abc\n"), ("n", "x")], "commit string, message string")
    assert [tuple(r) for r in rewriting.subtree_metadata(made).collect()] == [("m", "lib", "abc", None)]
    moves = spark.createDataFrame([("d", "modify", "new", "new"), ("c", "rename", "old", "new"), ("b", "modify", "old", "old"), ("a", "add", None, "old"), ("a", "add", None, "other")], "commit string, change_type string, old_path string, new_path string")
    order = spark.createDataFrame([("d", 1), ("c", 2), ("b", 3), ("a", 4)], "commit string, position int")
    assert sorted(r.position for r in rewriting.follow(moves, order, "new").collect()) == [1, 2, 3, 4]


def test_transfers(spark):
    objects = spark.createDataFrame([("blob", f"p{i}", 100 + i, bytearray(b"x" * 100 + b"y" * i)) for i in range(8)], "type string, path string, size int, data binary")
    rows = rewriting.pack_partitions(objects.repartition(2)).collect()
    assert sum(len(list(packs.parse_index(bytes(r.idx)))) for r in rows) == 8
    own = spark.createDataFrame([("c1", "commit", bytearray(b"one")), ("c2", "commit", bytearray(b"two")), ("b", "blob", bytearray(b"b"))], "oid string, type string, data binary")
    edges = spark.createDataFrame([("c2", "c1"), ("c2", "b")], "src string, dst string")
    made = __import__("strataquill.sources.files", fromlist=["x"]).parse_bundle(rewriting.bundle(own, edges, {"refs/heads/a": "c2"}, [("c1", "old")]))
    assert len(list(packs.parse_pack(made["pack"]))) == 2
    mails = rewriting.patch_mails(spark.createDataFrame([(1, "a" * 40, "A <a@b>", 0, 3600, "Sub ject\n\nbody\n", "diff\n")], "number int, oid string, author string, time long, offset int, message string, patch string")).first()
    assert mails.file_name == "0001-Sub-ject.patch" and "Date: Thu, 1 Jan 1970 01:00:00 +0100" in mails.mail


def test_store_and_plugins(spark):
    s = lambda *rows: spark.createDataFrame(list(rows), "oid string, type string, size int")
    assert {(r.oid, r.size) for r in store.overlay([s(("a", "blob", 1)), s(("a", "blob", 2), ("b", "blob", 3))]).collect()} == {("a", 1), ("b", 3)}
    assert [r.oid for r in store.absent(s(("a", "blob", 1)), s(("a", "x", 1), ("c", "x", 1))).collect()] == ["c"]
    registry = plugins.FilterRegistry()
    registry.register("up", lambda c: F.upper(c), lambda c: F.lower(c))
    files = spark.createDataFrame([("a.x", "aB"), ("b", "aB")], "path string, data string")
    assert {r.path: r.data for r in registry.apply(files, ["*.x filter=up"]).collect()} == {"a.x": "AB", "b": "aB"}
    assert plugins.maintain({"a": lambda: 1, "b": lambda: 1 / 0})["b"].startswith("failed")
    text = '[core]\n\tbare = false ; note\n[remote "o\\"x"]\nurl = "a b" c\\\nd\nflag\n[include]\npath=more\n'
    got = config.parse(text, lambda p: "[core]\nbare = yes\n")
    assert config.get(got, ("core",), "bare") == "yes" and config.get(got, ("remote", 'o"x'), "url") == "a b cd" and config.get(got, ("remote", 'o"x'), "flag") == "true"
    assert config.matches_glob("/home/me/work/x", "/home/*/work/") and not config.matches_glob("/home/me/x", "/home/*/work/")


def test_history(spark):
    revs = spark.createDataFrame([("f", 1, "c1", "a\nb\n"), ("f", 2, "c2", "a\nx\nb\n"), ("f", 3, "c3", "A\nx\nb\n")], "path string, position int, commit string, data string")
    assert [(r.line_no, r.commit) for r in history.annotate(revs).orderBy("line_no").collect()] == [(1, "c3"), (2, "c2"), (3, "c1")]
    diff = spark.createDataFrame([(i, x) for i, x in enumerate("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n+c\ndiff --git a/y b/y\nBinary files differ".split("\n"))], "line_no int, line string")
    got = {r.path: (r.added, r.deleted, r.is_binary) for r in history.diffstat(diff).collect()}
    assert got == {"x": (2, 1, False), "y": (0, 0, True)}
    assert {r.path: r.bar for r in history.diffstat_bars(history.diffstat(diff)).collect()} == {"x": "++-", "y": ""}


def test_rule_files_below_an_excluded_folder(spark):
    """A deeper file brings back nothing below a folder that a higher one excludes; beside it, it does."""
    from pyspark.sql import functions as F

    from strataquill.operators import matching

    rules = {"": ["de/", "*.log"], "src4": ["!de/1.txt", "!*.log"], "src4/de": ["!*"]}
    paths = spark.createDataFrame([(x,) for x in ("src4/de/1.txt", "src4/de/sub/x", "src4/a.log", "a.log", "src4/a.txt", "src4/de/")], "path string")
    got = {r.path: r.v for r in paths.select("path", matching.is_ignored_by(F.col("path"), rules).alias("v")).collect()}
    assert got == {"src4/de/1.txt": True, "src4/de/sub/x": True, "src4/a.log": False, "a.log": True, "src4/a.txt": None, "src4/de/": True}


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    from strataquill.plans import lineage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.shared_dir(Session())


def test_intermediate_tables_are_released(spark):
    from strataquill.plans import lineage
    from strataquill.plans.lineage import Materialised

    table = Materialised(spark, "released")
    assert table(spark.range(3)).count() == 3
    path = table.root.removeprefix("file://")
    assert os.path.isdir(path) and lineage.release(spark) > 0 and not os.path.exists(path)


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    from strataquill.streaming import transfers

    os.makedirs(tmp_path / "in")
    pack, _ = packs.write_pack([("blob", b"b" * 80 + bytes([i])) for i in range(4)], 5)
    (tmp_path / "in/a.pack").write_bytes(pack)
    for run in range(2):  # the second run knows nothing of the first, as after a failure before its commit
        q = transfers.resolve_batches(transfers.read_pack_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state{run}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_late_rows_are_dropped(spark, tmp_path):
    from strataquill.streaming.runs import drain

    os.makedirs(tmp_path / "logs")
    day = 86400
    for i, times in enumerate(([5, day + 5], [5 * day], [5 * day + 1], [9, 4 * day + 2000])):
        (tmp_path / f"logs/main.{i}").write_text("".join(f"{'0' * 40} {t:040d} A <a@b> {t} +0000\tm\n" for t in times))
        os.utime(tmp_path / f"logs/main.{i}", (1_000_000 + i, 1_000_000 + i))
    moved = logs.moves_per_window(logs.read_stream(spark, f"{tmp_path}/logs", files_per_trigger=1))
    got = {(r.start.timestamp() // day, r.moves) for r in drain(moved, "append").collect()}
    # The row at 9 comes two batches after the one that moved the watermark to four days and is dropped; days that are not over yet are not given out.
    assert got == {(0, 1), (1, 1)}


def test_delta_candidates_across_ranges(spark, monkeypatch):
    from strataquill.operators import similarity

    monkeypatch.setattr(similarity, "RANGE", 7)
    rows = [(f"{i:04d}", "a" if i < 30 else "b", f"p{i:04d}", i) for i in range(50)]
    found = similarity.delta_bases(spark.createDataFrame(rows, "oid string, type string, path string, size long"), 3)
    assert {r.oid: r.candidates for r in found.collect()} == {f"{i:04d}": [f"{j:04d}" for j in range(max(0 if i < 30 else 30, i - 3), i)] for i in range(50)}
