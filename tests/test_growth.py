"""What operators move and where they work, on inputs that would make a careless plan grow with the square of a group."""

import base64
import difflib
import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataquill.functions import codecs, diffs
from strataquill.functions._udf import vectorised
from strataquill.operators import blocks, graph, history, merging, rewriting, similarity, store
from strataquill.plans import closure
from strataquill.sources import packs


def moved(spark, act):
    """Shuffled rows of all stages that ``act`` runs."""
    context = spark.sparkContext
    stages = lambda: context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None))
    known = {(s.stageId(), s.attemptId()) for s in stages()}
    out = act()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(s.shuffleWriteRecords() for s in stages() if (s.stageId(), s.attemptId()) not in known)


def moved_bytes(spark, act):
    """Shuffled bytes of all stages that ``act`` runs."""
    context = spark.sparkContext
    stages = lambda: context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None))
    known = {(s.stageId(), s.attemptId()) for s in stages()}
    out = act()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(s.shuffleWriteBytes() for s in stages() if (s.stageId(), s.attemptId()) not in known)


def test_similar_blobs_do_not_meet_by_a_line_that_all_have(spark):
    """F1, F2: 1500 blobs with one line in common make 1500 pairs, not 1500 squared, and scores stay those of all pairs."""
    text = lambda i, last: "common to all\n" + "".join(f"line {k} of {i}\n" for k in range(6)) + last
    old = spark.createDataFrame([(f"a{i}", text(i, "")) for i in range(1500)], "oid string, data string")
    new = spark.createDataFrame([(f"b{i}", text(i, "edited\n")) for i in range(1500)], "oid string, data string")
    got, rows = moved(spark, lambda: similarity.similarity(old, new, 60).select("left_oid", "right_oid").collect())
    assert sorted(tuple(r) for r in got) == sorted((f"a{i}", f"b{i}") for i in range(1500))
    assert rows < 200_000
    rng = random.Random(3)
    blobs = [(f"o{i}", "".join(rng.choice(["x\n", "yy\n", "zzz\n", f"u{i % 5}\n"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(blobs, "oid string, data string")
    pairs = lambda d: sorted((r.left_oid, r.right_oid, r.score) for r in d.collect())
    every = similarity.similarity(df, df)
    for threshold in (0, 33, 60, 99):
        assert pairs(similarity.similarity(df, df, threshold)) == pairs(every.where(F.col("score") > threshold))


def test_similar_blobs_move_keys_not_texts(spark):
    """blobs of many blocks are found with fewer bytes shuffled than they have, and many near copies without their blocks once a pair."""
    rng = random.Random(6)
    line = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) + "\n"
    texts = ["".join(line() for _ in range(rng.randint(40, 120))) for _ in range(600)]
    frame = lambda name, rows: spark.createDataFrame([(f"{name}{i}", x) for i, x in enumerate(rows)], "oid string, data string")
    old, new = frame("a", texts), frame("b", [x + "edited\n" for x in texts])
    got, size = moved_bytes(spark, lambda: similarity.similarity(old, new, 60).select("left_oid", "right_oid").collect())
    assert sorted(tuple(r) for r in got) == sorted((f"a{i}", f"b{i}") for i in range(600))
    assert size < sum(map(len, texts))
    one = [line() for _ in range(100)]
    near = ["".join(one[:i] + [f"{i} {n}\n"] + one[i + 1 :]) for n in range(3) for i in range(100)]
    left, right = frame("a", near), frame("b", near)
    got, size = moved_bytes(spark, lambda: similarity.similarity(left, right, 60).count())
    assert got == 300 * 300
    assert size < got * 100  # a blob of a hundred blocks has 6000 bytes


def test_similar_blobs_of_odd_inputs(spark):
    """F1, F2: copies, nulls, empty blobs, other letters and long lines get the scores of all pairs."""
    rng = random.Random(7)
    piece = lambda: rng.choice(["\n", "\r\n", "é" * rng.randint(1, 70) + "\n", "\U0001f600" * 40, "x" * rng.choice([63, 64, 65, 128, 200]) + "\n", "same\n", "tail"])
    texts = ["".join(piece() for _ in range(rng.randint(0, 7))) for _ in range(80)] + [""]
    side = lambda name: [(f"{name}{i}", x) for i, x in enumerate(dict.fromkeys(texts))]
    frame = lambda rows: spark.createDataFrame(rows, "oid string, data string")
    old, new = side("a"), side("b")
    pairs = lambda d: sorted((r.left_oid, r.right_oid, r.score) for r in d.collect())
    every = pairs(similarity.similarity(frame(old), frame(new)))
    for threshold in (0, 50, 99):
        assert pairs(similarity.similarity(frame(old * 3 + [("none", None)]), frame(new * 2), threshold)) == [r for r in every if r[2] > threshold]
    none = frame([("e", "")])
    assert pairs(similarity.similarity(none, none, 60)) == [("e", "e", 100)]
    assert pairs(similarity.similarity(none, none.limit(0), 60)) == pairs(similarity.similarity(frame(old), none.limit(0), 60)) == []


def test_similar_blobs_hang_on_no_order_or_buckets(spark, monkeypatch):
    """F1, F2: with few or no blocks in the order of blocks, and with many buckets of partners, the scores are the same."""
    rng = random.Random(8)
    rows = [(f"o{i}", "".join(rng.choice(["x\n", "yy\n", "zzz\n", f"u{i % 5}\n", f"v{i % 9} {i % 2}\n"]) for _ in range(rng.randint(1, 9)))) for i in range(90)]
    df = spark.createDataFrame(rows, "oid string, data string")
    pairs = lambda: sorted((r.left_oid, r.right_oid, r.score) for r in similarity.similarity(df, df, 40).collect())
    want = sorted((r.left_oid, r.right_oid, r.score) for r in similarity.similarity(df, df).where("score > 40").collect())
    for placed, counted, held in ((0, 1 << 21, 1 << 24), (2, 1, 64)):
        monkeypatch.setattr(blocks, "PLACED", placed)
        monkeypatch.setattr(blocks, "COUNTED", counted)
        monkeypatch.setattr(blocks, "HELD", held)
        assert pairs() == want


def test_a_source_is_chosen_without_moving_all_pairs(spark):
    """of 90,000 pairs, one for each new path and task moves and none is written, and what is chosen is what taking pairs one after another gives."""
    score = lambda i, j: 61 + (i * 7 + j * 13) % 39
    every = [(f"a{i:03}", f"b{j:03}", score(i, j)) for i in range(300) for j in range(300)]
    pairs = spark.createDataFrame(every, "old_path string, new_path string, score int")
    pairs = pairs.select("old_path", F.col("old_path").alias("old_oid"), F.lit(1).alias("old_mode"), F.lit(True).alias("moved"), "new_path", F.col("new_path").alias("new_oid"), F.lit(1).alias("new_mode"), "score")
    folders = lambda: len(spark.sparkContext.__dict__.get("_strataquill_scratch", []))
    before = folders()
    got, rows = moved(spark, lambda: similarity.greedy(pairs).select("change_type", "old_path", "new_path").collect())
    assert folders() == before
    used, want = set(), {}
    for old, new, _ in sorted(every, key=lambda r: (-r[2], r[0], r[1])):
        if new not in want:
            want[new] = ("copy" if old in used else "rename", old, new)
            used.add(old)
    assert sorted(tuple(r) for r in got) == sorted(want.values())
    assert rows < 10_000


def test_range_diff_is_not_settled_on_the_driver(spark, monkeypatch):
    """patches without partners never meet in one matrix, and the assignment costs no more than that of all of them."""
    rng = random.Random(4)
    base = [[f"+line {i} {k}\n" for k in range(rng.randint(1, 8))] for i in range(12)]
    edited = [[x for x in p if rng.random() < 0.8] + [f"+new {i}\n"] * (i % 2) + ["+shared\n"] * (i % 3) for i, p in enumerate(base)] + [[f"+other {i}\n"] for i in range(5)]
    old, new = ["".join(p) for p in base], ["".join(p) for p in edited]
    frame = lambda ps: spark.createDataFrame([(i + 1, p if p != "" else "e", p) for i, p in enumerate(ps)], "position long, patch_id string, patch string")
    size = lambda p, f: p.count("\n") * f // 100

    def price(rows, f):
        return sum(diffs.diff_size(old[a - 1], new[b - 1]) if a and b else size(old[a - 1], f) if a else size(new[b - 1], f) for a, b in rows)

    want = {f: diffs.assign_patches(old, new, f) for f in (0, 60, 100, 150)}
    monkeypatch.setattr(diffs, "assign_patches", lambda *_: 1 / 0)  # of this process; tasks have their own
    for f, rows in want.items():
        got = [tuple(r) for r in history.range_diff(frame(old), frame(new), f).collect()]
        assert sorted(a for a, _, _ in got if a) == list(range(1, len(old) + 1)) and sorted(b for _, b, _ in got if b) == list(range(1, len(new) + 1))
        assert all(s == ("<" if b is None else ">" if a is None else s) and (s in "=!") == (a is not None and b is not None) for a, b, s in got)
        equal = sum(1 for _, _, s in got if s == "=")
        assert equal == len(set(old) & set(new)) or len(set(old)) < len(old)
        assert price([(a, b) for a, b, _ in got], f) == price([(None if i is None else i + 1, None if j is None else j + 1) for i, j in rows], f)
    assert any(i is not None and j is not None for i, j in want[60])


def test_a_small_frontier_moves_no_edges(spark):
    """A closure from one node shuffles rows of what it finds, not the edges once a level."""
    edges = spark.range(20_000).selectExpr("id as commit", "1 as parent_no", "id div 2 as parent").where("commit > 0")
    got, rows = moved(spark, lambda: sorted((r.node, r.depth) for r in graph.ancestors(edges, spark.createDataFrame([(19_999,)], "node long")).collect()))
    want, n = {}, 19_999
    while n not in want:
        want[n] = len(want)
        n //= 2
    assert got == sorted(want.items())
    assert rows < 5_000


def test_closures_of_small_and_large_frontiers_agree(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(i, i + 1) for i in range(100, 150)] + [(3, 100), (3, 100)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    seeds = spark.createDataFrame([("a", 1), ("b", 3), ("b", 7)], "key string, node int")
    every = lambda **k: sorted(tuple(r) for r in closure.closure(edges, seeds, keys=("key",), **k).collect())
    for k in ({}, {"max_depth": 6}, {"stop": spark.createDataFrame([(120,), (9,)], "node int")}):
        monkeypatch.setattr(closure, "NEAR", 100_000)
        near = every(**k)
        monkeypatch.setattr(closure, "NEAR", -1)
        assert every(**k) == near


def test_a_partition_of_several_chunks_becomes_several_packs(spark):
    """a task holds one chunk's pack, not its whole partition's."""
    rows = [("blob", f"p{i:03}", 4, b"%04d" % i, i % 7) for i in range(140)]
    objects = spark.createDataFrame(rows, "type string, path string, size long, data binary, chunk int").coalesce(1)
    made = rewriting.pack_partitions(objects, 1, by="chunk").collect()
    found = [[bytes(e[6]) for e in packs.parse_pack(bytes(r["pack"]))] for r in made]
    assert len(made) == 7 and all(len(f) == 20 for f in found)
    assert sorted(sum(found, [])) == sorted(r[3] for r in rows)


def test_functions_get_slices_of_batches(spark):
    """A function holds objects of about a MB of arguments, however many rows and bytes an Arrow batch has."""

    @vectorised("struct<rows:long, first:string>")
    def seen(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": len(a), "first": [x if x is None else x[:1] for x in a], "b": b})

    def at(i):
        return None if i % 7 == 0 else str(i % 10) * 1000

    rows = spark.range(4000, numPartitions=1).selectExpr("id", "case when id % 7 > 0 then repeat(cast(id % 10 as string), 1000) end as a")
    got = rows.select("id", seen("a", F.col("a").cast("binary")).alias("x")).select("id", "x.*").collect()
    assert [(r.id, r["first"]) for r in got] == [(i, at(i) and at(i)[:1]) for i in range(4000)]
    assert 1 < max(r.rows for r in got) < 1000
    long = spark.range(3, numPartitions=1).selectExpr("repeat('x', 3000000) as a")
    assert [r.x.rows for r in long.select(seen("a", "a").alias("x")).collect()] == [1, 1, 1]
    assert rows.where("id < 0").select(seen("a", "a").alias("x")).collect() == []


def test_base85_codes_blocks_of_lines_at_once():
    """lines of any length and form come out as digit by digit, in a time that doesn't count digits in Python."""
    rng = random.Random(6)
    for n in (0, 1, 4, 51, 52, 53, 104, 156, 52 * 8192 + 30):
        data = rng.randbytes(n)
        text = codecs.base85_encode(data)
        assert text == "".join(chr(len(p) + (64 if len(p) <= 26 else 70)) + base64.b85encode(p, pad=True).decode() + "\n" for p in (data[i : i + 52] for i in range(0, n, 52)))
        assert codecs.base85_decode(text) == data
    data = rng.randbytes(104)
    text = codecs.base85_encode(data)
    assert codecs.base85_decode(f"{codecs.base85_encode(b'short')}{text}") == b"short" + data
    for bad in (text[:70] + "/" + text[71:], text[:1] + "~~~~~" + text[6:], text[:70] + "é" + text[71:]):
        with pytest.raises((ValueError, OverflowError)):
            codecs.base85_decode(bad)
    large = rng.randbytes(4_000_000)
    start = time.process_time()
    assert codecs.base85_decode(codecs.base85_encode(large)) == large
    assert time.process_time() - start < 2.5


def test_annotate_streams_revisions(spark):
    """no data frame for each path; lines of many paths, of empty ones and of long histories come out as by one fold for each."""
    rng = random.Random(7)
    histories = {f"p{i}": ["".join(rng.choice("abc") + "\n" for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))] for i in range(200)} | {None: ["a\n", "b\na"]}
    histories["long"] = ["".join(f"{k} {'x' * 1000}\n" for k in range(i)) for i in range(1500, 3000, 500)]
    rows = [(p, n, f"c{n}", text or None) for p, texts in histories.items() for n, text in enumerate(texts)]
    rng.shuffle(rows)
    found = history.annotate(spark.createDataFrame(rows, "path string, position int, commit string, data string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = []
    for p, texts in histories.items():
        known = []
        for n, text in enumerate(texts):
            known = diffs.reattribute(known, diffs.lines_of(text), f"c{n}")
        want += [(p, i, *x) for i, x in enumerate(known, 1)]
    key = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def test_added_ends_are_found_without_a_search(monkeypatch):
    """where one side holds the other in one piece, operations are those of the search for longest matches, without it."""
    rng, search = random.Random(8), difflib.SequenceMatcher
    piece = lambda n: [rng.choice("ab") for _ in range(rng.randint(0, n))]
    for _ in range(3000):
        a = piece(6)
        a, b = rng.choice([(a, piece(2) + a + piece(2)), (piece(2) + a + piece(2), a), (a, piece(6))])
        assert diffs.opcodes(a, b) == search(None, a, b, False).get_opcodes()
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *_: 1 / 0)
    many = ["x\n"] * 20_000
    assert diffs.opcodes(many, ["top\n", *many, "end\n"]) == [("insert", 0, 0, 0, 1), ("equal", 0, 20_000, 1, 20_001), ("insert", 20_000, 20_000, 20_001, 20_002)]


def test_smudge_moves_pointers_only(spark):
    """files that are no pointers don't meet at one key; pointers without contents stay."""
    pointer = lambda i: f"version https://git-lfs.github.com/spec/v1\noid sha256:{i:064x}\nsize 9\n"
    rows = [(i, f"text {i}") for i in range(3000)] + [(3000, None), (3001, pointer(1)), (3002, pointer(1)), (3003, pointer(2))]
    files = spark.createDataFrame(rows, "path long, data string")
    large = spark.createDataFrame([(f"{1:064x}", "content 1"), (f"{3:064x}", "content 3")], "oid string, content string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, n = moved(spark, lambda: sorted(tuple(r) for r in store.smudge(files, large).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [*rows[:3001], (3001, "content 1"), (3002, "content 1"), (3003, pointer(2))]
    assert n < 20


def test_merges_move_blobs_once(spark):
    """contents move to ids and to paths once, and not at all if no content is to be merged; a blob that is known twice adds no row."""
    oid = lambda t: hashlib.sha1(f"blob {len(t)}\0{t}".encode()).hexdigest()
    texts = {f"p{i}": (f"line {i}\n", f"top\nline {i}\n", f"line {i}\nend\n") for i in range(500)}
    frame = lambda n: spark.createDataFrame([(p, oid(t[n]), 0o100644) for p, t in texts.items()], "path string, oid string, mode int")
    blobs = spark.createDataFrame([(oid(x), x) for t in texts.values() for x in t] + [(oid("line 3\n"), "line 3\n"), (oid("top\nline 4\n"), "top\nline 4\n")], "oid string, data string")
    base, ours, theirs = (frame(n) for n in range(3))
    merged = sorted((p, oid(f"top\nline {p[1:]}\nend\n"), False) for p in texts)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, n = moved(spark, lambda: sorted(tuple(r) for r in merging.merge_files(base, ours, theirs, blobs)[0].select("path", "oid", "conflict").collect()))
        assert got == merged
        assert n < 7000  # 1500 rows of the sides, 1500 ids, 1502 blobs, at most 1502 contents
        got, n = moved(spark, lambda: sorted(tuple(r) for r in merging.merge_files(base, ours, base, blobs)[0].select("path", "oid", "conflict").collect()))
        assert got == sorted((p, oid(t[1]), False) for p, t in texts.items())
        assert n < 2100
        twice = merging.recursive_merge([base.where("oid < '8'"), base], ours, theirs, blobs)[0]
        assert sorted(tuple(r) for r in twice.select("path", "oid", "conflict").collect()) == merged
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_wide_layers_are_sought_once_a_step(monkeypatch):
    """op7: one look at all classes' layers for each step and score; a class whose exponentials would overflow is still scored."""
    from strataquill.llm import lm_score

    looks, wide = [], lm_score._wide
    monkeypatch.setattr(lm_score, "_wide", lambda x: looks.append(x.shape) or wide(x))
    net = lm_score.Window()
    net.word[1, :, 0] = 100
    token = (np.arange(4096) * 37 % lm_score.VOCABULARY).astype(np.int16)
    context = lm_score.contexts(token, np.zeros(4096, np.int64))
    assert np.isfinite(net.log_prob(context, token)).all()
    net.train(context, token)
    assert np.isfinite(net.weights).all()
    assert len(looks) == 4  # the classes' layer and all words' layers, twice


def test_steps_hold_few_shares_and_sum_each_place_once():
    """op7: a step holds the shares of a block of places, not of all, and adds up slopes by token once a column, not once an offset and column."""
    import tracemalloc

    from strataquill.llm import lm_score

    rng = np.random.default_rng(5)
    token = (lm_score.PAD * rng.random(lm_score.STEP) ** 3).astype(np.int16)
    context = lm_score.contexts(token, np.arange(len(token)) // 50)
    net = lm_score.Window(rng.normal(0, 0.3, lm_score.Window.SIZE))
    peaks, sums, bincount = [], [], np.bincount
    for step in (net.log_prob, net.train):
        tracemalloc.start()
        step(context, token)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    print("peaks", peaks)
    np.bincount = lambda *a, **k: sums.append(len(a[0])) or bincount(*a, **k)
    try:
        net.train(context, token)
    finally:
        np.bincount = bincount
    assert sum(sums) <= lm_score.WIDTH * (len(token) + 2 * lm_score.RADIUS)
    assert peaks[0] < 4e6 and peaks[1] < 8e6


def test_steps_at_cuts_of_texts_and_of_steps():
    """op7: slopes by embeddings and gates are those of plain loops, also where a step's first and last places have neighbours in other steps."""
    from strataquill.llm import lm_score as L

    rng = np.random.default_rng(6)
    token = rng.integers(0, L.PAD, 90).astype(np.int16)
    context = L.contexts(token, np.repeat([0, 1, 2, 3], [31, 2, 27, 30]))
    for cut in (slice(0, 90), slice(30, 34), slice(40, 41), slice(45, 90)):
        net = L.Window(rng.normal(0, 0.3, L.Window.SIZE))
        start, part, own = net.weights.copy(), context[:, cut], token[cut]
        net.train(part, own)
        got = L.Window.views(net.moments[0] * 10)
        for name, row in [("embed", L.PAD), *(("embed", t) for t in sorted({*part[:, 0], *part[:, -1]})), *(("gate", k) for k in range(2 * L.RADIUS))]:
            i = int(np.argmax(np.abs(got[name][row])))
            loss = []
            for d in (0.01, -0.01):
                moved = L.Window(start)
                getattr(moved, name)[row, i] += d
                loss.append(-moved.log_prob(part, own).mean())
            assert abs((loss[0] - loss[1]) / 0.02 - got[name][row, i]) < 0.02 * abs(got[name][row, i]) + 1e-4


def test_words_are_found_among_equal_beginnings():
    """op7: the search by first bits finds what a binary search finds, whatever the hashes are."""
    from strataquill.llm import lm_score

    rng = np.random.default_rng(7)
    spread = rng.integers(-(2**63), 2**63 - 1, 3000)
    ends = np.array([-(2**63), -1, 0, 1, 2**63 - 1])
    for words in (spread, rng.integers(0, 500, 300), ends, spread[:1]):
        words = np.unique(words)
        places = lm_score.Places(words)
        assert (places.find(words) == np.arange(len(words))).all()
        other = np.setdiff1d(np.concatenate([words + 1, words - 1, ends]), words)
        at = places.find(other)
        assert (at >= 0).all() and (words[at] != other).all()


def test_word_hashes_against_plain_arithmetic():
    """op7 and all that hash words: the sums over a block give the same hash as each word's own polynomial, wherever it stands."""
    import pyarrow as pa

    from strataquill.llm import _text

    def plain(word):
        h = sum((c + 32 * (65 <= c <= 90) + 1) * pow(_text._BASE, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)
        return int(_text.mix(np.array([h ^ len(word) * 0x2545F4914F6CDD1D % (1 << 64)], np.uint64))[0])

    texts = ["Aa b\tZé", "", None, " x ", "y" * 70_000 + " tail", "one two " * 200_000]
    data, offsets = _text.utf8(pa.array(texts))
    hashes, starts, ends, text = _text.words(data, offsets)
    words = [t.encode().split() for t in texts if t is not None]
    assert len(hashes) == sum(map(len, words)) and text.tolist() == [i for i, t in enumerate(texts) for _ in (t or "").encode().split()]
    want = {w: plain(w) for t in words for w in set(t)}
    assert hashes.tolist() == [want[w] for t in words for w in t]
