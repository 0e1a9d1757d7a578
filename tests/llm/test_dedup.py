"""Exact and near deduplication against brute force."""

import functools
import hashlib
import random
import re

import numpy as np
import pytest

from strataquill.llm import exact_dedup as E
from strataquill.llm import near_dedup as N


def brute_exact(rows):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((repr(i), repr(first[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def exact(df, **given):
    return E.exact_dedup(df, **given).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()


def test_golomb():
    rng = np.random.default_rng(1)
    for bits in (8, 24, 50):
        for n in (0, 1, 2, 100):
            v = np.unique(rng.integers(0, 1 << bits, n))
            assert (E.golomb_decode(E.golomb_encode(v, bits)) == v).all()
    v = np.arange(256)
    assert len(E.golomb_encode(v, 8)) < 80


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_on_edges(edges, digest_bytes):
    from tests.llm.conftest import EDGES

    got = exact(edges, digest_bytes=digest_bytes)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_exact(EDGES)
    assert sum(r.kept for r in got) == len({h for *_, h in brute_exact(EDGES)})


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_on_many_copies(make, digest_bytes):
    rng = random.Random(2)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {rng.randint(0, 400)}") for i in range(3000)]
    got = exact(make(rows).repartition(13), digest_bytes=digest_bytes)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_on_nothing(nothing):
    assert exact(nothing) == []


def brute_near(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr(d), len(sets[i]), repr(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def near(df, **given):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in N.near_dedup(df, **given).collect())


def test_near_on_edges(edges):
    from tests.llm.conftest import EDGES

    rows = [(d, t) for d, t in EDGES if d != 4] + [(4, "same text here for all of us today")]
    from tests.llm.conftest import frame

    assert near(frame(edges.sparkSession, rows), words=3, num=85) == brute_near(rows, 3, 85, 100)
    assert len(near(edges)) == len(EDGES)


def test_near_on_nothing(nothing):
    assert near(nothing) == []


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_near_against_brute_force(make):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 150))]
        rows += [(len(rows) + k, edited(rng, base, rng.randint(0, 4))) for k in range(rng.randint(1, 6))]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(100))) for i in range(40)]
    assert near(make(rows), words=3, num=85) == brute_near(rows, 3, 85, 100)
    assert near(make(rows)) == brute_near(rows, 5, 80, 100)


def test_near_on_a_group_larger_than_a_block(make):
    """Copies that are linked through their original but hardly with each other."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))] + [(i, edited(rng, base, 4)) for i in range(1, 3 * N.BLOCK)]
    rows += [(5000 + i, " ".join(f"z{rng.randint(0, 10**9)}" for _ in range(80))) for i in range(50)]
    got = near(make(rows), words=3, num=85)
    assert got == brute_near(rows, 3, 85, 100)


def test_near_links_of_texts_beside_the_typical_one(make):
    """Texts that are linked only with one copy in a large region, which is itself all but equal to the typical text."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base, f"n{i}"])) for i in range(2 * N.BLOCK)]
    for g in range(30):
        one = [*base[:-3], *(f"c{g}-{i}" for i in range(4))]
        far = one[:280] + [f"d{g}-{i}" for i in range(16)] + one[-4:]
        at = rng.randrange(0, 250)
        far[at : at + 3] = [f"e{g}-{i}" for i in range(3)]
        rows += [(1000 + 2 * g, " ".join(one)), (1001 + 2 * g, " ".join(far))]
    want = brute_near(rows, 3, 85, 100)
    assert {x for _, _, x in want} == {"0"}
    assert near(make(rows), words=3, num=85) == want


def test_confirm_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = N.confirm(sets, 60, 100)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x = len(np.intersect1d(a, b))
            if 100 * x >= 60 * (len(a) + len(b) - x):
                assert got[i] == got[j]


def fringe(rng):
    """An original, 1200 copies with one word changed, and 150 texts that are each linked with one copy but not with the original."""
    base = [f"w{i}" for i in range(150)]
    copies = []
    for i in range(1200):
        one = list(base)
        one[i % 150] = f"c{i}"
        copies.append(one)
    rows = [(0, " ".join(base))] + [(1 + i, " ".join(c)) for i, c in enumerate(copies)]
    for i in range(150):
        far = list(copies[7 * i])
        at = (i + 40) % 140
        far[at : at + 9] = [f"f{i}-{j}" for j in range(9)]
        rows.append((5000 + i, " ".join(far)))
    return rows


@functools.cache
def fringe_classes():
    """Rows of fringe() and their classes, from the whole matrix of intersections."""
    rows = fringe(random.Random(8))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    place = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s]] = 1
    common, size = held @ held.T, held.sum(axis=1)
    near, label = 100 * common >= 85 * (size[:, None] + size[None, :] - common), np.arange(len(rows))
    assert not near[0, 1201:].any()
    for _ in range(len(rows)):
        new = np.where(near, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return rows, sorted((repr(d), len(sets[i]), repr(rows[label[i]][0])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("width", [1, 7, 24])
def test_near_hangs_on_no_partition_count(make, spark, width):
    """Links that only single members of a large region have, with region stretches far shorter than the region."""
    rows, want = fringe_classes()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        assert near(make(rows).repartition(5), words=3, num=85, stretch=500) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_on_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one  two three\tfour five six"), ("c", "other words stand here"), (None, None)]
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_dedup(spark.createDataFrame(rows, "doc_id string, text string"), words=3, num=85).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True)}


def test_tiles_hold_every_pair():
    rng = np.random.default_rng(4)
    n = 900
    left, right = rng.integers(0, n, 4000), rng.integers(0, n, 4000)
    left, right = np.minimum(left, right), np.maximum(left, right)
    left, right = left[left != right], right[left != right]
    sizes = rng.integers(1, 20_000, n)
    label = N._components(n, left, right)
    held = set()
    for part in N.tiles(label, left, right, sizes):
        assert len(part) <= N.GROUP and (len(part) <= 2 or sizes[part].sum() <= 2 * N.FULL)
        held |= {(a, b) for a in part.tolist() for b in part.tolist()}
    assert all((a, b) in held for a, b in zip(left.tolist(), right.tolist()))
