"""Tokens, packing and sharding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataquill.llm import packing as P
from strataquill.llm import sharding as S

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello WORLD's it's we'll I'D don't", "x²y³ ½ ǅ ŉ İstanbul ΣΑΣ 漢字かな", "a\x1cb\x1f c\x85d\xa0e", "é é ́x \xad​", "<|endoftext|> a<|startoftext|>b", "", "   \n\t", "''s ''' _a_b_ 12ab34 %%%~~~", "\x00\x01 a\x7fb", "🙂🙂 ok", "​word Größe ÀÉÎ"]


def test_ids_equal_the_tokenizers_own():
    whole = Tokenizer.from_file(PATH)
    encode = P.WordEncoder(PATH, cache_size=50)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeé '.,!\n\t12ßÅ%~") for _ in range(300)) for _ in range(40)]
    for _ in range(2):
        for text, got in zip(texts, encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [4097, 400, 1400, 2500, 10, 4097][seed], 1500)
    if seed == 5:
        lengths[:500] = 2049
    bins, offsets = P.best_two_fit(lengths, 4096)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 4096 and len(fill) >= -(-lengths.sum() // 4096)
    for b in range(len(fill)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
    if seed in (1, 4):
        assert len(fill) <= -(-lengths.sum() // 4096) + 1


def test_two_replace_the_smallest():
    bins, _ = P.best_two_fit(np.array([60, 30, 20, 19]), 100)
    assert bins[0] == bins[2] == bins[3] and len(set(bins)) == 2


def test_packed_documents(spark, edges, nothing):
    from tests.llm.conftest import EDGES

    got = P.pack_documents(edges, PATH, group_size=4).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t in EDGES:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for no, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((repr(d), no, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert P.pack_documents(nothing, PATH).collect() == []


def test_sequences_hold_the_ids(make):
    docs = make([(i, f"words of document {i} " * (i * 40)) for i in range(1, 9)])
    packed = P.pack_documents(docs, PATH)
    joined = {r.sequence_id: bytes(r.ids) for r in P.sequences(packed, P.pieces(docs, PATH, with_ids=True)).collect()}
    for r in packed.collect():
        part = joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32


def test_shards(make, edges, nothing):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(1001)]
    got = S.shard(make(rows).repartition(7), 16, block_rows=10).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(16)]
    assert sorted(r.doc_id for r in got) == list(range(1001)) and set(sizes) == {62, 63}
    for s in range(16):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sizes[s]))
    first = [r.doc_id for r in sorted(got, key=lambda r: (r["shard"], r.slot))]
    assert abs(np.corrcoef(first, range(1001))[0, 1]) < 0.15
    assert len(S.shard(edges).collect()) == edges.count() and S.shard(nothing).collect() == []


def test_matrix_has_the_hypergeometric_law():
    rows = [40, 10, 0, 50]
    total = np.zeros((4, 4))
    for seed in range(400):
        m = S.draw_matrix(rows, 4, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == [25] * 4 and (m >= 0).all()
        total += m
    assert np.abs(total / 400 - np.array(rows)[:, None] / 4).max() < 0.5
    draws = [S.draw_matrix(rows, 4, s)[0, 0] for s in range(400)]
    assert abs(np.var(draws) - 40 * 0.25 * 0.75 * 60 / 99) < 1.2


def test_large_counts_have_the_hypergeometric_law():
    """The law for counts beyond the generator's own: against exact probabilities for small numbers, by moments for a million millions."""
    from math import comb

    rng = np.random.default_rng(1)
    for good, bad, sample in ((10, 12, 7), (3, 40, 20), (30, 5, 31)):
        for x in range(max(0, sample - bad), min(sample, good) + 1):
            p = comb(good, x) * comb(bad, sample - x) / comb(good + bad, sample)
            assert abs(np.exp(S.log_hypergeometric(x, good, bad, sample)) / p - 1) < 1e-9
        draws = [S.large_hypergeometric(rng, good, bad, sample) for _ in range(20_000)]
        share = np.bincount(draws, minlength=sample + 1)[: sample + 1] / 20_000
        exact = np.array([comb(good, x) * comb(bad, sample - x) / comb(good + bad, sample) if sample - x <= bad else 0 for x in range(sample + 1)])
        assert np.abs(share - exact).max() < 0.015
    for good, bad, sample in ((10**12, 3 * 10**12, 10**9), (5 * 10**11, 5 * 10**11, 4 * 10**11)):
        n = good + bad
        mean, var = sample * good / n, sample * (good / n) * (bad / n) * (n - sample) / (n - 1)
        draws = np.array([S.large_hypergeometric(rng, good, bad, sample) for _ in range(4000)], float)
        z = (draws - mean) / var**0.5
        assert abs(z.mean()) < 0.08 and abs(z.var() - 1) < 0.1 and abs((z**3).mean()) < 0.25 and abs((np.abs(z) < 1).mean() - 0.6827) < 0.04
    small = [S.large_hypergeometric(rng, 400, 600, 100) for _ in range(4000)]
    other = rng.hypergeometric(400, 600, 100, 4000)
    assert abs(np.mean(small) - other.mean()) < 0.4 and abs(np.var(small) / other.var() - 1) < 0.12


def test_matrix_of_a_million_millions():
    m = S.draw_matrix([10**12, 7, 3 * 10**11], 16, 5)
    assert m.sum(axis=1).tolist() == [10**12, 7, 3 * 10**11] and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()


def test_own_columns_survive(spark):
    got = S.shard(spark.createDataFrame([(i, f"s{i}", i * 2) for i in range(20)], "id long, shard string, slot long"), 4)
    assert {(r.id, r.own_shard, r.own_slot) for r in got.collect()} == {(i, f"s{i}", i * 2) for i in range(20)}


def test_query_against_plain_python(spark, data):
    """Sizes and checksums row by row; counts at most one apart; slots without gaps."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = S.op4_hypergeometric_sharding(spark, data).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = np.bincount([r["shard"] for r in got], minlength=16)
    assert np.ptp(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))


def plain_best_two_fit(lengths, capacity):
    """Bins by lists alone: fill greedily with the largest that fits; then swap a bin's smallest for the two that fill its gap best."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        now, room = [], capacity
        for x in list(left):
            if x <= room:
                now.append(x)
                left.remove(x)
                room -= x
        small = now[-1]
        gap = room + small
        best = None
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                if small < a + b <= gap and (best is None or a + b > sum(best)):
                    best = (a, b)
        if best:
            now.pop()
            left.append(small)
            for x in best:
                now.append(x)
                left.remove(x)
            left.sort(reverse=True)
        bins.append(now)
    return bins


def test_best_two_fit_is_as_good_as_lists():
    rng = np.random.default_rng(2)
    for _ in range(12):
        lengths = rng.integers(1, 100, 60)
        where, offset = P.best_two_fit(lengths, 100)
        fill = np.bincount(where, lengths)
        assert fill.max() <= 100
        assert len(fill[fill > 0]) <= len(plain_best_two_fit(lengths.tolist(), 100)) + 1


def test_pieces_are_bounded_by_bytes(make):
    """Texts of a megabyte and more come one at a time."""
    import pyarrow as pa

    from strataquill.llm import _text

    batch = pa.record_batch({"id": pa.array(range(5)), "text": pa.array(["x" * 1_500_000] * 5)})
    assert [b.num_rows for b in _text.slices(iter([batch]), 1)] == [1] * 5
    got = P.pieces(make([(i, "long words " * 20_000) for i in range(3)]), PATH).groupBy("doc_id").sum("length").collect()
    assert len({r[1] for r in got}) == 1 and len(got) == 3
