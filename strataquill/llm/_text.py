"""Vectorised hashing of words and character n-grams over Arrow string batches (numpy only)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What each byte adds to its word's hash, lower-cased and as it is.
_CODES = {True: _LOWER.astype(U64) + U64(1), False: np.arange(256, dtype=U64) + U64(1)}
#: Powers of each base so far.
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """At least the first ``n`` powers of ``base``, modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n + -n % (1 << 16), U64(base), dtype=U64)  # some more, for blocks differ in length
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out, out=out)
    return _POWERS[base]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Bytes of texts that operators work on at once.
BLOCK = 1 << 20
#: Bytes that word hashing works on at once; its working memory is some sixty times as much.
SPAN = 1 << 18


#: Functions that drop caches which other operators left in this process: workers serve one stage after another.
HELD: list[Callable[[], None]] = []


def slices(batches: Iterator[pa.RecordBatch], column: int = 0, most_bytes: int = BLOCK, most_rows: int = 512, own: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches with a bounded number of rows and, but for single long texts, of text bytes in ``column``.

    Caches of other operators in this process are dropped first; ``own`` is the function that drops the caller's, which stay.
    """
    for drop in HELD:
        if drop != own:
            drop()
    for whole in batches:
        sizes = pc.binary_length(whole.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at, n = 0, whole.num_rows
        while at < n:
            before = int(ends[at - 1]) if at else 0
            end = min(n, at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
            yield whole.slice(at, end - at)
            at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ``space``: ASCII white space) of each text.

    Returns (64-bit hash of each word, start byte, end byte, index of the text). Works block by block, cut between words.
    """
    found, a, n = [], 0, len(data)
    while a < n:
        b = a + SPAN
        while b < n:
            gap = np.flatnonzero(space[data[b : b + 65536]])
            if len(gap):
                b += int(gap[0])
                break
            b += 65536
        b = min(b, n)
        inside = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)]
        hashes, starts, ends = _block(data[a:b], inside - a, lower, space)
        found.append((hashes, starts + a, ends + a))
        a = b
    if not found:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]
    return hashes, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _block(data: np.ndarray, cuts: np.ndarray, lower: bool, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~np.take(space, data, mode="clip")
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:])
    edge[cuts] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], len(data))
    keep = solid[at]
    starts, ends = at[keep], ends[keep]
    # Polynomial hash of each word: the sum of its bytes' codes times the base's powers by place in the block, divided by the power at the word's start.
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.take(_CODES[lower], data, out=sums[1:], mode="clip")
    sums[1:] *= _powers(len(data))[: len(data)]
    np.cumsum(sums, out=sums)
    hashes = sums[ends]
    hashes -= sums[starts]
    if len(starts):
        hashes *= _powers(int(starts[-1]) + 1, _INVERSE)[starts]
    return mix(hashes ^ (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D)), starts, ends


def spans(text: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each text's words, for ``text`` sorted ascending."""
    return np.searchsorted(text, np.arange(n + 1))


#: Separators for lines.
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[[10, 13]] = True


def word_ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram hash below 2**bits) of every character n-gram of lower-cased words between edge marks, over UTF-8 units."""
    lens = ends - starts + 2
    total = int(lens.sum())
    word = np.repeat(np.arange(len(lens)), lens)
    base = np.cumsum(lens) - lens
    pos = np.arange(total) - base[word]
    chars = _LOWER[data[np.clip(starts[word] + pos - 1, 0, max(0, len(data) - 1))]].astype(U64)
    chars[base] = 1
    chars[base + lens - 1] = 2
    chars += U64(1)
    rest = lens[word] - pos
    owners, grams = [], []
    for n in sizes:
        at = np.flatnonzero(rest >= n)
        h = np.full(len(at), U64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for j in range(n):
            h = (h ^ chars[at + j]) * U64(0x100000001B3)
        grams.append((mix(h) >> U64(64 - bits)).astype(np.int64))
        owners.append(word[at])
    return np.concatenate(owners), np.concatenate(grams)
