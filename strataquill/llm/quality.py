"""Document quality from weak labels.

Heuristic labellers each vote good, bad or nothing on a text. Expectation-maximisation over the counts of all vote patterns in
the corpus estimates each labeller's accuracy on good texts and on several kinds of bad ones, and the kinds' shares; a
pattern's posterior of good is its soft label. A logistic regression over hashed features is trained on the posteriors of a bounded sample and
scores every text, so that near misses of the labellers' rules count too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm import _linear, _text
from strataquill.shipping import ship

#: Rows at most in the regression's sample.
SAMPLE = 12_000
BITS = 14
#: Texts of fewer words get no vote from labellers of shares and repetition.
SHORT = 8

# Shape of a byte: 0 lower-case letter, 1 upper-case letter, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 other plain
# mark, 7 exclamation mark, 8 bar, 9 other symbol, 10 byte of a character beyond ASCII.
_SHAPE = np.full(256, 9, np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 0, 1, 2, 10
_SHAPE[[9, 32]], _SHAPE[[10, 13]] = 3, 4
_SHAPE[[ord(c) for c in ".,?;:"]], _SHAPE[[ord(c) for c in "'\"()-"]] = 5, 6
_SHAPE[ord("!")], _SHAPE[ord("|")] = 7, 8
_SHAPES = 11

STATISTICS = ("upper", "symbols", "exclaims", "bars", "distinct", "repeats", "line_repeats", "digits", "word_length", "plain_ends")
_EDGES = {
    "upper": [0.01, 0.03, 0.06, 0.12, 0.25, 0.5], "symbols": [0.005, 0.01, 0.02, 0.04, 0.08, 0.16], "exclaims": [0.01, 0.05, 0.1, 0.3, 1],
    "bars": [0.005, 0.02, 0.05, 0.1, 0.3], "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95], "repeats": [0.01, 0.03, 0.08, 0.2, 0.5],
    "line_repeats": [0.05, 0.1, 0.2, 0.4, 0.8], "digits": [0.01, 0.03, 0.1, 0.2, 0.4], "word_length": [2, 3, 4, 5, 6, 7, 9, 12], "plain_ends": [0.1, 0.3, 0.5, 0.7, 0.9, 0.99],
}
#: Labeller: (statistic, whether large values are bad, bad beyond, good on the other side of). Between the two there is no vote.
LABELLERS = (("upper", True, 0.4, 0.12), ("symbols", True, 0.08, 0.03), ("exclaims", True, 0.3, 0.1), ("bars", True, 0.05, 0.01), ("distinct", False, 0.3, 0.45), ("repeats", True, 0.2, 0.05), ("line_repeats", True, 0.35, 0.15), ("digits", True, 0.5, 0.2), ("word_length", True, 9.0, 7.5), ("plain_ends", False, 0.3, 0.7))


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, matrix of STATISTICS) of each text."""
    n = len(offsets) - 1
    shapes, wide, capital = np.zeros((n, _SHAPES)), np.zeros(n), np.zeros(n)
    for a in range(0, len(data), _text.BLOCK):
        part = data[a : a + _text.BLOCK]
        text_of = np.searchsorted(offsets, np.arange(a, a + len(part)), side="right") - 1
        shapes += np.bincount(text_of * _SHAPES + _SHAPE[part], minlength=n * _SHAPES).reshape(n, _SHAPES)
        # Characters beyond ASCII: their first bytes; two-byte capitals of Latin-1 count as capitals.
        wide += np.bincount(text_of[part >= 0xC0], minlength=n)
        at = np.flatnonzero(part == 0xC3)
        after = data[np.minimum(a + at + 1, len(data) - 1)]
        capital += np.bincount(text_of[at[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)]], minlength=n)
    hashes, _, ends, text = _text.words(data, offsets)
    words = np.bincount(text, minlength=n).astype(float)
    some = np.maximum(words, 1)
    _, back = np.unique(hashes, return_inverse=True)
    ids = back.ravel() if len(hashes) else np.zeros(0, np.int64)
    pairs = np.unique(text * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    distinct = np.bincount(pairs // (int(ids.max()) + 1 if len(ids) else 1), minlength=n)
    again = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n)
    lines, _, line_ends, line_text = _text.words(data, offsets, False, _text.NEWLINE)
    line_count = np.maximum(np.bincount(line_text, minlength=n), 1)
    _, back = np.unique(lines, return_inverse=True)
    ids = back.ravel() if len(lines) else np.zeros(0, np.int64)
    wide_id = int(ids.max()) + 1 if len(ids) else 1
    line_distinct = np.bincount(np.unique(line_text * wide_id + ids) // wide_id, minlength=n)
    plain = np.bincount(line_text[np.isin(data[line_ends - 1], [ord(c) for c in ".?!:;\""])], minlength=n) if len(lines) else np.zeros(n)
    letters = np.maximum(shapes[:, 0] + shapes[:, 1] + wide, 1)
    solid = np.maximum(shapes.sum(axis=1) - shapes[:, 3] - shapes[:, 4] - shapes[:, 10] + wide, 1)
    out = np.column_stack([(shapes[:, 1] + capital) / letters, shapes[:, 9] / solid, shapes[:, 7] / some, shapes[:, 8] / some, np.where(words > 0, distinct / some, 1), again / some, np.where(line_distinct > 0, 1 - line_distinct / line_count, 0), shapes[:, 2] / solid, np.where(words > 0, solid / some, 5), np.where(line_distinct > 0, plain / line_count, 1)])
    return words.astype(np.int64), out


def votes(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Votes by text and labeller: 1 good, 2 bad, 0 none."""
    out = np.zeros((len(words), len(LABELLERS)), np.int64)
    for j, (name, large, bad, good) in enumerate(LABELLERS):
        x = found[:, STATISTICS.index(name)]
        out[:, j] = np.where(x > bad if large else x < bad, 2, np.where(x < good if large else x > good, 1, 0))
    out[words < SHORT] = 0
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    return vote @ 3 ** np.arange(vote.shape[1])


def estimate(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """(posterior of good by pattern, probability of a bad vote by class and labeller, shares of the classes).

    Expectation-maximisation over one class of good texts and one of bad texts for each labeller: kinds of junk
    exclude each other more often than not, so a single class of bad texts would take one labeller's silence for another's
    praise. Missing votes say nothing. Classes start where their labeller votes bad nine times in ten, and a little
    smoothing keeps every probability off 0 and 1.
    """
    keys = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[k] for k in keys.tolist()], float)
    k = len(LABELLERS)
    vote = keys[:, None] // 3 ** np.arange(k) % 3 if len(keys) else np.zeros((0, k), np.int64)
    is_bad, is_good = (vote == 2).astype(float), (vote == 1).astype(float)
    law = np.full((k + 1, k), 0.1)
    law[0] = 0.01
    law[np.arange(1, k + 1), np.arange(k)] = 0.9
    share = np.append(0.8, np.full(k, 0.2 / k))
    post = np.zeros((len(keys), k + 1))
    for _ in range(rounds):
        like = is_bad @ np.log(law.T) + is_good @ np.log1p(-law.T) + np.log(share)
        new = np.exp(like - like.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        p = post * weight[:, None]
        share = (p.sum(axis=0) + 1e-3) / (p.sum() + 1e-3 * (k + 1))
        start = np.where(np.eye(k + 1, k, -1, bool), 0.9, 0.01)
        law = np.clip((p.T @ is_bad + start) / (p.T @ (is_bad + is_good) + 1), 1e-6, 1 - 1e-6)
    return dict(zip(keys.tolist(), post[:, 0].tolist())), law, share


def features(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value): binned statistics and length, and shares of trigrams of character shapes."""
    n = len(offsets) - 1
    rows, names, values = [], [], []
    for j, s in enumerate(STATISTICS):
        rows.append(np.arange(n))
        names.append((j + 1) * 1000 + np.searchsorted(_EDGES[s], found[:, j]))
        values.append(np.ones(n))
    rows.append(np.arange(n))
    names.append(50_000 + np.searchsorted([1, 2, 4, 8, 16, 32, 64, 128, 256, 1024], words))
    values.append(np.ones(n))
    many = _SHAPES**3
    counts = np.zeros(n * many)
    for a in range(0, max(0, len(data) - 2), _text.BLOCK):
        shape = _SHAPE[data[a : a + _text.BLOCK + 2]].astype(np.int32)
        text = np.searchsorted(offsets, np.arange(a, a + len(shape)), side="right") - 1
        gram = (shape[:-2] * _SHAPES + shape[1:-1]) * _SHAPES + shape[2:]
        inside = text[:-2] == text[2:]
        counts += np.bincount(text[:-2][inside] * many + gram[inside], minlength=n * many)
    some = np.flatnonzero(counts)
    rows.append(some // many)
    names.append(100_000 + some % many)
    values.append(counts[some] / np.maximum(np.diff(offsets)[some // many] - 2, 1) * 4)
    hashed = (_text.mix(np.concatenate(names).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(rows), hashed, np.concatenate(values)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in _text.slices(batches):
        keys, n = np.unique(pattern(votes(*statistics(*_text.utf8(batch.column(0))))), return_counts=True)
        for k, c in zip(keys.tolist(), n.tolist()):
            counts[k] = counts.get(k, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches):
        data, offsets = _text.utf8(batch.column(0))
        words, found = statistics(data, offsets)
        row, name, value = features(data, offsets, words, found)
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(1, len(words)))
        keys = pattern(votes(words, found))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.split(name[order].astype(np.int32), cut), pa.list_(pa.int32())), pa.array(np.split(value[order].astype(np.float32), cut), pa.list_(pa.float32()))], ["pattern", "names", "values"])


class QualityModel:
    """Posteriors by vote pattern, the labellers' laws, and the hashed linear scorer."""

    def __init__(self, posterior: dict[int, float], law: np.ndarray, good: float, weights: np.ndarray, bias: float):
        self.posterior, self.law, self.good, self.weights, self.bias = posterior, law, good, weights, bias

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, posterior of the labellers, score) of each text."""
        data, offsets = _text.utf8(texts)
        words, found = statistics(data, offsets)
        row, name, value = features(data, offsets, words, found)
        z = np.bincount(row, self.weights[name] * value, minlength=len(words)) + self.bias
        post = np.array([self.posterior.get(k, self.good) for k in pattern(votes(words, found)).tolist()])
        return words, post, _linear.sigmoid(z)


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Vote patterns are counted over all texts; the scorer is fitted on ``sample`` rows at most, drawn at random."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = {r.pattern: r.n for r in texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, law, share = estimate(counts)
    good = float(share[0])
    total = sum(counts.values())
    some = texts if total <= sample else texts.where(F.rand(17) < 0.9 * sample / total)  # fewer than ``sample`` but for odds of e**-60
    got = some.mapInArrow(_sampled, "pattern long, names array<int>, values array<float>").toArrow().slice(0, sample)
    if not got.num_rows:
        return QualityModel(posterior, law, good, np.zeros(1 << BITS), 3.0)
    names, values = got.column("names").combine_chunks(), got.column("values").combine_chunks()
    row = np.repeat(np.arange(got.num_rows), np.diff(names.offsets.to_numpy()))
    target = np.array([posterior[k] for k in got.column("pattern").to_pylist()])
    w, bias = _linear.fit(row, names.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), target, np.ones(len(target)), 1 << BITS, rounds=300)
    return QualityModel(posterior, law, good, w, bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, n_words, posterior, score and keep of every row; with ``carry``, all columns of ``docs`` and keep.

    Null texts count as empty. Labellers don't vote on texts of fewer than eight words, whose label is then the share of
    good texts, so they are kept. Rows are judged one by one: repeated rows repeat, very long texts are read whole, a score of exactly the threshold
    keeps its row, an empty table gives an empty result. With ``carry`` the columns come in a struct ``row``, so that no name clashes.
    """
    ship(docs.sparkSession)
    model = train(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, 1):
            words, post, score = model.score(batch.column(1))
            judged = [pa.array(words), pa.array(post), pa.array(score), pa.array(score >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *judged], ["first", "n_words", "posterior", "score", "keep"])

    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.col(id_col)
    frame = docs.select(first.alias("first"), F.col(text_col).alias("text"))
    kind = frame.schema["first"].dataType.simpleString()
    out = frame.mapInArrow(run, f"first {kind}, n_words long, posterior double, score double, keep boolean")
    return out.withColumnRenamed("first", "row" if carry else "doc_id")


def op8_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's posterior from the labellers, score and verdict."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
