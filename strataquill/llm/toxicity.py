"""Toxicity scores by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The value of a feature is the number of distinct words of the text that hold the n-gram. Class counts of all
labelled training rows give each n-gram its log-count ratio, smoothed towards no difference; a logistic regression over values
times ratios is fitted on a bounded sample of them and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm import _linear, _text
from strataquill.shipping import ship

SIZES = (3, 4, 5)
BITS = 18
#: At most so many training rows of each class are in the regression's sample.
SAMPLE = 3000
#: Pseudo-count of the log-count ratios, dealt to the classes as all n-grams are.
SMOOTH = 20.0
#: Ratios nearer to zero count as zero.
LEAST = 0.3
#: Labels are sent to every task up to so many rows (16 bytes each).
SENT_LABELS = 1_000_000


class _Batch:
    """Distinct words of a batch of texts and which text holds which."""

    def __init__(self, texts: pa.Array):
        data, offsets = _text.utf8(texts)
        hashes, starts, ends, text = _text.words(data, offsets)
        self.texts = len(offsets) - 1
        _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = len(at)
        pairs = np.unique(text * max(1, self.words) + back.ravel())
        self.text, self.word = pairs // max(1, self.words), pairs % max(1, self.words)
        self.owner, self.gram = _text.word_ngrams(data, starts[at], ends[at], SIZES, BITS) if self.words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, clean, toxic): counts over the task's rows of (text, label)."""
    counts = np.zeros((2, 1 << BITS))
    for batch in _text.slices(batches):
        b, label = _Batch(batch.column(0)), batch.column(1).to_numpy()
        for c in (0, 1):
            per_word = np.bincount(b.word[label[b.text] == c], minlength=b.words)
            counts[c] += np.bincount(b.gram, per_word[b.owner] if b.words else None, minlength=1 << BITS)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0, some]), pa.array(counts[1, some])], ["gram", "clean", "toxic"])


def _features(ratio: np.ndarray):
    """(label, grams, values) of each row of (text, label), for n-grams with a ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            b = _Batch(batch.column(0))
            keep = ratio[b.gram] != 0
            owner, gram = b.owner[keep], b.gram[keep]
            order = np.argsort(owner, kind="stable")
            owner, gram = owner[order], gram[order]
            first = np.searchsorted(owner, np.arange(b.words + 1))
            grams, values = [], []
            cut = np.searchsorted(b.text, np.arange(b.texts + 1))
            for t in range(b.texts):
                own = b.word[cut[t] : cut[t + 1]]
                found = np.concatenate([gram[first[w] : first[w + 1]] for w in own.tolist()] or [np.zeros(0, np.int64)])
                g, n = np.unique(found, return_counts=True)
                grams.append(g.astype(np.int32))
                values.append(n.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(grams, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["label", "grams", "values"])

    return run


class ToxicityModel:
    """Weights by n-gram, bias; pickles to about a megabyte."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, texts: pa.Array) -> np.ndarray:
        b = _Batch(texts)
        if not b.words:
            return np.full(b.texts, _linear.sigmoid(np.array(self.bias)))
        per_word = np.bincount(b.owner, self.weights[b.gram], minlength=b.words)
        return _linear.sigmoid(np.bincount(b.text, per_word[b.word], minlength=b.texts) + self.bias)


def train(labelled: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from rows of (text, label 0 or 1). Counts take in every row; the regression's sample is bounded.

    The sample is drawn at random from each class and weighted back to the classes' shares.
    """
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    found = rows.mapInArrow(_count, "gram int, clean double, toxic double").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # 2**BITS rows at most
    counts = np.zeros((2, 1 << BITS))
    counts[:, found.column("gram").to_numpy()] = found.column("clean").to_numpy(), found.column("toxic").to_numpy()
    share = (counts.sum(axis=1) + 1) / (counts.sum() + 2)
    ratio = np.log((counts[1] + SMOOTH * share[1]) / (counts[0] + SMOOTH * share[0])) - np.log(share[1] / share[0])
    ratio[np.abs(ratio) < LEAST] = 0
    # Each class is thinned at random where its rows are; what is left is fewer than ``sample`` but for odds of e**-15.
    share_of = {c: 1.0 if n <= sample else 0.9 * sample / n for c, n in sizes.items()}
    some = rows.withColumn("u", F.rand(23)).where(F.col("u") < F.when(F.col("label") == 1, share_of.get(1, 1.0)).otherwise(share_of.get(0, 1.0))).select("text", "label")
    got = some.mapInArrow(_features(ratio), "label int, grams array<int>, values array<float>").toArrow()
    row, column, value, target = [], [], [], []
    left = dict.fromkeys(sizes, sample)
    for label, g, v in zip(got.column("label").to_pylist(), got.column("grams").to_pylist(), got.column("values").to_pylist()):
        left[label] -= 1
        if left[label] >= 0:
            row.append(np.full(len(g), len(target)))
            column.append(np.array(g, np.int64))
            value.append(np.array(v))
            target.append(label)
    each = [sizes.get(c, 0) / max(1, target.count(c)) for c in (0, 1)]
    weight = [each[c] for c in target]
    if not target:
        return ToxicityModel(np.zeros(1 << BITS), 0.0)
    column = np.concatenate(column)
    w, bias = _linear.fit(np.concatenate(row), column, np.concatenate(value) * ratio[column], np.array(target, float), np.array(weight), 1 << BITS)
    return ToxicityModel(w * ratio, bias)


def score_toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row of ``docs`` by a model trained on ``labelled`` (text, label).

    Null texts count as empty and, like texts of white space, get the score of a text without features. Without labelled rows
    every score is one half; with one class only, near that class. Rows are scored one by one: repeated rows
    repeat, very long texts are read whole, a score of exactly one half counts as toxic, an empty table gives an empty result, other columns are ignored.
    """
    ship(docs.sparkSession)
    model = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, 1):
            score = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op10_nb_scaled_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model that learns from labels outside one fifth of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic in (0, 1)").where(remainder(F.col("doc_id")) != 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    if labels.count() <= SENT_LABELS:
        labels = F.broadcast(labels)
    labelled = docs.join(labels, "doc_id").select("text", "label")
    scored = score_toxicity(docs, labelled)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
