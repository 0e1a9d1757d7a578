"""Document scores by masked pseudo-likelihood of a bidirectional window network trained in numpy.

Every word of the corpus is counted, so the vocabulary grows with the corpus. The VOCABULARY commonest words are tokens of their own, in
classes of WITHIN words by rank; every other word has one of SHAPES classes by its last bytes. The network sees the tokens up to RADIUS before and
after a place, itself left out: their embeddings, gated by offset, are summed and passed through tanh. From this hidden layer one softmax
gives the place's class and a second one, of the class's own, gives the word within it. Within a class of other words a word has its share of the
class's occurrences. So P(word) = P(class) * P(word | class), which sums to 1 over all words of the corpus, each part is normalised exactly, and no word
costs more than the two short softmaxes.

Every task trains a copy on all of its documents; copies are averaged by their numbers of tokens, in groups of GROUP copies level by level, so
neither the counts nor the training rest on a sample and no task sees all copies. A document's score is the sum of its words' conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm import _text
from strataquill.llm._store import Scratch

VOCABULARY, WITHIN, SHAPES = 8192, 128, 32
TOP = VOCABULARY // WITHIN
CLASSES = TOP + SHAPES
#: Tokens beside the vocabulary: one for each shape, then what stands beyond the ends of a text.
PAD = VOCABULARY + SHAPES
RADIUS, WIDTH = 3, 16
#: Tokens of one step of the optimiser.
STEP = 8192
#: Tokens that are scored at once.
LOOK = 4 * STEP
RATE = 0.02
#: Places whose shares of a layer are held at once: they stay in the processor's cache.
ROWS = 512
#: At most so many words' counts are sent to tasks; the others' are joined.
SHIPPED = 1 << 17
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 19
#: Copies that are averaged at once, and weights in each row.
GROUP, CHUNK = 64, 8192


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash of each word, its shape, its text, number of texts)."""
    data, offsets = _text.utf8(texts)
    hashes, _, ends, text = _text.words(data, offsets)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before = data[np.maximum(ends - 2, 0)] if len(ends) else last
    last, before = _text._LOWER[last].astype(np.int16), _text._LOWER[before].astype(np.int16)
    return hashes.view(np.int64), ((last * 7 + before * 31) % SHAPES).astype(np.int64), text, len(offsets) - 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their counts; a task holds at most HELD of them and one slice's."""

    def summed(parts):
        word, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[2] for p in parts]), minlength=len(word)).astype(np.int64)
        shape = np.zeros(len(word), np.int64)
        shape[at] = np.concatenate([p[1] for p in parts])
        return word, shape, n

    def row(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["word", "shape", "n"])

    held: list = []
    for batch in _text.slices(batches):
        word, shape, _, _ = _hashes(batch.column(0))
        held.append((word, shape, np.ones(len(word), np.int64)))
        if sum(len(p[0]) for p in held) >= HELD:
            held = [summed(held)]
            if len(held[0][0]) >= HELD // 2:
                yield row(held[0])
                held = []
    if held:
        yield row(summed(held))


class Places:
    """Places of words among sorted ones. Hashes spread evenly, so few start with the same 16 bits: a search has only these to look through."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.first = np.searchsorted(words, np.arange(-(1 << 15), 1 << 15) << 48).astype(np.int32)
        self.most = int(np.diff(self.first, append=len(words)).max())

    def find(self, word: np.ndarray) -> np.ndarray:
        """The place of each word that is among ``words``, which must not be empty; of another word, some place."""
        last = len(self.words) - 1
        at = np.minimum(self.first[(word >> 48) + (1 << 15)], last)
        for _ in range(self.most - 1):
            at += self.words[at] < word
            np.minimum(at, last, out=at)
        return at


class Vocabulary:
    """Tokens of words: ``words`` are the own ones' hashes, the commonest first."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shape_counts: np.ndarray):
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        self.counts, self.shape_counts = counts, shape_counts
        self.places = Places(self.sorted)

    def tokens(self, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The token of each word."""
        if not len(self.sorted):
            return (VOCABULARY + shape).astype(np.int16)
        at = self.places.find(word)
        return np.where(self.sorted[at] == word, self.order[at], VOCABULARY + shape).astype(np.int16)


def classes(token: np.ndarray) -> np.ndarray:
    return np.where(token < VOCABULARY, token // WITHIN, TOP + token - VOCABULARY)


def contexts(token: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Tokens at each offset within RADIUS, by row; PAD stands beyond the ends of a text."""
    n = len(token)
    out = np.full((2 * RADIUS, n), PAD, np.int16)
    for k, o in enumerate(o for o in range(-RADIUS, RADIUS + 1) if o):
        a, b = max(0, -o), n - max(0, o)
        if a < b:
            same = text[a:b] == text[a + o : b + o]
            out[k, a:b] = np.where(same, token[a + o : b + o], PAD)
    return out


def _wide(layers: np.ndarray) -> np.ndarray:
    """Whether exponentials of h @ layer could overflow, for each layer: entries of h are 1 at most."""
    return np.abs(layers).sum(axis=-2).max(axis=-1) > 80


def _groups(parts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """``parts`` (layer, first row, end) in a row, cut so that each group has ROWS rows at most."""
    group: list = []
    for c, at, end in parts:
        while at < end:
            stop = min(end, (group[0][1] if group else at) + ROWS)
            group.append((c, at, stop))
            at = stop
            if stop - group[0][1] == ROWS:
                yield group
                group = []
    if group:
        yield group


def _exponentials(h: np.ndarray, layers: np.ndarray, parts: list[tuple[int, int, int]], own: np.ndarray):
    """For each group of ``parts``: (its parts, counted from its first row; its rows; their exponentials of h @ layer; these' sums; the logarithm of each row's chosen one).

    All are written to one place in memory. Where a layer is wide, a row's largest value is taken off first.
    """
    wide, width = _wide(layers), layers.shape[2]
    room, ones, each = np.empty((min(ROWS, len(h)), width), np.float32), np.ones(width, np.float32), np.arange(ROWS)
    for group in _groups(parts):
        first, end = group[0][1], group[-1][2]
        group = [(c, slice(a - first, b - first)) for c, a, b in group]
        rows, z = h[first:end], room[: end - first]
        for c, at in group:
            np.matmul(rows[at], layers[c], out=z[at])
            if wide[c]:
                z[at] -= z[at].max(axis=1, keepdims=True)
        chosen = z[each[: end - first], own[first:end]]
        np.exp(z, out=z)
        yield group, slice(first, end), z, z @ ones, chosen


def _slopes(h: np.ndarray, layers: np.ndarray, parts: list[tuple[int, int, int]], own: np.ndarray, whole: float, grad: np.ndarray) -> np.ndarray:
    """The slopes of ``whole`` times the sum of -log(chosen share of each row's softmax) by h less its last column; those by layers are added to ``grad``."""
    back, heads, each = np.empty((len(h), WIDTH), np.float32), layers[:, :WIDTH].transpose(0, 2, 1), np.arange(ROWS)
    for group, rows, e, total, _ in _exponentials(h, layers, parts, own):
        e[each[: len(e)], own[rows]] -= total
        scale = (np.float32(whole) / total)[:, None]  # of the short rows, not of all shares
        short, out = h[rows] * scale, back[rows]
        for c, at in group:
            grad[c] += (e[at].T @ short[at]).T
            np.matmul(e[at], heads[c], out=out[at])
        out *= scale
    return back


def _log_share(h: np.ndarray, layers: np.ndarray, parts: list[tuple[int, int, int]], own: np.ndarray) -> np.ndarray:
    """Logarithm of one chosen share of each row's softmax."""
    out = np.empty(len(h), np.float32)
    for _, rows, _, total, chosen in _exponentials(h, layers, parts, own):
        np.subtract(chosen, np.log(total), out=out[rows])
    return out


class Window:
    """The network. ``weights`` is one flat array, of which the layers are views; the last row of ``out`` and of each class in ``word`` is its bias."""

    LAYERS = {"embed": (PAD + 1, WIDTH), "gate": (2 * RADIUS, WIDTH), "bias": (WIDTH,), "out": (WIDTH + 1, CLASSES), "word": (TOP, WIDTH + 1, WITHIN)}
    SIZE = sum(int(np.prod(s)) for s in LAYERS.values())

    def __init__(self, weights: np.ndarray | None = None, vocabulary: Vocabulary | None = None, seed: int = 1):
        if weights is None:
            weights = np.random.default_rng(seed).normal(0, 0.1, self.SIZE)
        self.weights = weights.astype(np.float32)
        self.__dict__ |= self.views(self.weights)
        self.prior, self.share = self.out[WIDTH], self.word[:, WIDTH]
        if vocabulary is not None:
            self.gate[:], self.bias[:] = 1 / RADIUS, 0
            counts = np.zeros(VOCABULARY)
            counts[: len(vocabulary.counts)] = vocabulary.counts
            mass = np.concatenate([counts.reshape(TOP, WITHIN).sum(axis=1), vocabulary.shape_counts])
            self.prior[:] = np.log((mass + 1) / (mass + 1).sum())
            share = counts.reshape(TOP, WITHIN) + 1e-3
            self.share[:] = np.log(share / share.sum(axis=1, keepdims=True))
        self.moments = [np.zeros_like(self.weights), np.zeros_like(self.weights)]
        self.steps = 0

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.LAYERS.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def around(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, np.ndarray]]]:
        """Tokens of the places and of RADIUS places on both sides; their embeddings, by column; for each offset, where its tokens stand
        among these and the places from which it leads beyond the ends of the text.

        ``context`` is what contexts() gives for ``token``, or a run of its columns: each offset's tokens are the places' own, moved, or PAD.
        """
        n = len(token)
        ids = np.concatenate([context[:RADIUS, 0], token, context[RADIUS:, -1]]).astype(np.int64)
        moved = [o + RADIUS for o in range(-RADIUS, RADIUS + 1) if o]
        return ids, np.ascontiguousarray(self.embed[ids].T), [(slice(o, o + n), np.flatnonzero(row == PAD)) for o, row in zip(moved, context)]

    def hidden(self, seen: np.ndarray, offsets: list[tuple[slice, np.ndarray]]) -> np.ndarray:
        """The hidden layer of each place, and a 1 behind it, by column."""
        n = offsets[0][0].stop - offsets[0][0].start
        out = np.ones((WIDTH + 1, n), np.float32)
        h, part = out[:WIDTH], np.empty((WIDTH, n), np.float32)
        h[:] = self.bias[:, None]
        for (at, ends), gate in zip(offsets, self.gate):
            np.multiply(seen[:, at], gate[:, None], out=part)
            part[:, ends] = (self.embed[PAD] * gate)[:, None]
            h += part
        np.tanh(h, out=h)
        return out

    @staticmethod
    def by_class(token: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The places with words of the vocabulary, sorted by class, and (class, its first among them, end) of each class."""
        kind = classes(token).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        order = order[: np.searchsorted(kind[order], TOP)]
        kind = kind[order]
        at = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(order)]
        return order, [(int(kind[a]), a, b) for a, b in zip(at, at[1:]) if a < b]

    def log_prob(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each token; of another word than the vocabulary's, of its class."""
        _, seen, offsets = self.around(context, token)
        h = np.ascontiguousarray(self.hidden(seen, offsets).T)
        out = _log_share(h, self.out[None], [(0, 0, len(h))], classes(token)).astype(np.float64)
        order, parts = self.by_class(token)
        out[order] += _log_share(h[order], self.word, parts, token[order] % WITHIN)
        return out

    def train(self, context: np.ndarray, token: np.ndarray) -> None:
        """One Adam step on the mean loss."""
        n = len(token)
        grad = np.zeros_like(self.weights)
        g = self.views(grad)
        ids, seen, offsets = self.around(context, token)
        columns = self.hidden(seen, offsets)
        h = np.ascontiguousarray(columns.T)
        back = _slopes(h, self.out[None], [(0, 0, n)], classes(token), 1 / n, g["out"][None])
        order, parts = self.by_class(token)
        back[order] += _slopes(h[order], self.word, parts, token[order] % WITHIN, 1 / n, g["word"])
        back = np.ascontiguousarray(back.T)
        back *= 1 - columns[:WIDTH] * columns[:WIDTH]
        back.sum(axis=1, out=g["bias"])
        sums, beyond, part = np.zeros_like(seen), np.zeros(WIDTH, np.float32), np.empty_like(back)
        for k, (at, ends) in enumerate(offsets):
            lost = back[:, ends].sum(axis=1)
            part[:] = back
            part[:, ends] = 0
            g["gate"][k] = np.einsum("ij,ij->i", part, seen[:, at]) + lost * self.embed[PAD]
            part *= self.gate[k][:, None]
            sums[:, at] += part
            beyond += lost * self.gate[k]
        for i, column in enumerate(sums):
            g["embed"][:, i] = np.bincount(ids, column, minlength=PAD + 1)
        g["embed"][PAD] += beyond
        self.steps += 1
        m1, m2 = self.moments
        rate = np.float32(RATE / (1 + self.steps / 1600) / (1 - 0.9**self.steps))
        part = grad - m1  # one array for all that follows
        part *= np.float32(0.1)
        m1 += part
        grad *= grad
        np.subtract(grad, m2, out=part)
        part *= np.float32(0.01)
        m2 += part
        np.multiply(m2, np.float32(1 / (1 - 0.99**self.steps)), out=part)
        np.sqrt(part, out=part)
        part += np.float32(1e-6)
        np.multiply(m1, rate, out=grad)
        grad /= part
        self.weights -= grad


def _learn(vocabulary: Vocabulary, start: np.ndarray):
    """Rows (copy, chunk, weights, tokens) of the copy that a task has trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, wait = Window(start), 0, []

        def learn(least: int) -> None:
            nonlocal wait
            while wait and (n := sum(len(t) for _, t in wait)) >= least and n:
                context, token = np.concatenate([c for c, _ in wait], axis=1), np.concatenate([t for _, t in wait])
                for at in range(0, len(token) - least + 1 if least > 1 else len(token), STEP):
                    net.train(context[:, at : at + STEP], token[at : at + STEP])
                rest = len(token) // STEP * STEP if least > 1 else len(token)
                wait = [(context[:, rest:], token[rest:])] if rest < len(token) else []

        for batch in _text.slices(batches):
            word, shape, text, _ = _hashes(batch.column(0))
            token = vocabulary.tokens(word, shape)
            wait.append((contexts(token, text), token))
            seen += len(token)
            learn(STEP)
        learn(1)
        if seen:
            flat = net.weights
            parts = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
            n, copy = len(parts), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([copy] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary()), pa.array([float(seen)] * n)], ["copy", "chunk", "weights", "tokens"])

    return run


_COPIES = "copy long, chunk int, weights binary, tokens double"


def _mean(table: pa.Table) -> pa.Table:
    """One row for the copies of one group and chunk: their mean by tokens."""
    tokens = table.column("tokens").to_numpy()
    rows = np.stack([np.frombuffer(w, np.float32) for w in table.column("weights").to_pylist()]).astype(np.float64)
    mean = (rows * (tokens / tokens.sum())[:, None]).sum(axis=0).astype(np.float32)
    return pa.table({"copy": table.column("copy").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "weights": pa.array([mean.tobytes()], pa.binary()), "tokens": pa.array([float(tokens.sum())])})


def averaged(copies: DataFrame, scratch: Scratch, name: str) -> np.ndarray | None:
    """The mean of all copies (copy, chunk, weights, tokens), GROUP of them at a time."""
    level = 0
    while True:
        copies = scratch.write(copies, f"{name}-{level}")
        most = copies.agg(F.max("copy")).first()[0]
        if most is None:
            return None
        if level and most == 0:
            break
        copies = copies.withColumn("copy", F.expr(f"copy div {GROUP}")).groupBy("copy", "chunk").applyInArrow(_mean, _COPIES)
        level += 1
    rows = copies.orderBy("chunk").select("weights").toArrow()  # one copy of the network
    return np.concatenate([np.frombuffer(w, np.float32) for w in rows.column(0).to_pylist()])


def count_words(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """(word, shape, n): every distinct word's hash, shape and number of occurrences, over all texts."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_words, "word long, shape int, n long")
    return scratch.write(counted.groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "words")


def vocabulary(words: DataFrame) -> Vocabulary:
    """The commonest words (ties: the smaller hash), their counts, and the others' counts by shape."""
    top = words.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    own, n, shape = (top.column(c).to_numpy() for c in ("word", "n", "shape"))
    total = np.zeros(SHAPES)
    for r in words.groupBy("shape").agg(F.sum("n").alias("n")).collect():  # SHAPES rows at most
        total[r.shape] = r.n
    return Vocabulary(own, n, total - np.bincount(shape, n, minlength=SHAPES))


def train(docs: DataFrame, vocab: Vocabulary, scratch: Scratch, text_col: str = "text", rounds: int = 1) -> np.ndarray:
    """The averaged network's weights, from every document in each round."""
    texts = docs.select(F.col(text_col).alias("text"))
    weights = Window(vocabulary=vocab).weights
    for i in range(rounds):
        found = averaged(texts.mapInArrow(_learn(vocab, weights), _COPIES), scratch, f"copies-{i}")
        weights = weights if found is None else found
    return weights


def _score(vocab: Vocabulary, weights: np.ndarray, known: np.ndarray, known_log: np.ndarray):
    """Sums without the log counts of words that are not ``known``; these words are listed."""
    mass, places = np.log(np.maximum(vocab.shape_counts, 1)), Places(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Window(weights)
        for batch in _text.slices(batches, 1):
            word, shape, text, n = _hashes(batch.column(1))
            token = vocab.tokens(word, shape)
            context = contexts(token, text)
            total = np.zeros(n)
            for at in range(0, len(token), LOOK):
                total += np.bincount(text[at : at + LOOK], net.log_prob(context[:, at : at + LOOK], token[at : at + LOOK]), minlength=n)
            other = np.flatnonzero(token >= VOCABULARY)
            word, shape, where = word[other], shape[other], text[other]
            place = places.find(word) if len(known) else np.zeros(len(word), np.int64)
            held = known[place] == word if len(known) else np.zeros(len(word), bool)
            total += np.bincount(where[held], known_log[place[held]], minlength=n) - np.bincount(where, mass[shape], minlength=n)
            offsets = np.searchsorted(where[~held], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(word[~held]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(text, minlength=n)), pa.array(total), batch.column(2), rare], ["doc_id", "n_tokens", "sum", "rid", "rare"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, like: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum of its words' conditional log-probabilities) and mean_log_prob of every row.

    The network and the counts come from ``like`` (default: the documents themselves); a word that ``like`` lacks counts as one that it has once.
    Null texts count as empty; texts without words have likelihood 0 and a null mean. Very long texts are read whole, one at a time. Repeated rows
    repeat; ties in word counts go to the smaller hash; an empty table gives an empty result; other columns are ignored. The scores hang on how the
    table is cut into partitions as far as the averaged copies do.
    """
    scratch = Scratch(docs.sparkSession, "lm-score")
    base = docs if like is None else like
    words = count_words(base, scratch, text_col)
    vocab = vocabulary(words)
    weights = train(base, vocab, scratch, text_col, rounds)
    least, held = None, 0
    for r in sorted(words.groupBy("n").count().collect(), key=lambda r: -r.n):
        held += r["count"]
        if held > SHIPPED:
            break
        least = r.n
    most = words.where(F.col("n") >= least).select("word", "n").toArrow() if least else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    known, counts = most.column("word").to_numpy(), most.column("n").to_numpy()
    order = np.argsort(known)
    known, known_log = known[order], np.log(counts[order].astype(float))
    numbered = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("rid"))
    scored = numbered.mapInArrow(_score(vocab, weights, known, known_log), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, sum double, rid long, rare array<long>")
    scored = scratch.write(scored, "scored")
    rare = scored.select("rid", F.explode("rare").alias("word")).join(words, "word").groupBy("rid").agg(F.sum(F.log("n")).alias("more"))
    scored = scored.join(rare, "rid", "left").select("doc_id", "n_tokens", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op7_masked_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood under a network trained on all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
