"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily, the longest piece that fits first. Then its smallest piece is replaced by two pieces
not packed yet, if some two together are longer than it and fit the gap that its removal leaves; of all such
pairs the one that leaves least is taken.

Documents are tokenised in Arrow batches, pieces are dealt by hash to groups of about ``group_size`` pieces, and
each group is packed alone, so memory is bounded and a group loses at most its last bin to the division.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm import _text
from strataquill.llm._store import Scratch
from strataquill.shipping import ship

CAPACITY = 4096
END_ID = 1
CACHE = 700_000
#: Control characters that Python's split() takes as white space but the tokenizer does not, and wide spaces.
_ODD = re.compile("[\x1c-\x1f]")


#: Letters and numbers below U+0250 as Unicode classes them; texts with characters beyond go to the tokenizer itself.
_L = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_N = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+|\n")
_BEYOND = re.compile("[^\x00-\u024f]|<\\|")


class WordEncoder:
    """From texts to their ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The vocabulary's pre-tokenizer never joins characters across white space, so the ids of a text are those of its
    words one after another. Words' ids are kept in a cache of bounded size, which is emptied when full. A new
    word's parts are found here and encoded together by the model alone; what holds characters beyond U+024F or
    might hold a special token is left to the whole tokenizer.
    """

    def __init__(self, path: str, cache_size: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        self.plain = data["normalizer"] is not None and data["model"].get("end_of_word_suffix") == "</w>" and "'s|'t|'re" in json.dumps(data["pre_tokenizer"])
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        data |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.model = Tokenizer.from_str(json.dumps(data))
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytes = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable) if b != 10}
        self.cache_size = cache_size
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_parts(self, new: list[str]) -> bool:
        """Ids of lower-case pre-tokens, all in one call; each ends with its only token that closes a word."""
        text = "\n".join(new)
        if not (text.isascii() and text.replace("\n", "").isprintable()):
            text = text.encode().decode("latin-1").translate(self.bytes)
        ids = np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
        if len(ends) != len(new):
            return False
        data, ends = ids.tobytes(), ends.tolist()
        self.parts.update(zip(new, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        return True

    def learn(self, new: list[str]) -> None:
        odd = [w for w in new if _BEYOND.search(w)] if self.plain and _BEYOND.search("\n".join(new)) else [] if self.plain else new
        for w in odd:
            self.known[w] = self.whole(w)
        if odd:
            gone = set(odd)
            new = [w for w in new if w not in gone]
        if not new:
            return
        found = _PRETOKEN.findall(unicodedata.normalize("NFC", "\n".join(new)).lower())
        unknown = list(itertools.filterfalse(self.parts.__contains__, set(found) - {"\n"}))
        plain = [w for w in unknown if w.isascii()]
        wide = [w for w in unknown if not w.isascii()]
        if (plain and not self.learn_parts(plain)) or (wide and not self.learn_parts(wide)):
            self.known.update((w, self.whole(w)) for w in new)
            return
        self.parts["\n"] = b"\xff\xff\xff\xff"  # no id
        ids = b"".join(map(self.parts.__getitem__, found))
        ends = np.flatnonzero(np.frombuffer(ids, "<u4") == 0xFFFFFFFF) * 4
        ends = [*ends.tolist(), len(ids)]
        self.known.update(zip(new, map(ids.__getitem__, map(slice, [0, *(e + 4 for e in ends[:-1])], ends))))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.split() if not _ODD.search(t) else None for t in texts]
        if len(self.known) > self.cache_size:
            self.known.clear()
        if len(self.parts) > self.cache_size:
            self.parts.clear()
        distinct = set(itertools.chain.from_iterable(s for s in split if s))
        self.learn(list(itertools.filterfalse(self.known.__contains__, distinct)))  # a set minus a view would visit the whole cache
        get = self.known.__getitem__
        return [b"".join(map(get, s)) if s is not None else self.whole(t) for s, t in zip(split, texts)]


_ENCODERS: dict[str, WordEncoder] = {}
_text.HELD.append(_ENCODERS.clear)


def word_encoder(path: str) -> WordEncoder:
    """The process's encoder for a vocabulary file; its caches serve all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of every document.

    A document is its ids and then ``end_id``. Only documents longer than ``capacity`` are cut. A null text counts as
    empty and gives one piece of length 1; rows are never merged, so repeated rows give repeated pieces.
    """
    ship(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        for batch in _text.slices(batches, 1, own=_ENCODERS.clear):
            took, nos, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, blob in enumerate(encode(batch.column(1).fill_null("").to_pylist())):
                blob += end
                for no, start in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[start : start + 4 * capacity]
                    took.append(row)
                    nos.append(no)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(took, pa.int64())), pa.array(nos, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each length; every length lies between 1 and capacity."""
    order = np.argsort(lengths, kind="stable")
    by_length = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate([[0], np.cumsum(by_length)])[:-1].tolist()
    count = by_length.tolist()
    free = by_length > 0
    mask = 0
    for x in np.flatnonzero(free).tolist():
        mask |= 1 << x
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    every = np.arange(capacity + 1)

    def take(x: int) -> int:
        nonlocal mask
        count[x] -= 1
        if not count[x]:
            mask &= ~(1 << x)
            free[x] = False
        return order[first[x] + count[x]]

    def largest(room: int) -> int:
        return max(0, (mask & ((1 << (room + 1)) - 1)).bit_length() - 1)

    no = 0
    while mask:
        held, gap = [], capacity
        while gap and (x := largest(gap)):
            held.append((x, take(x)))
            gap -= x
        small = held[-1][0]
        if gap and mask and (room := gap + small) > small:
            some = np.where(free[: room], every[: room], 0)
            floor = np.maximum.accumulate(some)
            a = np.flatnonzero(some)
            if len(a):
                b = floor[np.minimum(room - a, a)]
                b = np.where((b == a) & (np.array([count[x] < 2 for x in a.tolist()])), floor[np.maximum(a - 1, 0)], b)
                total = np.where(b > 0, a + b, 0)
                best = int(total.argmax())
                if total[best] > small:
                    x, y = int(a[best]), int(b[best])
                    pair = [(x, take(x)), (y, take(y))]
                    _, back = held.pop()
                    order[first[small] + count[small]] = back
                    count[small] += 1
                    mask |= 1 << small
                    free[small] = True
                    held += pair
        at = 0
        for x, i in held:
            bins[i], offsets[i] = no, at
            at += x
        no += 1
    return bins, offsets


def pack(found: DataFrame, capacity: int = CAPACITY, group_size: int = 16384) -> DataFrame:
    """``found`` (a written table of pieces with a column length) with sequence_id and offset.

    Sequences are numbered by group; numbers are not dense. An empty table gives an empty result.
    """
    groups = max(1, -(-found.count() // group_size))
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        table = table.drop_columns(["sq_group"])
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return found.withColumn("sq_group", spread).groupBy("sq_group").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_size: int = 16384) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Pieces' manifests are written once (a few dozen bytes each) and then packed; ``sequences`` joins ids to them.
    Null and empty texts are one end token; null or repeated ids are kept row by row; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    found = scratch.write(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(found, capacity, group_size)


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and ids (binary), from pack's result and pieces(with_ids=True), by document and piece (ids of documents must be unique)."""
    rows = packed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.aggregate(ordered, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
