"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions alone.

A seed is a fixed mask over consecutive words; words at its open places don't count. Every place of every document and of every
benchmark item is hashed under each mask, and equal hashes are joined, so a passage with replaced words still
meets its item wherever a mask skips the replacements. Items that are shorter than the masks are met by masks that skip one word of
theirs. Each hit fixes an alignment of item and document. Hits are reduced to distinct alignments, which are written; only then are the words of
documents with hits read again and compared along them: the best stretch (a match counts 1, a mismatch -2) decides.

Documents are hashed where they are read: the benchmark's hashes are sent to them while they are few, which is checked. Beyond that a
bitmap of bounded size takes out most hashes that no item has, and only (row, place, hash) of the others is shuffled; texts never are, but for those
with hits, and then only if the hits are too many to be sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm._store import Scratch

#: Masks by their closed places.
MASKS = ((0, 1, 2, 4, 5, 7, 10), (0, 1, 4, 6, 7, 8, 10), (0, 2, 3, 5, 6, 8, 9))
#: Items of fewer words can't be told from chance and are never matched.
LEAST_WORDS = 5
#: A leak's best stretch scores so much, or half the item's words if that is less.
SCORE = 12
#: Hashes of the benchmark that are sent to every task (24 bytes each).
SENT_HASHES = 2_000_000
#: Alignments that are sent to every task, and bits of the bitmap beyond SENT_HASHES (a million rows of 64).
SENT_HITS, BITS = 500_000, 1 << 26


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; there may be an empty first and last word."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(words of an item that the mask is for, or 0 for all that it fits; open places). A short item has a mask for each word that it skips."""
    return [(0, m) for m in MASKS] + [(n, tuple(i for i in range(n) if i != skip)) for n in short for skip in range(n)]


def _hashes(df: DataFrame, masks: list[tuple[int, tuple[int, ...]]], place: str, items: bool) -> DataFrame:
    """Columns of ``df`` (with an array ``words``) but the words, ``place`` and ``seed``: each mask's hash at each place where it fits.

    A mask for items of some length is hashed once at most in an item, at its start.
    """
    at, n = F.col(place), F.size("words")
    fits = lambda k, m: (at + (m[-1] + 1) <= n) if not (items and k) else (at == 0) & (n == k)
    seeds = [F.when(fits(k, m), F.xxhash64(F.lit(i), *[F.get("words", at + o) for o in m])) for i, (k, m) in enumerate(masks)]
    placed = df.select("*", F.posexplode("words").alias(place, "sq_word")).drop("sq_word")
    return placed.select(*[c for c in df.columns if c != "words"], place, F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _score(words_: Column, item: Column, start: Column) -> Column:
    """(best stretch's score, matching words) of an item along an alignment."""
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("same"))

    def step(s: Column, j: Column) -> Column:
        same = F.get(words_, start + j) == F.get(item, j)
        now = F.greatest(F.lit(0), s["now"] + F.when(same, 1).otherwise(-2))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"), (s["same"] + F.when(same, 1).otherwise(0)).alias("same"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), state, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", score: int = SCORE) -> DataFrame:
    """doc_id, item_id, start (word of the document at the item's first word; may be negative), score, matches, item_words.

    One row for each document and item with a stretch of ``score`` (or half the item's words, if less): the best, the
    first of equals. Null and empty texts match nothing; rows with one id count as one document, null
    ids likewise; items of one id likewise; other columns are ignored. Very long texts are read whole, and a passage is scored once for each
    alignment, however many seeds hit. Items shorter than the masks are sought with one word skipped; those under LEAST_WORDS are left
    out, as they can't be told from chance. An empty table on either side gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.array_remove(words(F.col(item_text_col)), "").alias("words")).where(F.size("words") >= LEAST_WORDS)
    widest = max(m[-1] for m in MASKS) + 1
    masks = _masks(sorted(r.n for r in items.where(F.size("words") < widest).select(F.size("words").alias("n")).distinct().collect()))  # some numbers below 11
    table = scratch.write(_hashes(items, masks, "item_at", True).distinct(), "seeds")
    few = table.count() <= SENT_HASHES
    texts = items.select("item_id", F.col("words").alias("item")).distinct()
    # Rows are told apart by id and text, so that a second reading of the table finds them again.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    hashed = _hashes(rows.select("doc_id", "key", words(F.col("text")).alias("words")), masks, "at", False)
    if not few:
        word, bit = F.expr(f"shiftright(pmod(seed, {BITS}), 6)").alias("w"), F.expr("shiftleft(1L, cast(pmod(seed, 64) as int))")
        held = table.select(word, bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        hashed = hashed.select("*", word).join(F.broadcast(held), "w").where(F.col("b").bitwiseAND(bit) != 0).select("doc_id", "key", "at", "seed")
    hits = hashed.join(F.broadcast(table) if few else table, "seed").select("doc_id", "key", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    hits = scratch.write(hits, "hits").select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "item_id", "start")
    sent = hits.count() <= SENT_HITS
    again = rows.join(F.broadcast(hits) if sent else hits, (F.col("key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))).select("doc_id", words(F.col("text")).alias("words"), "item_id", "start")
    aligned = again.join(F.broadcast(texts) if few else texts, "item_id").withColumn("found", _score(F.col("words"), F.col("item"), F.col("start")))
    enough = F.least(F.lit(score), F.ceil(F.size("item") / 2))
    leaks = aligned.where(F.col("found.best") >= enough).select("doc_id", "item_id", F.struct(F.col("found.best").alias("score"), (-F.col("start")).alias("late"), F.col("found.same").alias("matches"), F.size("item").alias("item_words")).alias("x"))
    best = leaks.groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.late")).alias("start"), F.col("x.score").alias("score"), F.col("x.matches").alias("matches"), F.col("x.item_words").alias("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a passage of ``benchmark``; all columns are kept, as are rows with a null id
    unless a row with a null id leaks."""
    leaks = overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("sq_leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["sq_leak"]), "left_anti")


def op3_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    """The same rule as SQL over strings instead of hashes, for items of at least the masks' width."""
    seeds = ", ".join(f"CASE WHEN p + {m[-1]} <= len(w) THEN '{i}|' || concat_ws('|', {', '.join(f'w[p + {o}]' for o in m)}) END" for i, m in enumerate(MASKS))
    return rf"""
WITH d AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM b),
ds AS (SELECT doc_id, p, unnest([{seeds}]) AS s FROM dp), bs AS (SELECT item_id, p, unnest([{seeds}]) AS s FROM bp),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.p - bs.p AS start FROM ds JOIN bs ON ds.s = bs.s),
a AS (SELECT h.doc_id, h.item_id, h.start, len(b.w) AS n,
  list_transform(range(1, len(b.w) + 1), lambda j: CASE WHEN h.start + j >= 1 AND h.start + j <= len(d.w) AND d.w[h.start + j] = b.w[j] THEN 1 ELSE -2 END) AS x
  FROM h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
f AS (SELECT doc_id, item_id, start, n, len(list_filter(x, lambda y: y = 1)) AS same,
  list_reduce(list_prepend(0, x), lambda s, y: greatest(s // 100000, greatest(0, s % 100000 + y)) * 100000 + greatest(0, s % 100000 + y)) // 100000 AS best FROM a)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(best AS INTEGER) AS score, CAST(same AS INTEGER) AS matches, CAST(n AS INTEGER) AS item_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, start) AS r FROM f WHERE best >= least({SCORE}, ceil(n / 2))) WHERE r = 1
"""


ORACLE = _oracle()
