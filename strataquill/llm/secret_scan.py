"""Secret findings with a random forest against false positives, in DataFrame expressions alone.

Candidates are runs of key characters with a digit or mixed case in the words of a text. Each is described by its length, its shares of
character classes, the transitions between them, how likely its letter pairs are in words, how much of it a small dictionary
covers, whether its path looks like a test's or an example's, and by the words before and after it. A random forest,
trained on labelled findings, scores it. The forest is grown on the driver from a fixed number of labelled findings and becomes one
SQL expression of nested conditions.
"""

from __future__ import annotations

import random
import string
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shortest run of characters that can be a secret.
LEAST = 16
KEY_CHARACTERS = r"[A-Za-z0-9_+/=\-]"
TREES, LEVELS, FINDINGS = 15, 5, 3000
DICTIONARY = "example|sample|test|dummy|secret|password|passwd|token|access|private|public|config|default|server|client|service|user|admin|value|name|index|module|version|release|build|master|main|commit|branch|image|file|path|http|https|www|com|org|data|base|local|host|request|response|handler|manager|factory|controller|your|change|here|xxxx|0000|1234|abcd"
#: Letter pairs that are common in words.
PAIRS = "th|he|in|er|an|re|nd|on|en|at|ou|ed|ha|to|or|it|is|hi|es|ng|st|ti|io|le|se|nt|me|de|te|co|ne|ar|al|ve|ra|el|la|li|ic|ie|ch|ei|qu|ua|ui|un|ur|us|ut|et|ec"
ASKS = r"key|token|secret|passw|pwd|auth|credential|bearer|api|private"
DENIES = r"commit|sha|md5|checksum|digest|hash|uuid|guid|etag|revision|id|example|sample|test|tracking|order|version|card|account"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: int = LEAST, plain: bool = False) -> DataFrame:
    """doc_id, word (its number), finding, before (two words), after (one word), path of every candidate run."""
    run = rf"{KEY_CHARACTERS}{{{least},}}"
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    split = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+").alias("words"))
    each = split.select("doc_id", "path", "words", F.posexplode("words").alias("word", "w")).where((F.length("w") >= least) & F.col("w").rlike(run))
    near = F.concat_ws(" ", F.get("words", F.col("word") - 2), F.get("words", F.col("word") - 1))
    # What stands before the run in its own word (as in key="...") belongs to the words before it.
    found = each.select("doc_id", "path", "word", "w", near.alias("near"), F.coalesce(F.get("words", F.col("word") + 1), F.lit("")).alias("after"), F.explode(F.regexp_extract_all("w", F.lit(f"({run})"), F.lit(1))).alias("finding"))
    own = F.expr("substring_index(w, finding, 1)")
    mixed = F.col("finding").rlike("[0-9]") | (F.col("finding").rlike("[a-z]") & F.col("finding").rlike("[A-Z]{2}"))
    return (found if plain else found.where(mixed)).select("doc_id", "word", "finding", F.concat_ws(" ", "near", own).alias("before"), "after", "path")


def features() -> list[tuple[str, Column]]:
    """(name, expression over candidates' columns), all of them numbers."""
    c, low = F.col("finding"), F.lower("finding")
    n = F.length(c).cast("double")

    def left(pattern: str, of: Column = c) -> Column:
        """Share of characters outside the pattern's matches."""
        return F.length(F.regexp_replace(of, pattern, "")) / n

    def changes(a: str, b: str) -> Column:
        return F.regexp_count(c, F.lit(f"(?<=[{a}])[{b}]")) / n

    around = F.lower("before")
    return [
        ("length", n),
        ("digits", 1 - left("[0-9]")),
        ("upper", 1 - left("[A-Z]")),
        ("lower", 1 - left("[a-z]")),
        ("marks", left("[A-Za-z0-9]")),
        ("hex", (~c.rlike("[^0-9a-fA-F]")).cast("double")),
        ("letter_digit", changes("A-Za-z", "0-9") + changes("0-9", "A-Za-z")),
        ("case_changes", changes("a-z", "A-Z") + changes("A-Z", "a-z")),
        ("pairs", F.regexp_count(low, F.lit(f"(?=({PAIRS}))")) / n),
        ("dictionary", 1 - left(f"({DICTIONARY})", low)),
        ("repeats", F.regexp_count(c, F.lit(r"(.)\1")) / n),
        ("dashed", (c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")).cast("double")),
        ("slashes", F.regexp_count(c, F.lit("/")).cast("double")),
        ("asked", around.rlike(ASKS).cast("double")),
        ("denied", around.rlike(rf"(^|[^a-z])({DENIES})([^a-z]|$)").cast("double")),
        ("assigned", F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double")),
        ("denied_after", F.lower("after").rlike(rf"(^|[^a-z])({DENIES})([^a-z]|$)").cast("double")),
        ("test_path", F.lower("path").rlike("test|example|sample|doc|fixture|mock|spec").cast("double")),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(finding, before, after, path, label) by rule: keys of common forms where keys are assigned, and what is mistaken for them.

    Corpora with reviewed findings of their own can pass those instead.
    """
    rng = random.Random(seed)
    b62 = string.ascii_letters + string.digits
    syllables = ["the", "in", "er", "an", "re", "nd", "on", "en", "at", "ou", "ed", "ha", "to", "or", "it", "is", "tion", "ment", "able", "ing", "ly", "ch", "eau", "que"]

    def some(alphabet: str, size: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(size))

    def word(k: int = 3) -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, k)))

    def hexes() -> str:
        h = some("0123456789abcdef", rng.choice([32, 40, 48, 64]))
        return h.upper() if rng.random() < 0.15 else h

    secrets: list[Callable[[], str]] = [hexes, hexes, lambda: some(b62, rng.randint(20, 64)), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(b62, 36), lambda: "sk-" + some(b62, 48), lambda: some(b62 + "+/", rng.choice([40, 43, 86])) + "=", lambda: "xoxb-" + some(string.digits, 12) + "-" + some(b62, 24)]
    falses: list[Callable[[], str]] = [lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: some(string.digits, rng.randint(16, 20)), lambda: some("0123456789abcdef", rng.choice([32, 40, 64])), lambda: word(4).capitalize() + word(4).capitalize() + word(4).capitalize() + "2", lambda: "/".join(word(2) for _ in range(5)) + str(rng.randint(0, 99)), lambda: "-".join(word(2) for _ in range(4)) + "-" + str(rng.randint(1, 30)), lambda: rng.choice(["x", "0", "A1", "ab12"]) * 12, lambda: "YOUR_" + rng.choice(["API_KEY", "TOKEN", "SECRET"]) + "_HERE_123", lambda: word(3) + "_" + word(3) + "_" + word(3) + str(rng.randint(0, 999)), lambda: "EXAMPLE" + some(string.ascii_uppercase, 3) + "KEY" + "0" * 8]
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "API-KEY", "TOKEN", "private_key", "Bearer"]
    others = ["commit", "sha256", "md5", "checksum", "uuid", "id", "revision", "digest", "order", "etag", "card"]
    out = []
    for i in range(n):
        label = i % 2
        finding = rng.choice(secrets if label else falses)()
        sign = rng.choice([" = ", "=", ": ", " = \"", "=\"", ": '"])
        r = rng.random()
        if label:
            lead = rng.choice(names) + sign if r < 0.9 else word() + " " + word() + " "
        elif set(finding) <= set("0123456789abcdef") and len(finding) in (32, 40, 64):
            lead = rng.choice(others) + rng.choice([" ", ": ", "="]) if r < 0.7 else word() + " " + word() + " "
        else:
            lead = rng.choice(names) + sign if r < 0.3 else rng.choice(others) + sign if r < 0.5 else word() + " " + word() + " "
        path = rng.choice(["test/data", "docs/example", "spec"]) if rng.random() < (0.05 if label else 0.25) else rng.choice(["src", "app/main", "web", ""])
        out.append((finding, word() + " " + lead, word(), path, label))
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, seed: int = 3) -> list:
    """A random forest: each tree on a bootstrap sample, each split the best by Gini impurity over a third of the features.

    A tree is a share of positives, or (feature, threshold, tree for x <= threshold, tree for the rest).
    """
    rng = np.random.default_rng(seed)

    def split(rows: np.ndarray, level: int):
        mean = float(y[rows].mean())
        if level == 0 or len(rows) < 8 or mean in (0.0, 1.0):
            return mean
        best = (np.inf, None, None)
        for j in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False).tolist():
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, t = x[order, j], y[order]
            left = np.cumsum(t)[:-1]
            n = np.arange(1, len(t))
            p, q = left / n, (left[-1] + t[-1] - left) / (len(t) - n)
            cost = np.where(v[1:] > v[:-1], n * p * (1 - p) + (len(t) - n) * q * (1 - q), np.inf)
            i = int(cost.argmin()) if len(cost) else 0
            if len(cost) and cost[i] < best[0]:
                best = (cost[i], j, (v[i] + v[i + 1]) / 2)
        if best[1] is None:
            return mean
        yes = x[rows, best[1]] <= best[2]
        if yes.all() or not yes.any():
            return mean
        return best[1], float(best[2]), split(rows[yes], level - 1), split(rows[~yes], level - 1)

    return [split(rng.integers(0, len(y), len(y)), levels) for _ in range(trees)]


def forest_column(forest: list, names: list[str]) -> Column:
    """The forest's mean share of positives as an expression over feature columns."""

    def sql(tree) -> str:
        return f"{tree!r}D" if isinstance(tree, float) else f"CASE WHEN {names[tree[0]]} <= {tree[1]!r}D THEN {sql(tree[2])} ELSE {sql(tree[3])} END"

    return F.expr("(" + " + ".join(sql(t) for t in forest) + f") / {len(forest)}D")


_GROWN: dict[tuple, list] = {}


def _forest(spark: SparkSession, findings: tuple) -> list:
    """The forest of labelled findings, grown once in a process; its features are computed by the session's expressions."""
    if findings not in _GROWN:
        _GROWN.clear()
        _GROWN[findings] = _grown(spark, findings)
    return _GROWN[findings]


def _grown(spark: SparkSession, findings: tuple) -> list:
    named = features()
    rows = spark.createDataFrame(list(findings), "finding string, before string, after string, path string, label int")
    got = rows.select(*[e.alias(n) for n, e in named], "label").collect()
    table = np.array([[float(v) for v in r] for r in got])
    return grow(table[:, :-1], table[:, -1])


def scan(docs: DataFrame, findings: list[tuple[str, str, str, str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, least: int = LEAST, plain: bool = False) -> DataFrame:
    """doc_id, word, finding, finding_sha256, length, score, is_secret: one row for each candidate of each row of ``docs``.

    Candidates are runs of at least ``least`` key characters; runs of letters alone without two capitals in a row beside small ones, as words are, only
    with ``plain``. Shorter runs and values with other characters in them are not looked at. A score of exactly the threshold is a secret.

    ``findings`` are labelled training rows, labelled_findings() if none are given. Null texts hold no candidate, a null path counts as
    empty, a run is judged whole however long; repeated rows repeat their candidates; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    forest = _forest(spark, tuple(findings if findings is not None else labelled_findings()))
    named = features()
    described = candidates(docs, id_col, text_col, path_col, least, plain).select("doc_id", "word", "finding", *[e.alias(f"f_{n}") for n, e in named])
    score = forest_column(forest, [f"f_{n}" for n, _ in named])
    return described.select("doc_id", "word", "finding", F.sha2("finding", 256).alias("finding_sha256"), F.length("finding").alias("length"), score.alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def op9_forest_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score and verdict."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
