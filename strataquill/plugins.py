"""Named extension points: content filters, signature checks, hooks and maintenance tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions import text as X
from strataquill.operators.matching import attributes

ContentFilter = Callable[[Column], Column]


@dataclass
class FilterRegistry:
    """Pairs of clean and smudge expressions by name; paths choose theirs through attributes."""

    drivers: dict[str, tuple[ContentFilter, ContentFilter]] = field(default_factory=lambda: {"text": (X.crlf_to_lf, X.lf_to_crlf)})

    def register(self, name: str, clean: ContentFilter, smudge: ContentFilter) -> None:
        self.drivers[name] = clean, smudge

    def apply(self, files: DataFrame, rules: list[str], direction: str = "clean") -> DataFrame:
        """Files (path, data, …) with each path's filter applied; a path without a known one stays."""
        which = attributes(F.col("path"), rules)["filter"]
        out = F.col("data")
        for name, pair in self.drivers.items():
            out = F.when(which == name, pair[direction == "smudge"](F.col("data"))).otherwise(out)
        return files.withColumn("data", out)


@dataclass
class Hooks:
    """Callbacks around writes: each takes and returns the rows to be written, or raises to refuse them."""

    before: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    after: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def write(self, df: DataFrame, path: str, mode: str = "append") -> None:
        for f in self.before:
            df = f(df)
        df.write.mode(mode).parquet(path)
        for f in self.after:
            f(df)


def verify(signed: DataFrame, check: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (payload, signature, …) with the verdict of a check, null where nothing is signed."""
    return signed.withColumn("valid", F.when(F.col("signature").isNotNull(), check(F.col("payload"), F.col("signature"))))


def maintain(tasks: dict[str, Callable[[], object]], only: list[str] | None = None) -> dict[str, str]:
    """Outcome of each task by name; one that fails doesn't keep the others from running."""
    out = {}
    for name, task in tasks.items():
        if only is None or name in only:
            try:
                task()
                out[name] = "done"
            except Exception as e:  # noqa: BLE001
                out[name] = f"failed: {e}"
    return out
