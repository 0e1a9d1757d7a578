"""Registered queries over the driver's tables and their SQL.

Every query takes (spark, sf_dir) and runs over whole tables. ``views`` reads the tables as the engine's concepts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strataquill.shipping import ship

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable]:
    """Register a function of Views under its name, with the SQL (after the views' own) that gives the same rows."""
    from strataquill.queries.views import Views, with_views

    def wrap(f: Callable[..., DataFrame]) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Views(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return run

    return wrap


def load() -> None:
    """Import all modules of queries."""
    from strataquill.queries import formats, graphs, matches, merges, packs, records, scalars, snapshots, streams  # noqa: F401
