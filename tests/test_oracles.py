"""Every registered query of the library against its SQL over the driver's smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strataquill import queries

queries.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, db, data, name):
    df = queries.QUERIES[name](spark, data)
    rel = db.sql(queries.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_octopus_merge_takes_every_document(spark, data):
    """each document is merged and added once by the third head, none is left out by its number."""
    path = F.concat("source", F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    paths = [r.path for r in spark.read.parquet(f"{data}/documents.parquet").select(path.alias("path")).collect()]
    got = [r.path for r in queries.QUERIES["octopus_merged_files"](spark, data).collect()]
    assert sorted(got) == sorted(paths + [f"third/{p}" for p in paths])
