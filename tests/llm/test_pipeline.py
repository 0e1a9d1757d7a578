"""The pipeline's stages against brute force on a small table, and the registered queries against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from strataquill.llm import decontamination, registry
from tests.llm.test_dedup import brute_exact, brute_near


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, data).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and all(before[i] == t for i, t in after.items()) and 0 < len(after) <= len(before)
        rows = sorted(before.items())
        if name == "exact_dedup":
            assert sorted(repr(i) for i in after) == sorted(i for i, keep, *_ in brute_exact(rows) if i == keep)
        if name == "near_dedup":
            assert sorted(repr(i) for i in after) == sorted(i for i, _, c in brute_near(rows, 5, 80, 100) if i == c)
        if name == "decontamination":
            assert decontamination.overlaps(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0 and len(after) < len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    total, bins = sum(r.length for r in packed), len({r.sequence_id for r in packed})
    assert bins <= -(-total // 4096) + 1
    run = corpus_pipeline.run(spark, data).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_on_edges(spark, edges, nothing, data):
    for docs in (edges, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == edges.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, data, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = registry.QUERIES[name](spark, data)
    rel = db.sql(registry.ORACLES[name])
    order = lambda names, rows: sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(list(rel.columns), rel.fetchall())
