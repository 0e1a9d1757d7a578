"""A training-data pipeline over ``documents``: filter, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return rows of
``documents`` with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.llm import decontamination, exact_dedup, near_dedup, packing, quality
from strataquill.llm._store import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    return quality.classify(docs, carry=True).where("keep").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8), the document with the smallest id.

    An id that repeats is dropped only if none of its rows stays.
    """
    found = near_dedup.near_dedup(docs)
    gone = found.groupBy(F.col("doc_id").alias("sq_gone")).agg(F.max("kept").alias("kept")).where("not kept").select("sq_gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["sq_gone"]), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
