"""Packs that land in a folder, as a stream of objects, and the negotiation of what to send."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from strataquill.operators import graph
from strataquill.shipping import ship
from strataquill.sources import packs


def read_pack_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """(file, offset, kind, size, base_offset, base_oid, crc32, data) of packs as they land; resolve() them batch by batch."""
    ship(spark)
    schema = "file string, offset long, kind string, size long, base_offset long, base_oid string, crc32 long, data binary"
    landed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                out = pd.DataFrame(list(packs.parse_pack(bytes(content))), columns=["offset", "kind", "size", "base_offset", "base_oid", "crc32", "data"])
                out.insert(0, "file", name)
                yield out

    return landed.select("path", "content").mapInPandas(run, schema)


def resolve_batches(stream: DataFrame, table: str, checkpoint: str, external: DataFrame | None = None):
    """A query that writes each batch's resolved objects to a folder batch=N of ``table``; a batch that is repeated after a failure replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        packs.resolve(df, external).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def negotiate(parents: DataFrame, haves: DataFrame, theirs: DataFrame) -> DataFrame:
    """(node): the newest commits that both sides have: common ancestors of what a receiver has and what the sender knows, none behind another."""
    return graph.lowest_common(parents, haves, theirs)
