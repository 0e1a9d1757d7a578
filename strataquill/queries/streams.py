"""Queries that run as streams over the log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions.dates import epoch_seconds
from strataquill.queries import query
from strataquill.streaming import logs
from strataquill.streaming.runs import drain


def _log(v) -> DataFrame:
    """Events as reflog rows (ref, new, ts) of a stream."""
    schema = v.table("events").schema
    events = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return events.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("ref"), F.col("event_id").alias("new"), epoch_seconds(F.col("ts")).alias("ts"))


@query("SELECT ref, oid, ts FROM (SELECT author AS ref, id AS oid, commit_time AS ts, row_number() OVER (PARTITION BY author ORDER BY id DESC) AS k FROM commits) WHERE k = 1")
def streamed_newest_values(v):
    """Every branch's newest value, kept as a stream's state."""
    return drain(logs.newest_values(_log(v)))


@query("SELECT commit_time // 86400 * 86400 AS start, author AS ref, count(*) AS moves FROM commits GROUP BY ALL")
def streamed_moves_per_day(v):
    """Updates of every branch by day, with a watermark for late rows."""
    found = drain(logs.moves_per_window(_log(v)))
    return found.select(F.unix_seconds("start").alias("start"), "ref", "moves")
