"""Reflogs as streams: parsing, windowed counts with late rows, and the newest value of every ref."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.sources.lines import reflog_columns


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(ref, old, new, committer, ts, tz, message) of reflog files that land below a folder named logs."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(path)
    parsed = rows.select(F.regexp_extract("_metadata.file_path", r"logs/(.*?)(\.[^/]*)?$", 1).alias("ref"), reflog_columns(F.col("value")).alias("x"))
    return parsed.select("ref", "x.*").where("ts is not null")


def moves_per_window(log: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, ref, moves): number of updates of each ref by window; rows later than ``late`` are dropped."""
    timed = log.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "ref").agg(F.count("*").alias("moves")).select(F.col("w.start").alias("start"), "ref", "moves")


def newest_values(log: DataFrame) -> DataFrame:
    """(ref, oid, ts): each ref's newest value so far."""
    return log.groupBy("ref").agg(F.max_by("new", "ts").alias("oid"), F.max("ts").alias("ts"))
