"""Materialisation points of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; without one, a temporary folder where all tasks run on this machine, else a RuntimeError."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not re.match(r"local(\[[^,]*(, *\d+)?\])?$", spark.sparkContext.master):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share: {spark.sparkContext.master} has none in common")
        made = tempfile.mkdtemp(prefix="strataquill-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. It goes when the application ends, or with release()."""
    path = f"{shared_dir(spark)}/strataquill/{name}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    spark.sparkContext.__dict__.setdefault("_strataquill_scratch", []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of all operators called so far and say how many folders went. Results that were not written or collected yet are lost."""
    made = spark.sparkContext.__dict__.get("_strataquill_scratch", [])
    for path in made:
        delete(spark, path)
    n = len(made)
    made.clear()
    return n


class Materialised:
    """Written tables of one iterative plan; a lost executor costs a read, not the iterations before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_dir(spark, name), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
