"""Written tables in the folder that all executors share.

Iterative and multi-pass operators cut their lineage by writing Parquet below ``spark.checkpoint.dir``:
a lost executor then costs a re-read, never a recomputation of an earlier pass with other contents.
Where the setting is absent (single-machine tests) a temporary folder of this process is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataquill.plans.lineage import delete, scratch_dir
from strataquill.shipping import ship


class Scratch:
    """A folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = scratch_dir(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back; an empty frame keeps its schema. Tables of hashes ask for snappy, as they don't compress."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        delete(self.spark, self.path(name))


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
