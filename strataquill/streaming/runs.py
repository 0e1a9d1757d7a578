"""Running a stream over what has landed so far."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strataquill.plans.lineage import scratch_dir


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all input that is there, read back: in complete mode the last batch's table, in append mode all batches'.

    Each batch has a folder of its own, so one that is repeated after a failure is written once.
    """
    spark = stream.sparkSession
    root = scratch_dir(spark, "stream")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
