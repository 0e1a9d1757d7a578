"""Numbering all rows of a table in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.plans.lineage import Materialised


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with its rows' places from 1 in an order, which should be total.

    Rows are sorted in ranges and written once with their range and place in it; a range's first place is the
    number of rows in the ranges before it, of which there are as many as shuffle partitions.
    """
    keep = Materialised(df.sparkSession, "ranking")
    local = keep(df.orderBy(*order).select("*", F.spark_partition_id().alias("sq_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("sq_at")))
    sizes = local.groupBy("sq_part").agg(F.count("*").alias("n"))
    before = sizes.select("sq_part", F.coalesce(F.sum("n").over(Window.orderBy("sq_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sq_before"))
    joined = local.join(F.broadcast(before), "sq_part")
    return joined.withColumn(name, F.col("sq_before") + F.col("sq_at") + 1).drop("sq_part", "sq_at", "sq_before")
