"""Running sums and ranks in a global order, without a task that holds a whole table or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.scratch import stage

#: The bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def sum_before(rows: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum (long) of ``weight`` over the rows before each, in the given order.

    The rows are sorted by ranges and written; sums inside a range add to those of all ranges before
    it. Ranges follow the data, so neither many rows nor many of one leading key make a task large;
    rows equal in all of ``order`` are in one range, in any order.
    """
    sorted_ = stage(rows.withColumn("_weight", weight.cast("long")).orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", ROW_BITS)
    parts = sorted_.groupBy(part.alias("_part")).agg(F.sum("_weight").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))  # a row a range
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    out = sorted_.withColumn("_part", part).withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return out.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_inside", "_start", "_weight", "_id")
