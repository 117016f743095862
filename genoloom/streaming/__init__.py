"""Pair counters kept current by a stream: cell counts add up, so new subjects add to what is there.

``keep_counters`` writes the counters of each micro-batch as a partition named by the batch's number.
A batch that runs again after a failure replaces its own partition, so it counts once. The counters
of all batches add up to those of all subjects whenever they are read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from genoloom.operators.pairs import CELLS, count_gains, pair_cells, pair_counts

log = logging.getLogger(__name__)


def streamed_cells(subjects: DataFrame, width: int) -> DataFrame:
    """Cell counts of a streaming matrix (sid, label, g); write it in update or complete mode. State
    has at most nine rows a pair."""
    return pair_cells(subjects, width)


def _schema(subjects: DataFrame, keys: list[str]) -> StructType:
    out = StructType([subjects.schema[k] for k in keys])
    for name, kind in [("f1", IntegerType()), ("f2", IntegerType()), *[(c, LongType()) for c in CELLS], ("batch", LongType())]:
        out = out.add(name, kind)
    return out


def keep_counters(subjects: DataFrame, width: int, path: str, checkpoint: str, keys: list[str] | None = None) -> list[tuple[int, int]]:
    """Counts the new rows of a streaming matrix (keys, sid, label, g) into the table at ``path``.

    Runs until all rows there at its start are counted; (batch, rows) of each batch that ran (of the
    last hundred, or as many as spark.sql.streaming.numRecentProgressUpdates says). ``path`` and ``checkpoint`` belong together: with a new checkpoint, begin a new table. Keys must be few
    (cohorts, centres): a batch adds at most a row for each key and pair.
    """
    keys, spark = keys or [], subjects.sparkSession
    # The folder is there, and can be read, even if no row ever comes.
    spark.createDataFrame([], _schema(subjects, keys)).write.mode("append").partitionBy("batch").parquet(path)

    def count(batch: DataFrame, number: int) -> None:
        counts = pair_counts(batch, width, keys).withColumn("batch", F.lit(number).cast("long"))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        log.info("batch %d counted into %s", number, path)

    query = subjects.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]


def counters(spark: SparkSession, path: str, subjects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, f1, f2, c0..c8, d0..d8): the counters of all batches so far (``subjects`` gives the keys' types)."""
    keys = keys or []
    rows = spark.read.schema(_schema(subjects, keys)).parquet(path)
    return rows.groupBy(*keys, "f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])


def counted_gains(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, f1, f2, c0..c8, d0..d8, ig, mi, main_f1, main_f2) of a table of counters."""
    return count_gains(counts, [*(keys or []), "f1", "f2", *CELLS])
