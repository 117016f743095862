"""Studies in chunks that resume: what a chunk wrote says whether it is done.

A chunk's rows are a partition of the results, written by Spark with dynamic overwrite. Its state comes
from counting them: as many rows as expected (done), fewer or more (partial), none (missing). A run
takes the chunks that are not done, one job each, and nothing else; a chunk that is run again replaces
what is left of it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from genoloom.operators.search import permutation_chunks, permuted_gains

log = logging.getLogger(__name__)


def results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows that all chunks have written so far; none if there is no folder yet."""
    # An empty append makes the folder, so that it can be read.
    spark.createDataFrame([], schema).write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.schema(schema).parquet(path)


def chunk_states(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, state, expected, found) of ``chunks`` (chunk, expected) by the rows ``found`` of them."""
    counts = found.groupBy("chunk").agg(F.count(F.lit(1)).alias("found"))
    rows = chunks.join(counts, "chunk", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    state = F.when(F.col("found") == F.col("expected"), "done").when(F.col("found") > 0, "partial").otherwise("missing")
    return rows.select("chunk", state.alias("state"), "expected", "found")


def state_counters(states: DataFrame) -> DataFrame:
    """(done, partial, missing, expected, found, complete): one row of counters over all chunks."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("done", "partial", "missing")], F.sum("expected").alias("expected"), F.sum("found").alias("found"), F.bool_and(F.col("state") == "done").alias("complete"))


def resume(spark: SparkSession, path: str, schema: StructType | str, chunks: DataFrame, work: Callable[[int], DataFrame]) -> list[int]:
    """Runs ``work`` for each chunk that is not done and writes its rows; the numbers of these chunks."""
    open_ = [r["chunk"] for r in chunk_states(results(spark, path, schema), chunks).where("state <> 'done'").orderBy("chunk").collect()]  # a row a job
    for chunk in open_:
        rows = work(chunk).withColumn("chunk", F.lit(chunk))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
        log.info("chunk %d written to %s", chunk, path)
    return open_


GAINS = "perm int, f1 int, f2 int, ig double, chunk int"


def permutation_plan(spark: SparkSession, width: int, permutations: int, jobs: int) -> DataFrame:
    """(chunk, expected): the jobs of a permutation study and the rows of each, one a pair and permutation."""
    each = permutation_chunks(permutations, jobs)
    return spark.createDataFrame([(i, n * comb(width, 2)) for i, (_, n) in enumerate(each)], "chunk int, expected long")


def permutation_study(m: DataFrame, width: int, permutations: int, jobs: int, seed: int, path: str, only: list[int] | None = None) -> tuple[DataFrame, list[int]]:
    """(GAINS rows of all chunks so far, the chunks that ran): permuted gains of every pair, in ``jobs`` chunks.

    Run again with the same arguments after a failure: only chunks that are not done run. ``only`` names
    the chunks that may run now. Every pair must have a valid cell in every permutation, else its
    chunk is never done.
    """
    spark, each = m.sparkSession, permutation_chunks(permutations, jobs)
    plan = permutation_plan(spark, width, permutations, jobs)
    mine = plan if only is None else plan.where(F.col("chunk").isin(only))
    ran = resume(spark, path, GAINS, mine, lambda k: permuted_gains(m, width, each[k][1], seed, each[k][0]).select("perm", "f1", "f2", "ig"))
    return results(spark, path, GAINS), ran
