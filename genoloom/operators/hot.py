"""Joins with tables of checked size, and with one row a key where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.scratch import stage

#: Keys of more rows are hot; so many hot keys are broadcast at most (if there were more, HOT doubles).
HOT, BROADCAST_KEYS = 50_000, 20_000
#: Bytes of text that a broadcast of few rows may hold.
TEXT_BYTES = 16 << 20


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (a table) inner-joined with ``groups`` (a row a key, with n, its number of rows), less n.

    Rows of hot keys meet a broadcast of these keys where they are; the others are shuffled by key.
    Null keys meet nothing. There are at most rows / HOT hot keys, and HOT grows until they are few.
    """
    groups = stage(groups.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), "groups")
    top, hot = HOT, groups.where(F.col("n") > HOT).count()
    while hot > BROADCAST_KEYS:
        top *= 2
        hot = groups.where(F.col("n") > top).count()
    if not hot:
        return rows.join(groups.drop("n"), keys)
    few = F.broadcast(groups.where(F.col("n") > top).drop("n"))
    cold = rows.join(F.broadcast(few.select(keys)), keys, "left_anti").join(groups.where(F.col("n") <= top).drop("n"), keys)
    return rows.join(few, keys).unionByName(cold)


def few(table: DataFrame, most: int, text: str | None = None) -> DataFrame:
    """``table`` as a broadcast if it has at most ``most`` rows; else as it is, for a shuffled join.

    Rows must be narrow but for the column ``text``, of which a broadcast holds TEXT_BYTES at most; the
    table should then be a written one.
    """
    if text:
        n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
        return F.broadcast(table) if n <= most and size <= TEXT_BYTES else table
    rows = table.limit(most + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= most else table


#: Rows of one part that are worth no shuffle.
PART = 1 << 16


def even(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``rows`` in parts of like size, and their number.

    A narrow table has few row groups for very many rows, and a row group is read by one task. If a part
    holds more than twice its share, the rows are dealt out to all cores by a hash of ``key``.
    """
    parts = [r["count"] for r in rows.select(F.spark_partition_id().alias("_p")).groupBy("_p").count().collect()]  # a row a task
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, sum(parts)
    if max(parts, default=0) * cores > max(2 * n, PART * cores):
        rows = rows.repartition(max(cores, len(parts)), key)
    return rows, n
