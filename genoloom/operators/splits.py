"""Seeded splits: the order of md5(seed:key) decides, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of the hash that number a bucket (16 ** DIGITS buckets).
DIGITS = 3


def shuffled_rank(rows: DataFrame, seed: int, key: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with rank (1 up) in the order of md5(seed:key), within ``by`` if given.

    Buckets of the hash's first digits are numbered one by one and put behind the buckets before
    them, so the order is global and no task sorts more than a bucket. Equal keys tie.
    """
    by = by or []
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return rows.withColumn("_k", inside).join(before, [*by, "_b"]).withColumn("rank", F.col("_k") + F.col("_before")).drop("_h", "_b", "_k", "_before")


def kfold(rows: DataFrame, k: int, seed: int, key: str = "sid", by: list[str] | None = None) -> DataFrame:
    """``rows`` with fold 0 .. k - 1; sizes (within ``by``) differ by one at most."""
    return shuffled_rank(rows, seed, key, by).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def holdout(rows: DataFrame, share: float, seed: int, key: str = "sid", by: str = "label") -> DataFrame:
    """``rows`` with is_test: the first ceil(share * n) of each class in shuffled order."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_rank(rows, seed, key, [by]).join(sizes, by)
    return ranked.withColumn("is_test", F.col("rank") <= F.ceil(F.col("_n") * share)).drop("rank", "_n")


def chunks(rows: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """``rows`` (rank 1 up) with chunk: balanced pieces [i * n // k, (i + 1) * n // k).

    Whole numbers only: a quotient has too few decimals to tell a piece's last rank from the next.
    """
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("chunk", F.expr(f"CAST((CAST({rank} AS DECIMAL(20,0)) * {k} - 1) DIV _n AS INT)")).drop("_n")
