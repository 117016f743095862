"""Embedding whitening: principal components of distinct quantised vectors, scaled to unit variance.

Entries become integers, so means and deviations are exact. The covariance is the Gramian of exactly
centred rows (MLlib's RowMatrix, a tree of packed triangles on executors) over their number; its
eigenvectors are found on the driver, whose matrices grow with the dimensions only, and are broadcast
to the tasks that project every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.scratch import stage

#: Entries become floor(SCALE * c) + SHIFT. A sum of longs is kept as two: over LOW bits and above.
SCALE, SHIFT, LOW = 64, 1_000_000, 20
#: Components of an eigenvalue under RANK times the dimensions times the largest are rounding noise.
RANK = 4 * np.finfo(float).eps


@dataclass
class Whitening:
    """n distinct vectors with exact sums; components (a column each), eigenvalues, shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean of each dimension: its floor, and what is left of the sum."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return ((x - whole).astype(float) - rest / self.n) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) ** 2 of each row, exact."""
        whole, rest = self.centre()
        far = x - whole
        size = self.n * (np.abs(far).max(initial=0).astype(float) + 1)
        if size * size * max(x.shape[1], 1) < 2**62:
            return ((self.n * far - rest) ** 2).sum(axis=1).tolist()
        return [sum((self.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in far.tolist()]


def quantised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, x array<long>) of the rows whose vector can be used.

    Left out are null and empty vectors, those with a null, non-finite entry or one whose integer is
    beyond 2**62, and those of another length than most have (of equally many, the longest).
    """
    v = F.col(f"`{vector_col}`")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | ~(F.abs(SCALE * c.cast("double")) < 2.0**62)
    good = rows.select(F.col(f"`{id_col}`").alias(id_col), v.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", bad))
    lengths = good.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    good = good.where(F.size("_v") == (lengths[0]["d"] if lengths else 0))
    return good.select(id_col, F.transform("_v", lambda c: F.floor(SCALE * c.cast("double")).cast("long") + SHIFT).alias("x"))


def gramian(rows: DataFrame) -> np.ndarray:
    """The sum of the outer products of the rows' only column, an array of doubles."""
    vectors = rows.select(array_to_vector(F.col(rows.columns[0])).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def fit(x: DataFrame, most: int = 16) -> Whitening | None:
    """The first ``most`` components of the distinct vectors of ``x`` (x array<long>); None without a vector.

    Directions without variance have no component. identity_error compares the covariance of the
    whitened distinct vectors with the identity.
    """
    spark = x.sparkSession
    distinct = stage(x.select("x").distinct(), "distinct-vectors")
    entry = distinct.select(F.posexplode("x").alias("i", "c"))
    low = F.col("c").bitwiseAND((1 << LOW) - 1)
    sums = entry.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("c", LOW)).alias("high"), F.sum(low).alias("low")).orderBy("i").collect()  # a row a dimension
    if not sums:
        return None
    out = Whitening(sums[0]["n"], [(r["high"] << LOW) + r["low"] for r in sums], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    whole, rest = out.centre()
    centre = spark.createDataFrame([(whole.tolist(), (rest / out.n).tolist())], "whole array<long>, part array<double>")
    centred = distinct.crossJoin(F.broadcast(centre)).select(F.transform("x", lambda c, i: (c - F.get("whole", i)).cast("double") - F.get("part", i)).alias("c"))
    covariance = gramian(centred) / out.n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK * len(values) * max(values.max(), 0.0)]
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)  # its largest entry is positive, the same in every run
    out.components = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    out.values, out.explained = values[order], values[order] / np.trace(covariance)
    if len(order):
        white = stage(project(distinct.select(F.lit(0).alias("id"), "x"), "id", out).select("whitened"), "whitened")
        mean = [r["m"] for r in white.select(F.posexplode("whitened").alias("i", "c")).groupBy("i").agg(F.avg("c").alias("m")).orderBy("i").collect()]
        means = spark.createDataFrame([(mean,)], "mean array<double>")
        again = white.crossJoin(F.broadcast(means)).select(F.transform("whitened", lambda c, i: c - F.get("mean", i)).alias("c"))
        out.identity_error = float(np.abs(gramian(again) / out.n - np.eye(len(order))).max())
    return out


def project(x: DataFrame, id_col: str, model: Whitening) -> DataFrame:
    """(id_col, deviation decimal(38,0), whitened array<double>) of each row (id_col, x array<long>).

    A deviation of more than 38 digits is null.
    """
    held = x.sparkSession.sparkContext.broadcast(model)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                values = np.stack(frame["x"].to_numpy())
                far = [Decimal(d) if d < 10**38 else None for d in held.value.deviation(values)]
                yield pd.DataFrame({id_col: frame[id_col], "deviation": far, "whitened": list(held.value.whiten(values))})

    kind = x.schema[id_col].dataType.simpleString()
    return x.select(id_col, "x").mapInPandas(rows, f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """(id_col, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double).

    A row for each usable vector (see ``quantised``) and component, from 1 by falling variance. Null
    ids and repeated rows are rows like others, but a vector counts once in the fit; vectors without
    any variance, and an empty table, give no rows; columns beside the two named are ignored.
    """
    x = quantised(rows, id_col, vector_col)
    model = fit(x, most)
    if model is None:
        kind = x.schema[id_col].dataType.simpleString()
        return x.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    each = project(x, id_col, model).select(id_col, "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return each.select(id_col, (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
