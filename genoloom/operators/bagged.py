"""Decision trees and random forests of rows that are counted: equal rows are one, however many they are.

Rows are (label, x, n): n rows of this label and these features. A tree draws each row Poisson(1) times, so
n equal rows together Poisson(n) times: that is drawn at once, by a generator seeded with the row. Trees of
a forest grow together by levels, as those of ``keyed`` do; a level is one scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.keyed import _descend, _level_histograms, _split_arrays, best_splits
from genoloom.scratch import stage


def _drawn(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """``rows`` (label, x, n) with bags array<long>: how often each tree has the row."""

    @F.arrow_udf("array<long>")
    def draw(key: pa.Array, n: pa.Array) -> pa.Array:
        out = [np.random.Generator(np.random.Philox(key=seed << 64 | k & (2**64 - 1))).poisson(m, trees) for k, m in zip(key.to_pylist(), n.to_pylist(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * trees, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))

    return rows.withColumn("bags", draw(F.xxhash64("label", "x"), "n"))


def _by_tree(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(tree, places, labels, rows by features, times) of each tree in a batch (label, x, bags)."""
    label, m = batch.column(0).to_numpy(), batch.num_rows
    x, bags = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(m, -1) for k in (1, 2))
    for tree in range(bags.shape[1] if m else 0):
        mine = np.flatnonzero(bags[:, tree])
        yield str(tree), mine, label[mine], x[mine], bags[mine, tree]


def _offered(histograms: DataFrame, width: int, most: int, seed: int) -> DataFrame:
    """The histograms of ``most`` features of each node, those of the smallest seeded hashes."""
    if most >= width:
        return histograms
    features = histograms.select("model", "node", "feature").distinct()
    order = Window.partitionBy("model", "node").orderBy(F.xxhash64(F.lit(seed), "model", "node", "feature"), "feature")
    return histograms.join(features.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r"), ["model", "node", "feature"])


class Trees:
    """Fitted trees: each votes with its leaf's weighted share of cases."""

    def __init__(self, splits: dict, shares: dict[str, dict[int, float]], trees: int, levels: int):
        self.splits, self.trees, self.levels = splits, trees, levels
        self.ends = {t: (np.array(sorted(s), np.int64), np.array([s[k] for k in sorted(s)])) for t, s in shares.items()}

    def prediction(self, x: Column) -> Column:
        """1 where the mean share of cases is over a half, else 0, for features array<double>."""
        splits, ends, trees, levels = self.splits, self.ends, self.trees, self.levels

        @F.arrow_udf("int")
        def vote(x: pa.Array) -> pa.Array:
            values, total = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), np.zeros(len(x))
            for tree in map(str, range(trees)):
                nodes, shares = ends[tree]
                total += shares[np.searchsorted(nodes, _descend(splits.get(tree), values, levels))]
            return pa.array((total > trees / 2 + 1e-9).astype(np.int32))

        return vote(x)


@dataclass
class Growing:
    """A forest of so many trees, or one tree of all rows (None).

    A node of a forest is offered ceil(sqrt(features)) features, a tree's all. Classes weigh n / (2 * n of
    the class); a side keeps ``leaf`` of the rows, which alone bounds a tree.
    """

    trees: int | None
    seed: int
    leaf: float = 0.05

    def fit(self, rows: DataFrame) -> Trees:
        """The trees of ``rows`` (label, x array<double>, n); all x have one length."""
        return _grown(rows, self.trees, self.seed, self.leaf)


def _grown(rows: DataFrame, trees: int | None, seed: int, leaf: float) -> Trees:
    rows = rows.where("label IN (0, 1) AND x IS NOT NULL")
    many = _drawn(rows, trees, seed) if trees else rows.withColumn("bags", F.array(F.col("n").cast("long")))
    many, number = stage(many.select("label", "x", "bags"), "bags"), trees or 1
    totals = rows.agg(F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("n1"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width")).first()
    n0, n1, width = totals
    most = math.ceil(math.sqrt(width)) if trees else width
    spark = rows.sparkSession
    classes = spark.range(number).select(F.col("id").cast("string").alias("model"), F.lit(n0).alias("n0"), F.lit(n1).alias("n1"))
    splits, levels, counts = None, math.ceil(1 / leaf) + 2, {str(t): {1: (0, 0)} for t in range(number)}
    for level in range(levels):
        hist = stage(_level_histograms(many, splits, level, _by_tree), "histograms")
        for r in hist.where("feature = 0").groupBy("model", "node").agg(F.sum("ctl").alias("c"), F.sum("cas").alias("d")).collect():  # at most 1 / leaf a tree
            counts[r["model"]][r["node"]] = r["c"], r["d"]
        new = stage(best_splits(_offered(hist, width, most, seed), classes, leaf), "splits")
        if new.isEmpty():
            break
        splits = new if splits is None else splits.unionByName(new)
    w0, w1 = (1 / max(n, 1) for n in (n0, n1))
    shares = {t: {node: (d * w1 / (c * w0 + d * w1) if c + d else 0.0) for node, (c, d) in nodes.items()} for t, nodes in counts.items()}
    return Trees(_split_arrays(splits), shares, number, levels)
