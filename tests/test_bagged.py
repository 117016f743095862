"""Classifiers of counted rows: against the trees of all rows, and the draws of a forest."""

import random

import numpy as np
from pyspark.sql import functions as F

from genoloom.operators import bagged, keyed, learn


def labelled(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = [float(rng.randrange(-2, 3)), rng.choice([0.5, 1.0, 2.25]), float(rng.randrange(3))]
        out.append((int(x[0] + x[1] * x[2] + rng.gauss(0, 1) > 2), x))
    return out


def test_estimators_see_equal_rows_once(spark, monkeypatch):
    seen = []

    class Fits:
        def fit(self, rows):
            seen.append(sorted((r["label"], r["n"], r["w"]) for r in rows.collect()))

    monkeypatch.setattr(learn, "estimator", lambda *_: Fits())
    rows = spark.createDataFrame([(int(i % 4 == 0), [i % 2]) for i in range(1000)], "label int, dd array<int>").repartition(3)
    learn.fit(rows, "dd", "logisticRegression")
    assert [(y, n) for y, n, _ in seen[0]] == [(0, 250), (0, 500), (1, 250)]
    assert np.allclose([w for *_, w in seen[0]], [250 * 1000 / 1500, 500 * 1000 / 1500, 250 * 1000 / 500])


def test_tree_of_counted_rows_is_that_of_all_rows(spark):
    rows = labelled(900, 3)
    df = spark.createDataFrame(rows, "label int, x array<double>").repartition(4)
    nodes = {r["node"]: r for r in keyed.tree_models(df.withColumn("model", F.lit("0"))).collect()}
    tree = learn.fit(df, "x", "decisionTree")
    at, feature, threshold = tree.splits["0"]
    assert {n: (f, t) for n, f, t in zip(at, feature, threshold, strict=True)} == {n: (r["feature"], r["threshold"]) for n, r in nodes.items() if r["feature"] is not None}
    found = learn.predictions(tree, df, "x").collect()
    walked = keyed.tree_predictions(df.withColumn("model", F.lit("0")), keyed.tree_models(df.withColumn("model", F.lit("0")))).collect()
    assert len(found) == 900 and sorted((r["x"], r["label"], r["prediction"]) for r in found) == sorted((r["x"], r["label"], r["prediction"]) for r in walked)


def test_draws_of_equal_rows(spark):
    rows = spark.createDataFrame([(0, [1.0], 10_000), (1, [1.0], 1), (1, [2.0], 1)], "label int, x array<double>, n long")
    got = {(r["label"], r["n"], r["x"][0]): np.array(r["bags"]) for r in bagged._drawn(rows, 2000, 25).collect()}
    many, one, other = got[0, 10_000, 1.0], got[1, 1, 1.0], got[1, 1, 2.0]
    assert abs(many.mean() - 10_000) < 12 and 0.85 < many.var() / 10_000 < 1.15
    assert 0.9 < one.mean() < 1.1 and 0.85 < one.var() < 1.15 and (one != other).any()
    assert [r["bags"] for r in bagged._drawn(rows.repartition(3), 2000, 25).orderBy("label", "x").collect()] == [r["bags"] for r in bagged._drawn(rows, 2000, 25).orderBy("label", "x").collect()]


def test_forest_offers_some_features_and_votes(spark):
    rows = labelled(900, 4)
    df = spark.createDataFrame(rows, "label int, x array<double>")
    forest = learn.fit(df, "x", "randomForest")
    roots = {int(f[list(n).index(1)]) for n, f, _ in forest.splits.values()}
    assert forest.trees == 100 and len(roots) > 1  # not every tree was offered the best feature
    report = learn.report(forest, {"all": df}, "x").where("metric_row = 'accuracy'").first()
    assert report["precision"] > 0.8 and report["support"] == report["precision"]
    again = learn.fit(df.repartition(5), "x", "randomForest")
    assert all(np.array_equal(a, b) for t in forest.splits for a, b in zip(forest.splits[t], again.splits[t], strict=True))
    single = learn.fit(df.where("label = 1"), "x", "randomForest")
    assert {r["prediction"] for r in learn.predictions(single, df, "x").collect()} == {1}
