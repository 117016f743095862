"""Many models at once: against one model fitted alone, brute force, and walks in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.operators import keyed, learn, pairs, splits
from genoloom.plans.study import study
from genoloom.scratch import stage

ROWS = "set string, fold int, label int, x array<double>"


def rows_of(n, width, sets, seed, folds=3):
    rng, out = random.Random(seed), []
    for s in sets:
        for i in range(n):
            x = [float(rng.randrange(-2, 3)) for _ in range(width)]
            y = int(x[0] + (x[1] > 0) * x[2] + rng.gauss(0, 1.5) > 0.4)
            out.append((s, i % folds, y, x))
    return out


def gini(ctl, cas, n0, n1):
    a, b = ctl / n0, cas / n1
    return 2 * a * b / (a + b) if a + b else 0.0


def grow(rows, leaf, node, n0, n1, least, tree):
    """The tree by brute force: every split of every feature is tried."""
    c, d = (sum(y == k for y, _ in rows) for k in (0, 1))
    best = None
    for f in range(len(rows[0][1])):
        values = sorted({x[f] for _, x in rows})
        for v, w in zip(values, values[1:], strict=False):
            left = [r for r in rows if r[1][f] <= v]
            if min(len(left), len(rows) - len(left)) < least:
                continue
            l0, l1 = (sum(y == k for y, _ in left) for k in (0, 1))
            gain = round((gini(c, d, n0, n1) - gini(l0, l1, n0, n1) - gini(c - l0, d - l1, n0, n1)), 9)
            if gain > 0 and (best is None or (-gain, f, (v + w) / 2) < best):
                best = (-gain, f, (v + w) / 2)
    tree[node] = (best[1:] if best else (None, None), c, d, int(d * n0 > c * n1))
    if best:
        for k, side in ((2 * node, [r for r in rows if r[1][best[1]] <= best[2]]), (2 * node + 1, [r for r in rows if r[1][best[1]] > best[2]])):
            grow(side, leaf, k, n0, n1, least, tree)


@pytest.mark.parametrize("leaf", [0.05, 0.2])
def test_trees_are_those_of_brute_force(spark, leaf):
    rows = rows_of(150, 4, ["a", "b"], 1)
    data = keyed.training_sets(spark.createDataFrame(rows, ROWS).repartition(3), 3)
    got = {(r["model"], r["node"]): r for r in keyed.tree_models(data, leaf).collect()}
    for s in ("a", "b"):
        for k in range(3):
            mine = [(y, x) for t, fold, y, x in rows if t == s and fold != k]
            n0, n1 = (sum(y == c for y, _ in mine) for c in (0, 1))
            tree = {}
            grow(mine, leaf, 1, n0, n1, max(1, math.ceil(leaf * len(mine))), tree)
            assert {n for m, n in got if m == f"{s}/{k}"} == set(tree) and len(tree) > 3
            for node, ((f, t), c, d, label) in tree.items():
                r = got[f"{s}/{k}", node]
                assert (r["feature"], r["threshold"], r["n0"], r["n1"], r["label"]) == (f, t, c, d, label)
                assert (r["left"], r["right"]) == ((2 * node, 2 * node + 1) if f is not None else (None, None))


def test_predictions_are_walks(spark):
    rows = rows_of(200, 3, ["a"], 2)
    df = spark.createDataFrame(rows, ROWS)
    trees = keyed.tree_models(keyed.training_sets(df, 3))
    by = {(r["model"], r["node"]): r for r in trees.collect()}
    scored = keyed.tree_predictions(keyed.scoring_sets(df, 3), trees).collect()
    assert len(scored) == 600
    for r in scored:
        at = by[r["model"], 1]
        while at["feature"] is not None:
            at = by[r["model"], at["left"] if r["x"][at["feature"]] <= at["threshold"] else at["right"]]
        assert (r["node"], r["prediction"]) == (at["node"], at["label"])
    assert all(by[m, n]["n0"] + by[m, n]["n1"] >= math.ceil(0.05 * 133) for m, n in by)


def test_trees_of_one_class_equal_rows_and_nothing(spark):
    one = spark.createDataFrame([("m", 1, [0.0, 1.0]), ("m", 1, [1.0, 1.0]), ("n", 0, [2.0]), ("n", 1, [2.0]), ("n", None, [1.0]), ("n", 0, None)], "model string, label int, x array<double>")
    got = {(r["model"], r["node"]): (r["feature"], r["label"]) for r in keyed.tree_models(one).collect()}
    assert got == {("m", 1): (None, 1), ("n", 1): (None, 0)}
    assert keyed.tree_models(one.limit(0)).count() == 0


def test_regressions_are_those_fitted_alone(spark):
    rows = rows_of(240, 3, ["a", "b"], 3) + [("wide", i % 3, i % 2, [float(i % 5), float(i % 3), 1.0, float(i % 2)]) for i in range(60)]
    data = keyed.training_sets(spark.createDataFrame(rows, ROWS).repartition(4), 3)
    got = {r["model"]: r for r in keyed.logistic_models(data).collect()}
    assert set(got) == {f"{s}/{k}" for s in ("a", "b", "wide") for k in range(3)}
    for m, r in got.items():
        mine = [(y, x) for s, fold, y, x in rows if s == m[:-2] and fold != int(m[-1])]
        x, y = np.array([[1.0, *x] for _, x in mine]), np.array([y for y, _ in mine])
        s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        w = np.array(r["w"])
        slope = x.T @ (s * (1 / (1 + np.exp(-x @ w)) - y)) + w * np.array([0] + [1] * (len(w) - 1))
        assert np.abs(slope).max() < 1e-6 and r["n0"] + r["n1"] == len(y)
    alone = learn.fit(data.where("model = 'a/0'"), "x", "logisticRegression")
    assert np.abs(np.array([alone.intercept, *alone.coefficients]) - np.array(got["a/0"]["w"])).max() < 1e-3


def test_regressions_of_separable_and_single_classes(spark):
    rows = [("apart", int(i >= 50), [float(i), 0.0]) for i in range(100)] + [("only", 1, [1.0])] * 3 + [("only", None, [2.0])]
    got = {r["model"]: r for r in keyed.logistic_models(spark.createDataFrame(rows, "model string, label int, x array<double>")).collect()}
    assert got["apart"]["gradient"] < 1e-6 and got["only"]["w"] == [1.0, 0.0] and got["only"]["gradient"] is None
    models = spark.createDataFrame([(m, r["w"]) for m, r in got.items()], "model string, w array<double>")
    scored = keyed.logistic_predictions(spark.createDataFrame(rows, "model string, label int, x array<double>").where("label IS NOT NULL"), models).collect()
    assert all(r["prediction"] == r["label"] for r in scored)


@pytest.mark.parametrize("packed", [100_000, 2])
def test_signs_of_all_folds(spark, monkeypatch, packed):
    monkeypatch.setattr(pairs, "PACKED_EDGES", packed)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 1, None]), [rng.choice([0, 1, 2, 2]) for _ in range(5)], rng.randrange(4)) for i in range(300)]
    m = spark.createDataFrame(rows, "sid long, label int, g array<int>, fold int").repartition(3)
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (0, 4), (0, 1), (2, 2)], "f1 int, f2 int")
    got = sorted(map(tuple, pairs.fold_signs(m, edges, 4).collect()))
    want = []
    for k in range(4):
        train = m.where((F.col("fold") != k) & F.col("label").isNotNull())
        want += [(k, *r) for r in map(tuple, pairs.cell_signs(train, edges).collect())]
    assert got == sorted(want)
    assert pairs.fold_signs(m.limit(0), edges, 4).count() == 0


def test_study_scores_a_validation_cohort(spark):
    rng = random.Random(2)
    rows = []
    for s in range(360):
        g = [rng.randrange(3) for _ in range(5)]
        rows.append((s, int((g[1] + g[3]) % 3 == 0), g))
    m = spark.createDataFrame(rows, "sid long, label int, g array<int>")
    got = study(m.where("sid < 300"), list("vwxyz"), 0.3, 2, 2, kinds=("logisticRegression", "decisionTree"), validation=m.where("sid >= 300")).collect()
    assert {(r["features"], r["model"], r["cohort"]) for r in got} == {(f, k, c) for f in ("raw", "delta") for k in ("logisticRegression", "decisionTree") for c in ("train", "test", "validation")}
    assert {r["support"] for r in got if r["cohort"] == "validation" and r["metric_row"] == "macro avg"} == {60.0}
    assert min(r["precision"] for r in got if r["metric_row"] == "accuracy" and (r["model"], r["features"]) != ("logisticRegression", "raw")) > 0.8
    assert splits.kfold(m, 2, 25, by=["label"]).count() == 360


def test_models_that_travel_with_tasks_are_those_that_are_joined(spark, monkeypatch):
    """Weights and splits held by a task, or joined to each row: the same models, nodes and predictions."""
    rng = random.Random(11)
    rows = [(f"m{k}", int(sum(x) + rng.gauss(0, 1) > 2), x) for k in (0, 1) for _ in range(150) for x in [[float(rng.randrange(-2, 3)), rng.choice([0.5, 1.0, 2.25]), float(rng.randrange(3))]]]
    data = spark.createDataFrame(rows, "model string, label int, x array<double>").repartition(3).cache()

    def found():
        trees = stage(keyed.tree_models(data), "trees")
        models = {r["model"]: [round(v, 7) for v in r["w"]] for r in keyed.logistic_models(data).collect()}
        nodes = sorted(tuple(map(str, r)) for r in trees.collect())
        ends = sorted(keyed.tree_predictions(data, trees).groupBy("model", "node", "prediction", "label").count().collect())
        return models, nodes, [tuple(r) for r in ends]

    held = found()
    monkeypatch.setattr(keyed, "MODELS", 1)
    assert found() == held
