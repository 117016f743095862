"""Many models at once: classifiers with a key, fitted together by a few aggregations over all rows.

Rows are (model, label, x): each row of features belongs to the training set of the model that its key
names, and what a round sends is sums by model. ``training_sets`` gives every row to the folds that
learn from it, inside the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.hot import few
from genoloom.scratch import stage

#: Models whose state is broadcast; more are joined by a shuffle.
MODELS = 10_000


def training_sets(rows: DataFrame, folds: int) -> DataFrame:
    """(model, label, x) of rows (set string, fold, label, x): each goes to the models of all folds but its own.

    A model's key is set, a slash and the number of the fold that it does not see. Rows of a negative
    fold teach none.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    return rows.where("fold >= 0").select("label", "x", "set", F.explode(others).alias("_k")).select(F.concat_ws("/", "set", "_k").alias("model"), "label", F.col("x").cast("array<double>").alias("x"))


def scoring_sets(rows: DataFrame, folds: int) -> DataFrame:
    """(model, cohort, label, x): each row for all folds of its set, in cohort train or test.

    A row of a negative fold belongs to nobody's training: its cohort is validation.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_k")
    cohort = F.when(F.col("fold") < 0, "validation").when(F.col("_k") == F.col("fold"), "test").otherwise("train").alias("cohort")
    return rows.select("label", "x", "set", "fold", each).select(F.concat_ws("/", "set", "_k").alias("model"), cohort, "label", F.col("x").cast("array<double>").alias("x"))


def _classes(data: DataFrame) -> DataFrame:
    """(model, n0, n1, width) of each model's rows; labels other than 0 and 1, and null x, count nowhere."""
    return data.where("label IN (0, 1) AND x IS NOT NULL").groupBy("model").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"), F.max(F.size("x")).alias("width"))


# ---------------------------------------------------------------- logistic regression

STATE = "model string, n0 long, n1 long, w array<double>, step array<double>, norm double, gradient double, rounds int"


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, places, labels, rows by features) of each model in a batch (model, label, x); null is NaN."""
    model, x = batch.column(0).dictionary_encode(), batch.column(2)
    code, label = model.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    flat, sizes = x.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(x).to_numpy(zero_copy_only=False)
    starts, order = np.cumsum(sizes) - sizes, np.argsort(code, kind="stable")
    for k, mine in enumerate(np.split(order, np.cumsum(np.bincount(code, minlength=len(model.dictionary)))[:-1])):
        if len(mine):
            yield model.dictionary[k].as_py(), mine, label[mine], flat[starts[mine][:, None] + np.arange(sizes[mine[0]])].astype(float, copy=False)


def _slopes(held: dict[str, tuple] | None):
    """(model, sums): of each model in a task the gradient, then the Hessian, of the weighted loss.

    ``held``: w, n0 and n1 of every model; None if rows carry them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for model, mine, y, x in _by_model(batch):
                if held is not None and model not in held:
                    continue
                w, n0, n1 = held[model] if held is not None else (batch.column(k)[int(mine[0])].as_py() for k in (3, 4, 5))
                a = np.column_stack((np.ones(len(x)), x))
                s = np.where(y == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0))
                p = 1 / (1 + np.exp(-np.clip(a @ np.array(w), -700, 700)))
                total = np.concatenate((a.T @ (s * (p - y)), ((a * (s * p * (1 - p))[:, None]).T @ a).reshape(-1)))
                sums[model] = sums[model] + total if model in sums else total
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["model", "sums"])

    return run


def _newton(strength: float, tolerance: float):
    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                w, last, sums = np.array(r.w), np.array(r.step), np.array(r.sums)
                d, ridge = len(w), np.full(len(w), strength)
                ridge[0] = 0.0  # the intercept is free
                gradient = sums[:d] + ridge * w
                norm = float(np.abs(gradient).max())
                if norm <= tolerance * (r.n0 + r.n1):
                    out.append((r.model, r.n0, r.n1, w, np.zeros(d), norm, norm, r.rounds))
                elif norm > r.norm:  # the step was too long: half of it back
                    out.append((r.model, r.n0, r.n1, w - last / 2, last / 2, r.norm, norm, r.rounds + 1))
                else:
                    move = -np.linalg.solve(sums[d:].reshape(d, d) + np.diag(ridge + 1e-12), gradient)
                    out.append((r.model, r.n0, r.n1, w + move, move, norm, norm, r.rounds + 1))
            yield pd.DataFrame(out, columns=["model", "n0", "n1", "w", "step", "norm", "gradient", "rounds"])

    return step


def logistic_models(data: DataFrame, c: float = 1.0, tolerance: float = 1e-10, most_rounds: int = 60) -> DataFrame:
    """(model, w array<double>, n0, n1, gradient, rounds): a logistic regression for each key of ``data`` (a table).

    w[0] is the intercept. The loss is that of class weights n / (2 * n of the class) with the penalty
    sum of squares / (2 * c), less the intercept's. Newton's steps for all models together: a round is
    one scan, which sends a gradient and a Hessian by task and model, and one aggregation of them.
    gradient: the largest entry where w stands. A model with rows of one class has only an intercept of
    that class's sign and a null gradient.
    """
    known = stage(_classes(data), "classes")
    one = known.where("n0 = 0 OR n1 = 0").select("model", F.concat(F.array(F.when(F.col("n1") > 0, 1.0).otherwise(-1.0)), F.array_repeat(F.lit(0.0), F.col("width"))).alias("w"), "n0", "n1", F.lit(None).cast("double").alias("gradient"), F.lit(0).alias("rounds"))
    zeros = F.array_repeat(F.lit(0.0), F.col("width") + 1)
    state = stage(known.where("n0 > 0 AND n1 > 0").select("model", "n0", "n1", zeros.alias("w"), zeros.alias("step"), F.lit(float("inf")).alias("norm"), F.lit(float("inf")).alias("gradient"), F.lit(0).alias("rounds")), "weights")
    rows, done = data.where("label IN (0, 1) AND x IS NOT NULL"), []
    for _ in range(most_rounds):
        if state.isEmpty():
            break
        held = state.select("model", "w", "n0", "n1").limit(MODELS + 1).collect()
        if len(held) <= MODELS:  # they travel with the function, not with each row
            each = rows.select("model", "label", "x").mapInArrow(_slopes({r["model"]: (r["w"], r["n0"], r["n1"]) for r in held}), "model string, sums array<double>")
        else:
            each = rows.join(state.select("model", "w", "n0", "n1"), "model").select("model", "label", "x", "w", "n0", "n1").mapInArrow(_slopes(None), "model string, sums array<double>")
        sums = each.select("model", F.posexplode("sums").alias("i", "s")).groupBy("model", "i").agg(F.sum("s").alias("s"))
        sums = sums.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"))
        new = stage(state.join(sums, "model").select("model", "n0", "n1", "w", "step", "norm", "rounds", "sums").mapInPandas(_newton(1.0 / c, tolerance), STATE), "weights")
        still = F.col("gradient") > tolerance * (F.col("n0") + F.col("n1"))
        done.append(new.where(~still))
        state = new.where(still)
    else:
        done.append(state)
    out = one
    for part in done:
        out = out.unionByName(part.select("model", "w", "n0", "n1", "gradient", "rounds"))
    return out


def logistic_predictions(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` (model, ..., x) with prediction int: 1 where the model's score is over 0."""
    named = few(models.select("model", F.col("w").alias("_w")), MODELS)
    score = F.get("_w", F.lit(0)) + F.aggregate(F.zip_with("x", F.slice("_w", F.lit(2), F.size("x")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.join(named, "model").withColumn("prediction", (score > 0).cast("int")).drop("_w")


# ---------------------------------------------------------------- decision trees

NODE_COLUMNS = ["model", "node", "feature", "threshold", "left", "right", "n0", "n1", "label"]


def _walk(splits: Column, x: Column, levels: int) -> Column:
    """The node that a row reaches from 1 in at most ``levels`` steps; 2k and 2k + 1 are below node k."""

    def down(node: Column, _: Column) -> Column:
        s = F.try_element_at(splits, node)
        below = F.when(F.get(x, s["feature"]) <= s["threshold"], 2 * node).otherwise(2 * node + 1)
        return F.when(s.isNull(), node).otherwise(below)

    return F.reduce(F.sequence(F.lit(1), F.lit(levels)), F.lit(1).cast("long"), lambda n, k: down(n, k)) if levels else F.lit(1).cast("long")


def _maps(splits: DataFrame) -> DataFrame:
    """(model, _splits): each model's splits as a map from their node, at most 1 / leaf share of them."""
    entry = F.struct("node", F.struct("feature", "threshold").alias("s"))
    return splits.groupBy("model").agg(F.map_from_entries(F.collect_list(entry)).alias("_splits"))


def tree_histograms(placed: DataFrame) -> DataFrame:
    """(model, node, feature, v, ctl, cas) of rows (model, node, label, x): one aggregation."""
    rows = placed.select("model", "node", "label", F.posexplode("x").alias("feature", "v"))
    return rows.groupBy("model", "node", "feature", "v").agg(F.count_if(F.col("label") == 0).alias("ctl"), F.count_if(F.col("label") == 1).alias("cas"))


#: Whole numbers from -SPAN to SPAN - 1 are counted in arrays; bytes of them that a task holds.
SPAN, HELD = 128, 64 << 20


def _descend(splits: tuple[np.ndarray, np.ndarray, np.ndarray] | None, x: np.ndarray, levels: int) -> np.ndarray:
    """What ``_walk`` gives, for all rows of a model at once; ``splits``: nodes in order, features, thresholds."""
    node = np.ones(len(x), np.int64)
    going = np.arange(len(x))
    for _ in range(levels if splits is not None else 0):
        at = np.minimum(np.searchsorted(splits[0], node[going]), len(splits[0]) - 1)
        split = splits[0][at] == node[going]
        going, at = going[split], at[split]
        if not len(going):
            break
        node[going] = 2 * node[going] + ~(x[going, splits[1][at]] <= splits[2][at])
    return node


def _split_arrays(splits: DataFrame | None) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The splits of each model, at most 1 / leaf share of them."""
    found: dict[str, list] = {}
    for r in splits.where("feature IS NOT NULL").select("model", "node", "feature", "threshold").collect() if splits is not None else []:
        found.setdefault(r["model"], []).append((r["node"], r["feature"], r["threshold"]))
    return {k: tuple(np.array(c, t) for c, t in zip(zip(*sorted(v), strict=True), (np.int64, np.int64, float), strict=True)) for k, v in found.items()}


def _each_once(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, None]]:
    for found in _by_model(batch):
        yield *found, None


def _level_histograms(rows: DataFrame, splits: DataFrame | None, level: int, each: Callable = _each_once) -> DataFrame:
    """``tree_histograms`` of the rows that reach a level: a task walks them down and counts them in arrays.

    ``each`` gives (model, places, labels, rows by features, times) of each model in a batch of ``rows``;
    times is how often each row counts, None for once.
    """
    held = _split_arrays(splits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def rows_of(model, node, feature, v, ctl, cas):
            n = len(node)
            return pa.RecordBatch.from_arrays([pa.array([model] * n, pa.string()), pa.array(node, pa.int64()), pa.array(feature, pa.int32()), pa.array(v, pa.float64(), from_pandas=True), pa.array(ctl, pa.int64()), pa.array(cas, pa.int64())], names=["model", "node", "feature", "v", "ctl", "cas"])

        def kept():
            for (model, node), counts in sums.items():
                f, v = np.nonzero(counts.any(axis=2))
                yield rows_of(model, np.full(len(f), node), f, v - float(SPAN), counts[f, v, 0], counts[f, v, 1])

        for batch in batches:
            for model, _, y, x, times in each(batch):
                if level and model not in held:
                    continue
                nodes = _descend(held.get(model), x, level)
                for node in np.unique(nodes[nodes >= 1 << level]):
                    own = nodes == node
                    mine, label, width = x[own], y[own].astype(np.int64), x.shape[1]
                    n = None if times is None else times[own].astype(float)  # whole numbers, exact to 2 ** 53
                    whole = (np.abs(mine) < SPAN).all() and (mine == np.trunc(mine)).all()
                    if whole:
                        cell = ((mine.astype(np.int64) + SPAN) + 2 * SPAN * np.arange(width)) * 2 + label[:, None]
                        found = np.bincount(cell.ravel(), None if n is None else np.repeat(n, width), width * 4 * SPAN).astype(np.int64).reshape(width, 2 * SPAN, 2)
                        key = model, int(node)
                        sums[key] = sums[key] + found if key in sums else found
                    else:
                        for f in range(width):
                            v, at = np.unique(mine[:, f], return_inverse=True)
                            pair = np.bincount(2 * at + label, n, 2 * len(v)).astype(np.int64).reshape(-1, 2)
                            yield rows_of(model, np.full(len(v), node), np.full(len(v), f), v, pair[:, 0], pair[:, 1])
            if sum(c.nbytes for c in sums.values()) > HELD:
                yield from kept()
                sums.clear()
        yield from kept()

    found = (rows.select("model", "label", "x") if each is _each_once else rows).mapInArrow(count, "model string, node long, feature int, v double, ctl long, cas long")
    return found.groupBy("model", "node", "feature", "v").agg(F.sum("ctl").alias("ctl"), F.sum("cas").alias("cas"))


def best_splits(histograms: DataFrame, classes: DataFrame, leaf: float) -> DataFrame:
    """(model, node, feature, threshold, gain): the split of each node that lowers weighted Gini most.

    Classes weigh n / (2 * n of the class) by the model's own rows; either side keeps at least
    ``leaf`` of the model's rows. Thresholds lie between neighbouring values. Equal gains (to nine
    decimals): the first feature, then the lowest threshold. Nodes without a split that gains have no row.
    """
    w = Window.partitionBy("model", "node", "feature").orderBy("v")
    every = Window.partitionBy("model", "node", "feature")
    rows = histograms.withColumns({"l0": F.sum("ctl").over(w), "l1": F.sum("cas").over(w), "t0": F.sum("ctl").over(every), "t1": F.sum("cas").over(every), "next": F.lead("v").over(w)}).where("next IS NOT NULL")
    rows = rows.join(few(classes, MODELS), "model")
    total = F.col("n0") + F.col("n1")
    least = F.greatest(F.lit(1), F.ceil(F.lit(leaf) * total))
    share = lambda a, b: F.try_divide((a * F.try_divide(total, 2.0 * F.col("n0"))) * (b * F.try_divide(total, 2.0 * F.col("n1"))), a * F.try_divide(total, 2.0 * F.col("n0")) + b * F.try_divide(total, 2.0 * F.col("n1")))
    left, right, top = (share(a, b) for a, b in ((F.col("l0"), F.col("l1")), (F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1")), (F.col("t0"), F.col("t1"))))
    sized = (F.col("l0") + F.col("l1") >= least) & (F.col("t0") + F.col("t1") - F.col("l0") - F.col("l1") >= least)
    rows = rows.where(sized).withColumn("gain", F.round(2 * (top - left - right) / total, 9)).where("gain > 0")
    best = F.min(F.struct((-F.col("gain")).alias("gain"), "feature", ((F.col("v") + F.col("next")) / 2).alias("threshold"))).alias("b")
    return rows.groupBy("model", "node").agg(best).select("model", "node", "b.feature", "b.threshold", (-F.col("b.gain")).alias("gain"))


def tree_models(data: DataFrame, leaf: float = 0.05) -> DataFrame:
    """NODE_COLUMNS: a decision tree for each key of ``data`` (a table), a row a node.

    Trees grow by levels, all together: a level is one scan, in which rows walk to their node, and one
    aggregation of histograms. A side keeps ``leaf`` of a model's rows, so a tree has at most 1 / leaf
    leaves and no more levels; there is no other bound. Node 1 is the root; left and right (and
    feature, threshold) are null at leaves; label is the heavier class of a node's rows (0 if equal).
    """
    rows, classes = data.where("label IN (0, 1) AND x IS NOT NULL"), stage(_classes(data).drop("width"), "classes")
    splits, nodes, small = None, [], classes.limit(MODELS + 1).count() <= MODELS
    for level in range(math.ceil(1 / leaf) + 1):
        if small:
            placed = None
        elif splits is None:
            placed = rows.withColumn("node", F.lit(1).cast("long"))
        else:
            walked = rows.join(few(_maps(splits), MODELS), "model").withColumn("node", _walk(F.col("_splits"), F.col("x"), level))
            placed = walked.where(F.col("node") >= 1 << level).select("model", "node", "label", "x")
        hist = stage(_level_histograms(rows, splits, level) if small else tree_histograms(placed), "histograms")
        nodes.append(hist.where("feature = 0").groupBy("model", "node").agg(F.sum("ctl").alias("n0"), F.sum("cas").alias("n1")))
        new = stage(best_splits(hist, classes, leaf), "splits")
        if new.isEmpty():
            break
        splits = new if splits is None else splits.unionByName(new)
    found = nodes[0]
    for part in nodes[1:]:
        found = found.unionByName(part)
    if splits is not None:
        found = found.join(splits.select("model", "node", "feature", "threshold"), ["model", "node"], "left")
    else:
        found = found.withColumns({"feature": F.lit(None).cast("int"), "threshold": F.lit(None).cast("double")})
    below = lambda k: F.when(F.col("feature").isNotNull(), 2 * F.col("node") + k)
    whole = few(classes.select("model", F.col("n0").alias("a0"), F.col("n1").alias("a1")), MODELS)
    label = (F.col("n1") * F.col("a0") > F.col("n0") * F.col("a1")).cast("int")
    return found.join(whole, "model").withColumns({"left": below(0), "right": below(1), "label": F.when(F.col("a0") * F.col("a1") > 0, label).otherwise((F.col("a1") > 0).cast("int"))}).select(*NODE_COLUMNS)


def tree_predictions(rows: DataFrame, trees: DataFrame, leaf: float = 0.05) -> DataFrame:
    """``rows`` (model, ..., x) with node (the leaf reached) and prediction int; ``trees`` is a table."""
    levels = math.ceil(1 / leaf)
    if trees.select("model").distinct().limit(MODELS + 1).count() <= MODELS:
        splits = _split_arrays(trees)
        known = trees.select("model").distinct()

        @F.arrow_udf("long")
        def leaf_of(model: pa.Array, x: pa.Array) -> pa.Array:
            out = np.ones(len(model), np.int64)
            for name, mine, _, values in _by_model(pa.RecordBatch.from_arrays([model, model, x], names=["model", "label", "x"])):
                out[mine] = _descend(splits.get(name), values, levels)
            return pa.array(out)

        ends = F.broadcast(trees.select("model", "node", F.col("label").alias("prediction")))  # at most 2 / leaf a model
        return rows.join(F.broadcast(known), "model", "left_semi").withColumn("node", leaf_of("model", "x")).join(ends, ["model", "node"], "left")
    labels = F.map_from_entries(F.collect_list(F.struct("node", "label"))).alias("_labels")
    splits = F.map_from_entries(F.filter(F.collect_list(F.struct("node", F.struct("feature", "threshold").alias("s"))), lambda e: e["s"]["feature"].isNotNull())).alias("_splits")
    held = few(stage(trees.groupBy("model").agg(labels, splits), "trees"), MODELS)
    walked = rows.join(held, "model").withColumn("node", _walk(F.col("_splits"), F.col("x"), math.ceil(1 / leaf)))
    return walked.withColumn("prediction", F.try_element_at("_labels", F.col("node"))).drop("_labels", "_splits")
