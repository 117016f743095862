"""Classification reports: class weights, confusion, fold means, stacks, cohort pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, label: str = "label", times: str | None = None) -> DataFrame:
    """(label, n, weight): n of all rows / (classes * n of the class); ``times``: a row stands for so many."""
    counts = rows.groupBy(F.col(label).alias("label")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))


def classification_report(scored: DataFrame, keys: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(keys, metric_row, precision, recall, f1, support) of label and prediction in {0, 1}.

    Rows: control (0), case (1), accuracy (its value in all four columns), macro avg, weighted avg.
    A ratio without a denominator is 0. ``times`` names a column that says for how many a row stands.
    """
    keys = keys or []
    number = F.col(times) if times else F.lit(1)
    ok = lambda a, b: F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), number)), F.lit(0)).cast("double")
    c = scored.groupBy(*keys).agg(ok(0, 0).alias("tn"), ok(0, 1).alias("fp"), ok(1, 0).alias("fn"), ok(1, 1).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    measures = {}
    for name, hit, wrong, missed in (("control", tn, fn, fp), ("case", tp, fp, fn)):
        p, r = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        measures[name] = (p, r, ratio(2 * p * r, p + r), hit + missed)
    n0, n1 = measures["control"][3], measures["case"][3]
    acc = ratio(tn + tp, n0 + n1)
    pairs = list(zip(measures["control"], measures["case"], strict=True))
    measures["accuracy"] = (acc, acc, acc, acc)
    measures["macro avg"] = (*[(a + b) / 2 for a, b in pairs[:3]], n0 + n1)
    measures["weighted avg"] = (*[ratio(a * n0 + b * n1, n0 + n1) for a, b in pairs[:3]], n0 + n1)
    rows = [F.struct(F.lit(k).alias("metric_row"), *[x.alias(n) for x, n in zip(v, ("precision", "recall", "f1", "support"), strict=True)]) for k, v in measures.items()]
    return c.select(*keys, F.inline(F.array(*rows)))


def fold_mean(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted mean of each report cell over folds."""
    return reports.groupBy(*keys, "metric_row").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "support")])


def stack(reports: dict[str, DataFrame], key: str) -> DataFrame:
    """Reports under one another, told apart by a key column."""
    return reduce(DataFrame.unionByName, [df.withColumn(key, F.lit(name)) for name, df in reports.items()])


def cohort_pivot(stacked: DataFrame, cohorts: list[str], keys: list[str]) -> DataFrame:
    """One row per (metric_row, keys), columns <cohort>_<measure>."""
    values = [F.first(c).alias(c) for c in ("precision", "recall", "f1", "support")]
    return stacked.groupBy("metric_row", *keys).pivot("cohort", cohorts).agg(*values)
