"""Three classifiers on raw or re-encoded features: one fit, any number of cohorts scored.

Rows of one label and equal features are counted first, by one aggregation; what is fitted and scored
over and over is a row for each, with its number.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.bagged import Growing, Trees
from genoloom.operators.reports import class_weights, classification_report, stack

KINDS = ("logisticRegression", "decisionTree", "randomForest")


def estimator(kind: str, n: int, c: float = 1.0, max_iter: int = 10_000, seed: int = 25):
    """The classifier of this kind for n training rows, with balanced weights in column w.

    L2 strength is 1 / (C * sum of weights), and balanced weights sum to n. A leaf holds at least
    5 % of rows.
    """
    if kind == "logisticRegression":
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter, elasticNetParam=0.0, regParam=1.0 / (c * max(n, 1)), standardization=False)
    if kind == "decisionTree":
        return Growing(None, seed)
    if kind == "randomForest":
        return Growing(100, seed)
    raise ValueError(kind)


def counted(rows: DataFrame, column: str, keys: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(keys, label, column, n): rows that are equal in all of these are one; ``times``: a row stands for so many."""
    n = F.sum(times) if times else F.count(F.lit(1))
    return rows.groupBy(*(keys or []), "label", column).agg(n.alias("n"))


def featured(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    return rows.select(*(keep or []), "label", array_to_vector(F.col(column).cast("array<double>")).alias("features"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores: the files of a narrow table are few however many rows it has."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def fit(train: DataFrame, column: str, kind: str, times: str | None = None, **options):
    """The fitted model of (label, column array), or of counted rows; every round scans all of them."""
    rows = counted(train, column, times=times)
    weights = F.broadcast(class_weights(rows, times="n").select("label", F.col("weight").alias("_w")))
    rows = rows.join(weights, "label").select("label", "n", F.col(column).cast("array<double>").alias("x"), (F.col("_w") * F.col("n")).alias("w"))
    weighted = spread(featured(rows, "x", ["n", "x", "w"])).cache()
    model = estimator(kind, weighted.agg(F.sum("n")).first()[0] or 0, **options).fit(weighted)
    weighted.unpersist()
    return model


def predictions(model, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with prediction int."""
    if isinstance(model, Trees):
        return rows.withColumn("prediction", model.prediction(F.col(column).cast("array<double>")))
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))
    return scored.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"))


def report(model, cohorts: dict[str, DataFrame], column: str, times: str | None = None) -> DataFrame:
    """Classification reports of one model on each cohort."""
    scored = {name: classification_report(predictions(model, counted(df, column, times=times), column), times="n") for name, df in cohorts.items()}
    return stack(scored, "cohort")
