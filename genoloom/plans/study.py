"""The whole study: score, threshold, components, re-encode, classify over folds, average."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom import functions as fn
from genoloom.operators import graph, keyed, learn, pairs, reports, splits
from genoloom.scratch import stage


def component_networks(m: DataFrame, names: list[str], threshold: float, at_least: int) -> DataFrame:
    """(rank, snp1, snp2): the edges of the network's components with at least so many nodes.

    Gains are scored for every pair and compared with the threshold in half precision.
    """
    name = F.array(*[F.lit(n) for n in names])
    found = pairs.pair_gains(m, len(names)).where(fn.half_guard(F.col("ig"), threshold)).where(fn.half(F.col("ig")) >= fn.half(F.lit(threshold)))
    edges = stage(found.select(F.get(name, F.col("f1")).alias("snp1"), F.get(name, F.col("f2")).alias("snp2")), "edges")
    return graph.component_edges(edges, graph.large_components(edges, at_least, "snp1", "snp2"), "snp1", "snp2").select("rank", "snp1", "snp2")


def samples(rows: DataFrame, network: DataFrame, names: list[str], folds: int) -> DataFrame:
    """(model, cohort, label, x): every row for each component, kind of features and fold.

    ``rows`` has a column fold (negative: validation). The key is component, features and the fold not
    learnt from. Raw features are the component's own codes; delta features its signed degrees, whose
    signs come from the training rows of that fold. All components are encoded together: an edge
    touches only its own component's nodes.
    """
    edges = stage(pairs.name_edges_to_index(network.select("snp1", "snp2"), names), "edges")
    found = network.select("rank", F.explode(F.array("snp1", "snp2")).alias("snp")).groupBy("rank").agg(F.collect_set("snp").alias("snps")).collect()  # names of features
    number = {n: i for i, n in reversed(list(enumerate(names)))}
    nodes = {r["rank"]: sorted(number[n] for n in r["snps"]) for r in found}
    own = lambda kind, c: F.inline(F.array(*[F.struct(F.lit(f"{rank}/{kind}").alias("set"), F.array(*[F.get(c, F.lit(i)).cast("double") for i in at]).alias("x")) for rank, at in sorted(nodes.items())]))
    out = keyed.scoring_sets(rows.select("fold", "label", own("raw", "g")), folds)
    signs = stage(pairs.fold_signs(rows, edges, folds), "signs")
    for k in range(folds):
        encoded = pairs.delta_degrees(rows.withColumn("sid", F.struct("sid", "fold")), edges, signs.where(F.col("fold") == k), len(names))
        part = keyed.scoring_sets(encoded.select("sid.fold", "label", own("delta", "dd")), folds)
        out = out.unionByName(part.where(F.split("model", "/")[2] == str(k)))
    return out


def study(m: DataFrame, names: list[str], threshold: float, at_least: int = 2, folds: int = 5, seed: int = 25, kinds: tuple[str, ...] = learn.KINDS, validation: DataFrame | None = None) -> DataFrame:
    """(component, features, model, cohort, metric_row, precision, recall, f1, support): mean reports.

    For every component of the thresholded network and every stratified fold, each kind of classifier
    learns from the training rows, once on the component's own features (raw) and once on their
    signed degrees (delta, whose signs come from training rows only); cohorts train and test are scored,
    and validation if such a matrix is given. Logistic regressions and trees of all components and
    folds are fitted together; forests one by one.
    """
    rows = splits.kfold(m, folds, seed, by=["label"]).select("sid", "label", "g", "fold")
    if validation is not None:
        rows = rows.unionByName(validation.select("sid", "label", "g", F.lit(-1).alias("fold")))
    rows = stage(rows, "folds")
    network = stage(component_networks(rows.where("fold >= 0"), names, threshold, at_least), "components")
    if network.isEmpty():
        return m.sparkSession.createDataFrame([], "component long, features string, model string, cohort string, metric_row string, precision double, recall double, f1 double, support double")
    every = stage(samples(rows, network, names, folds), "samples")
    train, found = every.where("cohort = 'train'"), []
    for kind in kinds:
        if kind == "logisticRegression":
            found.append(_reports(keyed.logistic_predictions(every, stage(keyed.logistic_models(train), "models")), kind))
        elif kind == "decisionTree":
            found.append(_reports(keyed.tree_predictions(every, stage(keyed.tree_models(train), "trees")), kind))
        else:
            for r in train.select("model").distinct().orderBy("model").collect():  # components times folds
                mine = stage(learn.counted(every.where(F.col("model") == r["model"]), "x", ["model", "cohort"]), "mine")
                model = learn.fit(mine.where("cohort = 'train'"), "x", kind, "n")
                found.append(_reports(learn.predictions(model, mine, "x"), kind, "n"))
    return reports.fold_mean(reduce(DataFrame.unionByName, found), ["component", "features", "model", "cohort"])


def _reports(scored: DataFrame, kind: str, times: str | None = None) -> DataFrame:
    """A report of each model and cohort, with its component, features and fold."""
    part = lambda i: F.split("_key", "/")[i]
    found = reports.classification_report(scored, ["model", "cohort"], times).withColumnRenamed("model", "_key")
    return found.withColumns({"component": part(0).cast("long"), "features": part(1), "fold": part(2).cast("int"), "model": F.lit(kind)}).drop("_key")
