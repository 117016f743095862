"""Encode labelled documents by the interaction network of their text measurements.

    python jobs/text_network.py --documents TABLE --labels TABLE --output DIR [--config FILE]

Whole texts are measured and cut into three-valued codes. Training documents (all folds but 0) give
the gain of every pair of codes about the label; pairs over a threshold are a network, of which large
components stay. Every document, training or test, is then described by its signed degrees in that
network, learnt from training documents only. OUTPUT/network is partitioned by component,
OUTPUT/subjects by cohort; a rerun writes the same rows again.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from genoloom.operators import graph, pairs, splits  # noqa: E402
from genoloom.scratch import stage  # noqa: E402

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "text_network.json")
log = logging.getLogger("text_network")

WORD = r"[^\x20\x09-\x0D]+"
#: Measurements of a text t (not null) with the words w, as whole numbers.
MEASURES = {
    "words": "size(w)",
    "word_chars": rf"length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ''))",
    "digits": "length(t) - length(regexp_replace(t, '[0-9]', ''))",
    "symbols": "length(t) - length(regexp_replace(t, '[#*$%&|<>]', ''))",
    "capitals": "length(t) - length(regexp_replace(t, '[A-Z]', ''))",
    "stops": "length(t) - length(regexp_replace(t, '[.!?]', ''))",
    "lines": "length(t) - length(replace(t, '\\n', ''))",
    "distinct_words": "size(array_distinct(w))",
}


def coded(documents: DataFrame, features: dict) -> DataFrame:
    """(doc_id, g): the code of each feature is the number of its cuts that its ratio reaches.

    A null text is empty; a ratio to no words is one to one word.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(WORD), 0))
    rows = rows.select("doc_id", *[F.expr(e).cast("long").alias(name) for name, e in MEASURES.items()])

    def code(f: dict):
        ratio = F.col(f["of"]).cast("double") / F.greatest(F.expr(f["per"]).cast("double"), F.lit(1.0))
        return sum((F.when(ratio >= cut, 1).otherwise(0) for cut in f["cuts"]), F.lit(0))

    return rows.select("doc_id", F.array(*[code(f) for f in features.values()]).cast("array<int>").alias("g"))


#: Labels whose ids are broadcast, so that other documents are not measured; with more, all are.
LABELS = 1_000_000


def labelled(documents: DataFrame, known: DataFrame) -> DataFrame:
    """The documents that have a label, their texts left where they are; all of them if labels are many."""
    if known.limit(LABELS + 1).count() > LABELS:
        return documents
    return documents.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict) -> tuple[DataFrame, DataFrame]:
    """(OUTPUT/network, OUTPUT/subjects) as written.

    Documents without a label of 0 or 1, and labels without a document, are left out; a null id has
    no label. Repeated rows are subjects of their own.
    """
    names, docs = list(config["features"]), spark.read.parquet(documents)
    known = spark.read.parquet(labels).select("doc_id", F.expr(config["label"]).cast("int").alias("label")).where("label IN (0, 1)")
    rows = coded(labelled(docs, known), config["features"]).join(known, "doc_id").select(F.col("doc_id").alias("sid"), "label", "g")
    rows = stage(splits.kfold(stage(rows, "coded"), config["folds"], config["seed"], by=["label"]), "folds")
    log.info("read %d documents from %s; %d have a label in %s", docs.count(), documents, rows.count(), labels)
    train = rows.where("fold <> 0")
    gains = pairs.pair_gains(train, len(names)).withColumn("ig", F.round("ig", 9)).where(F.col("ig") >= config["threshold"])
    edges = stage(gains.select("f1", "f2", "ig"), "network")
    nodes = graph.large_components(edges, config["smallest_component"], "f1", "f2")
    edges = graph.component_edges(edges, nodes, "f1", "f2").select(F.col("rank").cast("int").alias("component"), "f1", "f2", "ig")
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c)).alias(c)
    network = _written(edges.select("component", name("f1"), name("f2"), "ig"), "component", f"{output}/network")
    edges = stage(edges, "edges")
    cohort = F.when(F.col("fold") == 0, "test").otherwise("train").alias("cohort")
    subjects = rows.withColumn("sid", F.struct(cohort, "sid"))
    degrees = pairs.delta_degrees(subjects, edges, pairs.cell_signs(train, edges), len(names))
    subjects = degrees.select("sid.cohort", F.col("sid.sid").alias("doc_id"), "label", *[F.get("dd", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return network, _written(subjects, "cohort", f"{output}/subjects")


def _written(rows: DataFrame, by: str, path: str) -> DataFrame:
    rows.write.mode("overwrite").partitionBy(by).parquet(path)
    found = rows.sparkSession.read.schema(rows.schema).parquet(path)
    log.info("wrote %d rows to %s", found.count(), path)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    with open(given.config) as file:
        config = json.load(file)
    spark = SparkSession.builder.appName("text_network").getOrCreate()
    try:
        run(spark, given.documents, given.labels, given.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
