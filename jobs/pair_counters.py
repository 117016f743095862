"""Keep the interaction gains of all feature pairs current, by cohort, as files of subjects arrive.

    python jobs/pair_counters.py --input SUBJECTS --output DIR --checkpoint DIR [--config FILE]

A file stream takes the Parquet files that no earlier run took. Their pair counters go to
OUTPUT/counters, a partition for each micro-batch; OUTPUT/gains, partitioned by cohort, is then
written anew from all counters: the work of a run is that of its new files. A run that ends early is
made good by the next one; a run without new files leaves the same result.
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

from genoloom import streaming  # noqa: E402

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pair_counters.json")
log = logging.getLogger("pair_counters")


def subjects(rows: DataFrame, config: dict) -> DataFrame:
    """(cohort, sid, label, g) by the expressions of the configuration."""
    g = F.array(*[F.expr(e) for e in config["features"].values()])
    return rows.select(F.expr(config["cohort"]).cast("int").alias("cohort"), F.expr(config["id"]).alias("sid"), F.expr(config["label"]).alias("label"), g.cast("array<int>").alias("g"))


def stream_path(table: DataFrame, source: str) -> str:
    """``source`` for a file stream, which takes folders and patterns: a single file is a pattern of itself."""
    one = table.select("_metadata.file_path").limit(1).collect()
    single = one and one[0][0].rpartition("/")[2] == source.rstrip("/").rpartition("/")[2]
    return f"{source[:-1]}[{source[-1]}]" if single else source


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """One run over what is new at ``source``; OUTPUT/gains as it stands after it.

    Rows whose label or code is null or outside its domain are in no counter. A null cohort is a
    cohort. maxFileAge is set so far back that a file with an old date is taken like any other.
    """
    table = spark.read.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d").parquet(stream_path(table, source))
    matrix, names = subjects(stream, config), list(config["features"])
    ran = streaming.keep_counters(matrix, len(names), f"{output}/counters", checkpoint, ["cohort"])
    log.info("read %d new rows in %d batches from %s", sum(n for _, n in ran), len(ran), source)
    counts = streaming.counters(spark, f"{output}/counters", matrix, ["cohort"])
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c)).alias(c)
    gains = streaming.counted_gains(counts, ["cohort"])
    gains = gains.select("cohort", name("f1"), name("f2"), *[c for c in gains.columns if c not in ("cohort", "f1", "f2")])
    shape = gains.schema
    gains.write.mode("overwrite").partitionBy("cohort").parquet(f"{output}/gains")
    found = spark.read.schema(shape).parquet(f"{output}/gains")
    log.info("wrote %d rows to %s/gains", found.count(), output)
    return found


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    with open(given.config) as file:
        config = json.load(file)
    spark = SparkSession.builder.appName("pair_counters").getOrCreate()
    try:
        run(spark, given.input, given.output, given.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
