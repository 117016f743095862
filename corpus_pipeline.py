"""A corpus pipeline of five operators: quality rules, line dedup, near-copies, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, written as Parquet and read again as the next stage's ``docs``. Verdicts are on rows, not
on ids: rows with a null id, an id that other texts have, or copies of a row are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from genoloom.llm.queries import RANKS, VOCABULARY, vocabulary
from genoloom.scratch import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules' label model keeps (a null text has no words and goes)."""
    return quality_rules.quality(docs, columns=COLUMNS).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated three-line windows; emptied ones go, null texts stay."""
    cut = line_dedup.dedup_lines(docs)
    cut = cut.where("text IS NULL OR n_removed = 0 OR text <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-copy component: of those with the smallest id (null last) any one.

    A text without words is a component of its own in every row, so each such row stays. Rows are told
    apart by a hash of all columns; different rows of one hash (a second one says so) stay as they are.
    """
    tagged = docs.select(*COLUMNS).withColumns({"_tag": F.xxhash64(*COLUMNS), "_other": F.xxhash64(F.lit(1), *COLUMNS)})
    found = jaccard_join.jaccard_components(tagged, id_col="_tag").groupBy("doc_id", "n_shingles", "component_id").agg(F.count(F.lit(1)).alias("rows"))
    ids = tagged.groupBy(F.col("_tag").alias("doc_id")).agg(F.min("doc_id").alias("_id"), (F.min("_other") != F.max("_other")).alias("_mixed"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", F.col("doc_id").alias("_tag"), "n_shingles", "rows"))
    named = stage(found.join(ids, "doc_id"), "named")
    kept = named.where("NOT _mixed").groupBy("component_id").agg(first.alias("first")).select("first._tag", F.expr("first.n_shingles > 0 AND first.rows > 1").alias("_many"))
    kept = kept.unionByName(named.where("_mixed").select(F.col("doc_id").alias("_tag"), F.lit(False).alias("_many")).distinct())
    rows = tagged.join(kept, "_tag")
    # Of equal rows one stays, but for those without words.
    return rows.where("NOT _many").select(*COLUMNS).unionByName(rows.where("_many").select(*COLUMNS).dropDuplicates())


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.hits(decontaminate.find_contamination(docs, items)).where("NOT contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, read back from the padded sequences that hold them."""
    pieces = packing.pack(docs, vocabulary(VOCABULARY), vocabulary(RANKS), with_ids=True)
    return packing.digests(packing.sequences(pieces), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", clean_of_benchmarks), ("packing", packed)]

#: The label model of the first stage can't be stated in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
