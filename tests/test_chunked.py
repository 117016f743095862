"""Studies in chunks: only what is missing or partial runs, and the result is that of one study."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from genoloom import scratch, sources
from genoloom.operators import chunked, search
from genoloom.plans import files


def matrix(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, rng.randrange(2), [rng.randrange(3) for _ in range(4)]) for i in range(120)], "sid long, label int, g array<int>")


def test_a_study_resumes(spark, tmp_path):
    m, path = matrix(spark), str(tmp_path / "study")
    run = lambda only=None: chunked.permutation_study(m, 4, 6, 3, 7, path, only)
    assert run([1])[1] == [1]
    states = lambda: {r["chunk"]: r["state"] for r in chunked.chunk_states(chunked.results(spark, path, chunked.GAINS), chunked.permutation_plan(spark, 4, 6, 3)).collect()}
    assert states() == {0: "missing", 1: "done", 2: "missing"}
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/chunk=1/*.parquet")}
    assert run()[1] == [0, 2] and run()[1] == []
    shutil.rmtree(f"{path}/chunk=2")
    found, ran = run()
    assert ran == [2] and {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/chunk=1/*.parquet")} == before
    whole = search.permuted_gains(m, 4, 6, 7)
    same = lambda df: sorted((r["perm"], r["f1"], r["f2"], round(r["ig"], 12)) for r in df.collect())
    assert same(found) == same(whole)
    assert chunked.state_counters(chunked.chunk_states(found, chunked.permutation_plan(spark, 4, 6, 3))).first().asDict() == {"done": 3, "partial": 0, "missing": 0, "expected": 36, "found": 36, "complete": True}


def test_a_partial_chunk_runs_again(spark, tmp_path):
    m, path = matrix(spark), str(tmp_path / "study")
    found, _ = chunked.permutation_study(m, 4, 4, 2, 7, path)
    found.where("chunk = 1").limit(5).withColumn("perm", F.lit(99)).write.mode("append").partitionBy("chunk").parquet(path)  # rows too many
    again, ran = chunked.permutation_study(m, 4, 4, 2, 7, path)
    assert ran == [1] and again.count() == 24 and again.where("perm = 99").count() == 0
    with pytest.raises(ValueError):
        chunked.permutation_study(m, 4, 5, 2, 7, path)


def test_a_failed_chunk_leaves_the_others(spark, tmp_path):
    plan = spark.createDataFrame([(0, 2), (1, 2), (2, 2)], "chunk int, expected long")

    def work(k):
        if k == 1:
            raise RuntimeError("lost")
        return spark.range(2).select((F.col("id") + 10 * k).alias("v"))

    shape, path = "v long, chunk int", str(tmp_path / "x")
    with pytest.raises(RuntimeError):
        chunked.resume(spark, path, shape, plan, work)
    assert chunked.resume(spark, path, shape, plan, lambda k: spark.range(2).select((F.col("id") + 10 * k).alias("v"))) == [1, 2]
    assert sorted(r["v"] for r in chunked.results(spark, path, shape).collect()) == [0, 1, 10, 11, 20, 21]


def test_subject_networks_have_a_header_and_cohorts(spark, sf_dir, tmp_path):
    rows = spark.createDataFrame([(0, "Train", 1, [1, -1]), (0, "Test", 0, [0, 2]), (1, "Test", 1, None)], "fold int, cohort string, label int, dd array<int>")
    sources.write_subject_networks(rows, str(tmp_path / "n"), 2)
    assert sorted(os.path.relpath(p, tmp_path / "n") for p in glob.glob(f"{tmp_path}/n/*/*") if "=" in p) == ["fold=0/cohort=Test", "fold=0/cohort=Train", "fold=1/cohort=Test"]
    text = [open(p).read() for p in glob.glob(f"{tmp_path}/n/fold=0/cohort=Train/*.csv")]
    assert text == ["0\t1\tlabel\n1\t-1\t1\n"]
    back = sorted(map(tuple, sources.read_subject_networks(spark, str(tmp_path / "n"), 2).collect()), key=repr)
    assert back == sorted([(0, "Train", 1, [1, -1]), (0, "Test", 0, [0, 2]), (1, "Test", 1, [None, None])], key=repr)
    assert files.subject_network_files(spark, sf_dir).count() > 0


def test_settings_come_back_after_the_last_thread(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "5m")
    try:
        one, two = scratch.scoped(spark), scratch.scoped(spark)
        one.__enter__()
        two.__enter__()
        one.__exit__(None, None, None)
        assert spark.conf.get(key) == scratch.SCOPED[key]
        two.__exit__(None, None, None)
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.unset(key)
