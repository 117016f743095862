"""The two jobs: against SQL, over growing input, after failures, with odd rows, from the command line."""

import glob
import json
import os
import subprocess
import sys

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from genoloom.operators.pairs import pair_gains
from jobs import pair_counters, text_network
from jobs.queries import COUNTERS, JOB1_SQL, JOB2_SQL, NETWORK, job1_pair_counters, job2_text_network


def test_pair_counters_twin(spark, sf_dir, duck):
    same_rows(job1_pair_counters(spark, sf_dir), duck, JOB1_SQL)


def test_text_network_twin(spark, sf_dir, duck):
    same_rows(job2_text_network(spark, sf_dir), duck, JOB2_SQL)
    assert duck.execute(f"SELECT count(*) FILTER (section = 'network') > 3, count(DISTINCT cohort) = 2 FROM ({JOB2_SQL})").fetchone() == (True, True)


def rows(df):
    return sorted(df.select(sorted(df.columns)).collect(), key=repr)


def expected(spark, source):
    matrix = pair_counters.subjects(spark.read.parquet(source), COUNTERS)
    names = F.array(*[F.lit(n) for n in COUNTERS["features"]])
    found = pair_gains(matrix, len(COUNTERS["features"]), ["cohort"])
    return found.select("cohort", F.get(names, "f1").alias("f1"), F.get(names, "f2").alias("f2"), F.round("ig", 9).alias("ig"))


@pytest.fixture
def growing(spark, sf_dir, tmp_path):
    """A folder of order files that grows a part at a time; odd rows are in the first part."""
    source, orders = str(tmp_path / "orders"), spark.read.parquet(f"{sf_dir}/orders.parquet")

    def grow(part):
        mine = orders.where(F.col("o_orderkey") % 3 == part)
        if part == 0:
            odd = mine.limit(4).withColumns({"o_orderdate": F.lit(None).cast(mine.schema["o_orderdate"].dataType), "o_orderpriority": F.lit(None).cast("string")})
            mine = mine.unionByName(odd).unionByName(mine.limit(5)).unionByName(mine.limit(3).withColumn("o_orderstatus", F.lit(None).cast("string")))
        mine.coalesce(1).write.mode("append").parquet(source)
        return mine.count()

    return source, grow


def test_two_runs_over_growing_input(spark, tmp_path, growing):
    source, grow = growing
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run = lambda: pair_counters.run(spark, source, out, checkpoint, COUNTERS)
    same = lambda: rows(run().select("cohort", "f1", "f2", F.round("ig", 9).alias("ig"))) == rows(expected(spark, source))
    grow(0)
    assert same()
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/counters/batch=*/*")}
    new = grow(1)
    os.utime(max(glob.glob(f"{source}/*.parquet"), key=os.path.getmtime), (10**9, 10**9))  # an old date is no reason to skip a file
    assert same()
    after = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/counters/batch=*/*")}
    assert before.items() <= after.items() and len({os.path.dirname(p) for p in after}) == 2
    assert sum(len(f) for f in [glob.glob(f"{checkpoint}/commits/[0-9]*")]) == 2 and new > 0
    assert same() and {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/counters/batch=*/*")} == after


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, growing):
    source, grow = growing
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in range(2):
        grow(part)
        first = rows(pair_counters.run(spark, source, out, checkpoint, COUNTERS))
    for p in [*glob.glob(f"{checkpoint}/commits/1"), *glob.glob(f"{checkpoint}/commits/.1.crc")]:
        os.remove(p)  # as if the driver was lost after it wrote the counters
    grow(2)
    again = rows(pair_counters.run(spark, source, out, checkpoint, COUNTERS))
    by_pair = lambda found, ig: {(r["cohort"], r["f1"], r["f2"]): r[ig] for r in found}
    assert again != first and {k: round(v, 9) for k, v in by_pair(again, "ig").items()} == by_pair(expected(spark, source).collect(), "ig")


def test_no_input_yet(spark, sf_dir, tmp_path):
    source = str(tmp_path / "orders")
    spark.read.parquet(f"{sf_dir}/orders.parquet").limit(0).write.parquet(source)
    assert pair_counters.run(spark, source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), COUNTERS).collect() == []


def test_text_network_odd_rows_and_reruns(spark, sf_dir, tmp_path):
    docs, labels, out = (str(tmp_path / n) for n in ("documents", "labels", "out"))
    real, known = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "no id"), (10**9 + 2, "x " * 200_000)], "doc_id long, text string")
    real.unionByName(odd, allowMissingColumns=True).withColumn("label", F.lit("clash")).write.parquet(docs)
    more = spark.createDataFrame([(10**9 + i, i % 2) for i in range(3)] + [(None, 1), (10**9 + 7, 1), (0, None)], "doc_id long, quality int")
    known.unionByName(more, allowMissingColumns=True).write.parquet(labels)
    first = [rows(x) for x in text_network.run(spark, docs, labels, out, NETWORK)]
    assert [rows(x) for x in text_network.run(spark, docs, labels, out, NETWORK)] == first
    got = {r["doc_id"] for r in first[1]}
    assert {10**9, 10**9 + 1, 10**9 + 2} <= got and None not in got and 10**9 + 7 not in got
    assert sorted(os.listdir(f"{out}/subjects"))[-2:] == ["cohort=test", "cohort=train"]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_text_network_measures_labelled_documents_only(spark, sf_dir, tmp_path, monkeypatch, most):
    monkeypatch.setattr(text_network, "LABELS", most, raising=False)
    seen, coded = [], text_network.coded
    monkeypatch.setattr(text_network, "coded", lambda docs, features: seen.append(docs.count()) or coded(docs, features))
    docs, labels = (f"{sf_dir}/{n}.parquet" for n in ("documents", "labels"))
    text_network.run(spark, docs, labels, str(tmp_path / "out"), NETWORK)
    every, known = spark.read.parquet(docs), spark.read.parquet(labels).where("1 - quality IN (0, 1)")
    some = every.join(known, "doc_id", "left_semi").count()
    assert seen == [some if most else every.count()] and some < every.count()


def test_text_network_without_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents"))
    network, subjects = text_network.run(spark, str(tmp_path / "documents"), f"{sf_dir}/labels.parquet", str(tmp_path / "out"), NETWORK)
    assert network.count() == subjects.count() == 0


@pytest.mark.parametrize("job", ["pair_counters", "text_network"])
def test_command_line(job, sf_dir, tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    config = json.load(open(f"{top}/jobs/{job}.json"))
    config["features"] = dict(list(config["features"].items())[:3])
    (tmp_path / "config.json").write_text(json.dumps(config))
    tables = {"pair_counters": ["--input", f"{sf_dir}/orders.parquet", "--checkpoint", f"{tmp_path}/checkpoint"], "text_network": ["--documents", f"{sf_dir}/documents.parquet", "--labels", f"{sf_dir}/labels.parquet"]}[job]
    done = subprocess.run([sys.executable, f"{top}/jobs/{job}.py", *tables, "--output", f"{tmp_path}/out", "--config", str(tmp_path / "config.json")], capture_output=True, text=True, timeout=240, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert " wrote " in done.stderr and " read " in done.stderr
    assert os.listdir(tmp_path / "out")
