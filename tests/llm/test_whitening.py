"""Whitening against numpy on integers and 64-bit floats, and on odd tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from genoloom.llm import queries, whitening


def by_hand(vectors):
    """(n, deviations by x, covariance of the fit list, its eigenvalues and vectors, mean) in plain Python and numpy."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    distinct = sorted(set(x))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    deviation = {v: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in distinct}
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in distinct])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, n, deviation, values[::-1], components[:, ::-1], dict(zip(distinct, centred, strict=True)), np.trace(centred.T @ centred) / n


def check(found, rows, most=16):
    vectors = {i: v for i, v in rows}
    x, n, deviation, values, components, centred, trace = by_hand(list(vectors.values()))
    x = dict(zip(vectors, x, strict=True))
    assert len(found) == len(rows) * min(most, len(values))
    sign = {}
    for r in found:
        k = r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, deviation[x[r["vec_id"]]])
        assert abs(r["explained"] - values[k] / trace) <= 1e-9 * values[k] / trace and r["identity_error"] < 1e-8
        want = centred[x[r["vec_id"]]] @ components[:, k] / math.sqrt(values[k])
        if abs(want) > 1e-3:
            sign.setdefault(k, np.sign(want * r["whitened"]))
            assert abs(sign[k] * r["whitened"] - want) < 1e-6


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = queries.QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(out.collect(), good)


def test_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, k + 1) for k in range(5)]) for i in range(200)]
    good += [(300 + i, good[0][1]) for i in range(50)]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 5), (1004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (1005, [1.0]), (1006, [1e300, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit(2), "component": F.lit("c"), "_v": F.lit(0)})
    check(whitening.whiten(table.repartition(7)).collect(), good)
    assert {r["component"] for r in whitening.whiten(table, most=2).collect()} == {1, 2}


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(20)]
    table = spark.createDataFrame([(None, v) for v in vectors] + [("same", v) for v in vectors[:4]], "vec_id string, embedding array<float>")
    found = whitening.whiten(table).collect()
    assert len(found) == 24 * 3 and {r["n"] for r in found} == {20}
    assert sum(r["vec_id"] is None for r in found) == 60


def test_few_directions(spark):
    """Directions without variance have no component; one vector or none gives no rows."""
    line = spark.createDataFrame([(i, [float(i), float(2 * i), 5.0]) for i in range(30)], "vec_id long, embedding array<double>")
    found = whitening.whiten(line).collect()
    assert {r["component"] for r in found} == {1} and abs(found[0]["explained"] - 1) < 1e-12
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).collect() == []
    empty = whitening.whiten(one.limit(0))
    assert empty.collect() == [] and empty.columns == whitening.whiten(line).columns


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(3, [10, 2**60], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    x = np.array([[5, -(2**40)], [2**61, 7]])
    assert model.deviation(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
