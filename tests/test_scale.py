"""Bitmaps, ranges of combinations, forests and permutation products against plain Python and numpy."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoloom.operators import bitmaps, dealt, forest, graph, search
from genoloom.operators.pairs import pair_gains
from genoloom.plans import scale


def matrix_rows(n, width, seed, odd=True):
    """Subjects with codes 0, 1, 2 and (odd) nulls, other codes, short and null rows, other labels."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        g = [rng.choice([0, 0, 1, 2, None, 5] if odd and rng.random() < 0.3 else [0, 1, 2]) for _ in range(width)]
        rows.append((i, rng.choice([0, 1, 1, 2, None] if odd else [0, 1]), None if odd and i == 7 else g[: width // 2] if odd and i == 8 else g))
    return rows


MATRIX = "sid long, label int, g array<int>"


@pytest.mark.parametrize("block,group,rows", [(None, None, None), (3, None, 64), (5, 1 << 10, 64), (40, 1 << 12, 64)])
def test_block_gains_are_pair_gains(spark, monkeypatch, block, group, rows):
    """Blocks, parts and segments of any size give the same pairs."""
    for name, value in (("GROUP_BYTES", group), ("ROWS", rows)):
        if value:
            monkeypatch.setattr(bitmaps, name, value)
    m = spark.createDataFrame(matrix_rows(700, 17, 1), MATRIX).repartition(3)
    want = {(r["f1"], r["f2"]): r for r in pair_gains(m, 17).collect() if r["ig"] >= 0.001}
    got = bitmaps.block_gains(m, 17, 0.001, block).collect()
    assert len(got) == len(want) and 0 < len(want) < 136
    for r in got:
        assert all(abs(r[c] - want[r["f1"], r["f2"]][c]) < 1e-12 for c in ("ig", "mi", "main_f1", "main_f2"))


def test_block_gains_read_the_matrix_once_and_keep_nothing_else(spark):
    m = spark.createDataFrame(matrix_rows(300, 12, 2), MATRIX)
    assert bitmaps.block_gains(m, 12, 10.0).count() == 0
    assert bitmaps.block_gains(m.limit(0), 12, -1.0).count() == 0
    assert bitmaps.block_gains(m.where("label = 1"), 12, -1.0).count() == 0
    assert bitmaps.vertical(m, 12, 5).select("block").distinct().count() == 3


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_block_gains_move_no_bitmap_if_counters_fit_and_else_each_a_few_times(spark, monkeypatch, most):
    """What is shuffled grows no faster than the rows: blocks keep their columns however many there are."""
    monkeypatch.setattr(bitmaps, "COUNTERS", most)
    monkeypatch.setattr(bitmaps, "GROUP_BYTES", 1 << 12)
    m = spark.createDataFrame(matrix_rows(700, 80, 3), MATRIX).repartition(3)
    found = bitmaps.block_gains(m, 80, 0.02)
    want = {(r["f1"], r["f2"]): r["ig"] for r in pair_gains(m, 80).collect() if r["ig"] >= 0.02}
    assert {(r["f1"], r["f2"]): r["ig"] for r in found.collect()} == pytest.approx(want, abs=1e-12) and want
    assert ("partner" in found._jdf.queryExecution().analyzed().toString()) == (not most)
    assert bitmaps.block_of(80) == 20


@given(st.integers(1, 9), st.integers(1, 9), st.data())
@settings(max_examples=150, deadline=None)
def test_ranks_are_those_of_itertools(n, k, data):
    k = min(n, k)
    every = list(itertools.combinations(range(n), k))
    assert [tuple(bitmaps.unrank(i, n, k)) for i in range(len(every))] == every
    a = data.draw(st.integers(0, len(every)))
    b = data.draw(st.integers(a, len(every)))
    assert [(*p, j) for p, first, end in bitmaps.runs(a, b, n, k) for j in range(first, end)] == every[a:b]
    nodes = data.draw(st.integers(1, 12))
    ranges = bitmaps.rank_ranges(n, k, nodes)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(every)))
    assert max(b - a for a, b in ranges) - min(b - a for a, b in ranges) <= 1


def test_unranking_of_many():
    n, k = 500_000, 3
    for rank in (0, 1, 10**12, math.comb(n, k) - 1):
        a, b, c = bitmaps.unrank(rank, n, k)
        assert math.comb(n, 3) - math.comb(n - a, 3) + math.comb(n - a - 1, 2) - math.comb(n - b, 2) + c - b - 1 == rank


@pytest.mark.parametrize("odd,group,nodes", [(False, None, None), (True, None, 5), (True, 1 << 9, 3)])
def test_bitmap_search_is_the_search(spark, monkeypatch, odd, group, nodes):
    if group:
        monkeypatch.setattr(bitmaps, "GROUP_BYTES", group)
        monkeypatch.setattr(bitmaps, "ROWS", 64)
    rows = [(i, y, None if g is None else [None if c == 5 else c for c in g]) for i, y, g in matrix_rows(400, 7, 3, odd)]
    m = spark.createDataFrame(rows, MATRIX).repartition(3)
    plain = {r["attributes"]: r for r in search.kway_models(m, 7, [1, 2, 4]).collect()}
    found = bitmaps.kway_bits(m, 7, [1, 2, 4], nodes).collect()
    assert len(found) == len(plain) == 7 + 21 + 35
    for r in found:
        assert r["n_attributes"] == plain[r["attributes"]]["n_attributes"]
        assert abs(r["balanced_accuracy"] - plain[r["attributes"]]["balanced_accuracy"]) < 1e-12


def test_nodes_run_alone(spark):
    m = spark.createDataFrame(matrix_rows(200, 9, 4, False), MATRIX)
    every = {r["attributes"]: (list(r["ctl"]), list(r["cas"])) for r in bitmaps.kway_counts(m, 9, 3, 4).collect()}
    apart = [r for node in range(4) for r in bitmaps.kway_counts(m, 9, 3, 4, [node]).collect()]
    assert {r["attributes"]: (list(r["ctl"]), list(r["cas"])) for r in apart} == every and len(apart) == 84
    codes = {i: g for i, _, g in matrix_rows(200, 9, 4, False)}
    cases = [i for i, y, _ in matrix_rows(200, 9, 4, False) if y == 1]
    want = Counter(9 * codes[i][0] + 3 * codes[i][4] + codes[i][8] for i in cases)
    assert every["0,4,8"][1] == [want[c] for c in range(27)]


# ---------------------------------------------------------------- forests


def union_find(nodes, edges):
    above = {n: n for n in nodes}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        above[root(a)] = root(b)
    return {n: min(m for m in nodes if root(m) == root(n)) for n in nodes}


def random_network(seed, n=60, m=150):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", rng.choice([0.1, 0.2, 0.3, 0.4, 0.5])) for _ in range(m)]
    return rows + rows[:5] + [("hub", f"n{i:02}", 0.3) for i in range(n // 2)] + [("alone", "alone", 0.4)]


@pytest.mark.parametrize("last", [200_000, 0])
def test_forest_keeps_every_threshold_apart(spark, monkeypatch, last):
    monkeypatch.setattr(forest, "LAST", last)
    rows = random_network(1)
    odd = [(None, "n01", 0.5), ("n01", "n02", None), ("n01", "n03", float("nan"))]
    found = forest.maximum_spanning_forest(spark.createDataFrame(rows + odd, "a string, b string, ig double").repartition(4), "ig").collect()
    nodes = {x for a, b, _ in rows for x in (a, b)}
    assert len(found) <= len(nodes) - 1 and all(r["a"] < r["b"] for r in found)
    for th in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6):
        assert union_find(nodes, [(a, b) for a, b, w in rows if w >= th]) == union_find(nodes, [(r["a"], r["b"]) for r in found if r["ig"] >= th])


def test_forest_of_a_path_and_of_nothing(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    assert forest.maximum_spanning_forest(path, "w").count() == 300
    assert forest.maximum_spanning_forest(path.limit(0), "w").count() == 0


def test_thresholds_from_the_forest_are_those_of_the_sweep(spark):
    edges = spark.createDataFrame(random_network(2), "a string, b string, ig double")
    ths = [0.15, 0.3, 0.45, 0.9]
    nodes = forest.threshold_nodes(edges, "ig", ths)
    stats, tagged = graph.sweep_statistics(edges, "ig", ths)
    order = stats.columns
    assert sorted(map(tuple, forest.threshold_statistics(nodes).select(order).collect())) == sorted(map(tuple, stats.collect()))
    same = lambda a, b: sorted((r["th"], r["degree"], r["n"]) for r in a.collect()) == sorted((r["th"], r["degree"], r["n"]) for r in b.collect())
    assert same(forest.degree_shares(nodes), graph.degree_histogram(tagged, ["th"]))
    assert same(forest.degree_shares(forest.in_largest(nodes)), graph.degree_histogram(tagged.where("in_lc"), ["th"]))


def test_sweeps_keep_what_union_find_keeps(spark):
    rows = random_network(3)
    got = {(r["th"], r["at_least"]): (r["components"], r["nodes"], r["edges"]) for r in forest.kept_components(forest.threshold_nodes(spark.createDataFrame(rows, "a string, b string, ig double"), "ig", [0.2, 0.5]), [1, 3, 99]).collect()}
    want = {}
    for th in (0.2, 0.5):
        edges = [(a, b) for a, b, w in rows if w >= th]
        of = union_find({x for e in edges for x in e}, edges)
        sizes = Counter(of.values())
        for least in (1, 3, 99):
            kept = {c for c, n in sizes.items() if n >= least}
            if kept:
                want[th, least] = (len(kept), sum(sizes[c] for c in kept), sum(of[a] in kept for a, _ in edges))
    assert got == want


# ---------------------------------------------------------------- permutations


def test_a_thousand_permutations_by_products(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 1 << 20)  # several scans
    m = spark.createDataFrame([r for r in matrix_rows(150, 6, 5) if r[1] is not None], MATRIX).repartition(3)
    labels = {r["sid"]: (r["g"], r["labels"]) for r in search.permuted_labels(m, 1000, 7, 40).collect()}
    found = {(r["perm"], r["f1"], r["f2"]): r for r in search.permuted_gains(m, 6, 1000, 7, 40).collect()}
    assert len(found) == 1000 * 15
    for perm in (0, 1, 500, 999):
        shuffled = spark.createDataFrame([(i, x[perm], g) for i, (g, x) in labels.items()], MATRIX)
        for r in pair_gains(shuffled, 6).collect():
            assert abs(found[perm + 40, r["f1"], r["f2"]]["ig"] - r["ig"]) < 1e-12
    assert search.permuted_gains(m.limit(0), 6, 3, 7).count() == 0
    assert np.isfinite([r["mi"] for r in found.values()]).all()


@pytest.mark.parametrize("leading", [8, 1])
def test_values_dealt_in_ranges_and_chunks(spark, monkeypatch, leading):
    """Ranges of hashes, chunks of ranks, hashes that tie: the order stays that of md5."""
    for name, value in (("BUCKET", 30), ("CHUNK", 16), ("LEADING", leading)):
        monkeypatch.setattr(dealt, name, value)
    rows = [(i * 10**9, i % 2, [i % 3, i // 3 % 3]) for i in range(200)]
    taken = [[0, 1], [2], [1, 0]]
    codes = F.concat(F.col("g"), F.array("label"))
    m = spark.createDataFrame(rows, MATRIX).repartition(3)
    runs = dealt.dealt(m, 3, codes, F.col("label"), 5, ["place", "0", "long" * 20], taken)
    got = {}
    for r in runs.orderBy("k", "c", "at").collect():
        planes = dealt._unpacked(bytes(r["codes"]), r["n"], len(taken[r["k"]]))
        assert r["at"] == len(got.setdefault((r["k"], r["c"]), []))
        got[r["k"], r["c"]] += [tuple(map(int, x)) for x in planes.T]
    for k, name in enumerate(["place", "0", "long" * 20]):
        for c in (0, 1):
            order = sorted((hashlib.md5(f"5:{name}:{i}".encode()).hexdigest(), [*g, y]) for i, y, g in rows if y == c)
            assert got[k, c] == [tuple(x[j] for j in taken[k]) for _, x in order]
    # Chunks hold the same ranks of every sequence.
    seen = [(c, [x.shape[1] for x in codes]) for c, codes in dealt.chunks(iter(pa.Table.from_pandas(dealt.chunked(runs, taken).toPandas()).to_batches()), taken)]
    assert sorted(seen) == sorted((c, [n] * 3) for c in (0, 1) for n in [16] * 6 + [4])


def test_rows_of_one_row_group_are_hashed_by_all_cores(spark, tmp_path, monkeypatch):
    path, seen, runs = str(tmp_path / "one"), [], dealt._runs
    spark.range(200_000).selectExpr("id AS sid", "CAST(id % 2 AS INT) AS label", "array(CAST(id % 3 AS INT)) AS g").coalesce(1).write.parquet(path)
    monkeypatch.setattr(dealt, "_runs", lambda rows, *a: seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]) or runs(rows, *a))
    m = spark.read.parquet(path)
    found = dealt.dealt(m, 1, F.col("g"), F.col("label"), 5, ["0", "1"], [[0], [0]])
    assert found.agg(F.sum("n")).first()[0] == 400_000
    assert sum(seen[0]) == 200_000 and max(seen[0]) * spark.sparkContext.defaultParallelism < 2 * 200_000


def test_matrix_of_a_resumed_study_is_written_by_all_cores(spark, monkeypatch):
    """Each chunk of the study reads it again, so one large file would be read by one task each time."""

    class Seen(Exception):
        pass

    def stage(rows, name):
        raise Seen([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])

    monkeypatch.setattr(scale, "stage", stage)
    with pytest.raises(Seen) as seen:
        scale.interrupted(spark, "/root/testdata/sf0.1")  # one row group
    parts = seen.value.args[0]
    assert sum(parts) == 150_000 and max(parts) * spark.sparkContext.defaultParallelism < 2 * 150_000
