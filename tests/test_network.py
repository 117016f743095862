"""The network engine against plain Python, and its edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from genoloom import functions as fn
from genoloom import sources
from genoloom.operators import graph, hot, learn, order, pairs, reports, search, splits
from genoloom.plans.study import study
from genoloom.scratch import stage
from genoloom.streaming import streamed_cells

M = "sid long, label int, g array<int>"


def gains_by_loop(rows, i, j):
    n = np.zeros((2, 3, 3))
    for _, label, g in rows:
        if label in (0, 1) and g[i] in (0, 1, 2) and g[j] in (0, 1, 2):
            n[label, g[i], g[j]] += 1
    if not n[1].sum():
        return 0.0, 0.0
    n[0] *= n[1].sum() / n[0].sum()
    total = n.sum()

    def left(parts):
        return sum((a + b) / total * -sum(x / (a + b) * math.log2(x / (a + b)) for x in (a, b)) for a, b in parts if a > 0 and b > 0)

    mi, one, two = (1 - left(zip(n[0].sum(axis=a).ravel(), n[1].sum(axis=a).ravel(), strict=True)) if a is not None else 1 - left(zip(n[0].ravel(), n[1].ravel(), strict=True)) for a in (None, 1, 0))
    return mi - one - two, mi


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for s in range(400):
        g = [rng.choice([0, 1, 2, 2, 9, None]) if rng.random() < 0.1 else rng.randrange(3) for _ in range(4)]
        out.append((s, rng.choice([0, 1, 1, 7, None]) if rng.random() < 0.1 else int(((g[0] or 0) + (g[1] or 0)) % 3 == 0), g))
    return out


def test_gain_matches_a_loop(spark, rows):
    found = {(r.f1, r.f2): r for r in pairs.gain(pairs.pair_cells(spark.createDataFrame(rows, M), 4)).collect()}
    for (i, j), r in found.items():
        assert (r.ig, r.mi) == pytest.approx(gains_by_loop(rows, i, j), abs=1e-12)
        assert r.mi - r.ig == pytest.approx(r.main_f1 + r.main_f2) and -1e-12 <= r.mi <= 1 + 1e-12
    assert max(found, key=lambda k: found[k].ig) == (0, 1) and len(found) == 6


def test_many_features_and_blocks_use_the_same_counts(spark):
    rng = random.Random(5)
    m = spark.createDataFrame([(s, rng.randrange(2), [rng.randrange(3) for _ in range(14)]) for s in range(60)], M)
    wide = {tuple(r) for r in pairs.pair_cells(m, 14).where("f1 < 2 AND f2 >= 2").collect()}
    assert wide == {tuple(r) for r in pairs.pair_cells(m, 14, left=range(2), right=range(2, 14)).collect()}


def test_gain_without_cases_or_controls_or_rows(spark):
    cells = lambda label: pairs.pair_cells(spark.createDataFrame([(1, label, [0, 1])], M), 2)
    assert pairs.gain(cells(0)).first()[2:4] == (0.0, 0.0)
    assert math.isnan(pairs.gain(cells(1)).first().ig)
    assert pairs.gain(cells(None)).count() == 0


def test_sparse_models_reject_unknown_labels(spark):
    with pytest.raises(PySparkException):
        pairs.sparse_models(spark.createDataFrame([(1, 0, [0, 1])], M), 2).collect()


def test_delta_degrees_match_a_recount(spark, rows):
    rows = [r for r in rows if r[1] in (0, 1)]
    train, test = rows[100:], rows[:100]
    edges = [(0, 1), (1, 2), (0, 1), (3, 3)]
    e = spark.createDataFrame(edges, "f1 int, f2 int")
    signs = pairs.cell_signs(spark.createDataFrame(train, M), e)
    got = {r.sid: r.dd for r in pairs.delta_degrees(spark.createDataFrame(test, M), e, signs, 4).collect()}
    ratio = sum(r[1] == 1 for r in train) / sum(r[1] == 0 for r in train)
    for sid, _, g in test:
        want = [0] * 4
        for i, j in edges:
            n = [sum(r[1] == label and None not in (g[i], g[j]) and r[2][i] == g[i] and r[2][j] == g[j] for r in train) for label in (0, 1)]
            s = 1 if n[0] * ratio >= n[1] else -1
            want[i] += s
            want[j] += s
        assert got[sid] == want
        assert all(abs(d) <= k and (d - k) % 2 == 0 for d, k in zip(want, [2, 3, 1, 2], strict=True))


@pytest.mark.parametrize("tabled", [pairs.TABLED, 0])
def test_delta_degrees_of_any_codes_are_looked_up_in_batches(spark, monkeypatch, tabled):
    """No row goes through a map or a join of its own; -1 is a code, null is none."""
    monkeypatch.setattr(pairs, "TABLED", tabled)
    codes = [-1, 0, 7, 2**31 - 1, None]
    m = spark.createDataFrame([(5 * i + j, 0, [a, b]) for i, a in enumerate(codes) for j, b in enumerate(codes)] + [(99, 0, [-1])], M)
    minus = [(0, 1, -1, 7), (0, 1, 2**31 - 1, -1), (1, 5, 0, 0)]
    signs = spark.createDataFrame([(*c, -1) for c in minus] + [(0, 1, 0, 0, 1)], "f1 int, f2 int, v1 int, v2 int, sign int")
    found = pairs.delta_degrees(m, spark.createDataFrame([(0, 1), (0, 1), (1, 5)], "f1 int, f2 int"), signs, 2)
    want = {r.sid: (-2 if (0, 1, *r.g) in minus else 2) for r in m.collect()}
    assert {r.sid: r.dd for r in found.collect()} == {sid: [n, n + 1] for sid, n in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan


def test_classifiers_fit_on_all_cores(spark, monkeypatch):
    """A table in one file is dealt out before its rows are scanned again and again."""
    seen = []

    class Fits:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(learn, "estimator", lambda *_: Fits())
    learn.fit(spark.createDataFrame([(i % 2, [i]) for i in range(1000)], "label int, dd array<int>").coalesce(1), "dd", "randomForest")
    assert seen == [(spark.sparkContext.defaultParallelism, 1000)]


def test_subject_networks_of_a_large_folder_are_cut(spark, tmp_path):
    """No task sorts and writes all rows of a fold and cohort."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        rows = spark.range(0, 40_000, 1, 8).select(F.lit(0).alias("fold"), F.lit("Train").alias("cohort"), (F.col("id") % 2).cast("int").alias("label"), F.array(*[(F.hash("id") + i).alias("x") for i in range(2)]).alias("dd"))
        sources.write_subject_networks(rows, f"file://{tmp_path}/s", 2)
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "s" / "fold=0" / "cohort=Train").glob("*.csv"))) > 1
    back = sources.read_subject_networks(spark, f"file://{tmp_path}/s", 2)
    assert back.exceptAll(rows.select(*back.columns)).isEmpty() and back.count() == 40_000


def test_lookup_errors(spark):
    named = spark.createDataFrame([("a", "zz")], "snp1 string, snp2 string")
    with pytest.raises(PySparkException):
        pairs.name_edges_to_index(named, ["a", "b"]).collect()
    m = spark.createDataFrame([(1, 0, [0, 1])], M)
    with pytest.raises(PySparkException):
        pairs.merge_subsets(m, m.withColumn("sid", F.lit(2).cast("long"))).collect()
    assert pairs.project_nodes(m, ["a", "b"], spark.createDataFrame([("q",)], "snp string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (500, 500), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_ranks_and_dedup(spark):
    nodes = spark.createDataFrame([(i, "abbcc"[i]) for i in range(5)], "node int, component string")
    assert [tuple(r) for r in graph.ranked_components(nodes).select("rank", "component", "size").orderBy("rank").collect()] == [(0, "b", 2), (1, "c", 2), (2, "a", 1)]
    e = spark.createDataFrame([(1, 2, 0, 5.0), (2, 1, 1, 6.0)], "a int, b int, at int, ig double")
    assert [tuple(r) for r in graph.canonical_edges(e).collect()] == [(1, 2, 6.0)]


def test_power_law_finds_its_parameters(spark):
    h = spark.createDataFrame([("x", d, 0.7 * d**-2.0) for d in range(1, 12)] + [("y", 1, 1.0)], "k string, degree long, share double")
    got = {r.k: r for r in graph.power_law(h, ["k"]).collect()}
    assert (got["x"].a, got["x"].b) == pytest.approx((0.7, 2.0), abs=1e-6) and got["y"].b is None


def test_half_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, 500), rng.normal(0, 1e-6, 500), [0.0, 0.0208, 65519.0, 65520.0, 1e9, -1e9, 6e-8, 2.98e-8]))
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(fn.half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in x]


def test_splits(spark):
    m = spark.createDataFrame([(i, i % 3 == 0) for i in range(101)], "sid long, label boolean")
    sizes = [r[1] for r in splits.kfold(m, 5, 1).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 20, 20, 21]
    by = {(r.label, r.fold): r["count"] for r in splits.kfold(m, 5, 1, by=["label"]).groupBy("label", "fold").count().collect()}
    for label in (True, False):
        own = [n for (x, _), n in by.items() if x == label]
        assert max(own) - min(own) <= 1
    assert splits.holdout(m, 0.2, 1).where("is_test").count() == math.ceil(34 * 0.2) + math.ceil(67 * 0.2)
    ranks = sorted(r["rank"] for r in splits.shuffled_rank(m, 1, "sid").collect())
    assert ranks == list(range(1, 102))
    want = [i for i in range(7) for _ in range(101 * i // 7, 101 * (i + 1) // 7)]
    assert [r.chunk for r in splits.chunks(splits.shuffled_rank(m, 1, "sid"), 7).orderBy("rank").collect()] == want


def test_report_by_hand(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2
    got = {r.metric_row: r for r in reports.classification_report(spark.createDataFrame(rows, "label int, prediction int")).collect()}
    assert got["case"][1:] == pytest.approx((2 / 3, 0.5, 4 / 7, 4)) and got["accuracy"].support == pytest.approx(0.7)
    assert got["macro avg"].f1 == pytest.approx((10 / 13 + 4 / 7) / 2)
    none = {r.metric_row: r for r in reports.classification_report(spark.createDataFrame([(0, 0)], "label int, prediction int")).collect()}
    assert none["case"].f1 == 0 and none["case"].precision == 0


def test_permutations_keep_labels_and_move_them(spark, rows):
    m = spark.createDataFrame(rows, M)
    p = search.permuted(m, 2, 9).collect()
    labels = lambda k: [r.label for r in sorted(p, key=lambda r: r.sid) if r.perm == k]
    count = lambda x: sorted(map(str, x))
    assert count(labels(0)) == count(labels(1)) == count([r[1] for r in rows]) and labels(0) != labels(1)


def test_permutation_rank_and_orders(spark):
    rows = [(5.0, False), (4.0, True), (3.0, False), (2.0, True)]
    ranked = search.permutation_rank(spark.createDataFrame(rows, "v double, is_real boolean"), [F.desc("v")])
    assert [(r.v, r["rank"]) for r in ranked.orderBy(F.desc("v")).collect()] == [(5.0, 1), (4.0, 2), (3.0, 2), (2.0, 3)]
    assert sorted(r.p_value for r in search.p_values(ranked).collect()) == [round(2 / 3, 4), 1.0]
    res = spark.createDataFrame([(0.5, 3, 0.4, 0.9, ["a", "b"]), (0.5, 4, 0.4, 0.8, ["a"]), (0.6, 1, 0.1, 0.1, ["c"])], "cv_testing double, cvc int, model_testing double, overall double, attributes array<string>")
    first = lambda kind: res.orderBy(*search.search_order(kind)).first().overall
    assert (first("cv_test"), first("cvc_cv_test"), first("single")) == (0.1, 0.8, 0.9)
    jobs = spark.createDataFrame([("done", 5, 5), ("failed", 5, 0)], "state string, expected int, found int")
    assert not search.job_states(jobs).first().complete


def test_classifiers_learn_a_separable_label(spark):
    rows = spark.createDataFrame([(i, i % 2, [i % 2 * 2 - 1, i % 3]) for i in range(120)], "sid long, label int, dd array<int>")
    for kind in learn.KINDS:
        out = learn.report(learn.fit(rows, "dd", kind), {"train": rows}, "dd").where("metric_row = 'accuracy'").first()
        assert out.precision == 1.0


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a_A,Labels,b_C\n0,1,2\n1,0,x\n")
    m, names = sources.read_matrix_csv(spark, str(tmp_path / "m.csv"))
    assert names == ["a_A", "b_C"] and [tuple(r)[1:] for r in m.orderBy("sid").collect()] == [(1, [0, 2]), (0, [1, None])]
    (tmp_path / "m.tsv").write_text("0\t1\t1\n2\t0.0\t0\n")
    assert [(r.label, r.g) for r in sources.read_matrix_tsv(spark, str(tmp_path / "m.tsv")).orderBy("sid").collect()] == [(1, [0, 1]), (0, [2, 0])]
    (tmp_path / "bad.tsv").write_text("a\tb\n0\t\n")
    with pytest.raises(PySparkException):
        sources.read_matrix_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    net = spark.createDataFrame([("b", "c", 0.5, 0.25), ("a", "c", 1 / 3, 0.1)], sources.NETWORK)
    sources.write_network(net, str(tmp_path / "net"))
    assert [tuple(r) for r in sources.read_network(spark, str(tmp_path / "net")).orderBy("snp1").collect()] == [("a", "c", 0.333333333, 0.1), ("b", "c", 0.5, 0.25)]
    (tmp_path / "e.csv").write_text("1.0,3\n2,5\n")
    assert [tuple(r) for r in sources.read_index_edges(spark, str(tmp_path / "e.csv")).collect()] == [(1, 3), (2, 5)]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.txt").write_text("=====>\ta,b\t1/5\n\nrow\tc\t\n")
    lines = sources.read_lines(spark, str(tmp_path / "deep"))
    assert sorted(tuple(r)[1:] for r in sources.search_rows(lines, ["rank", "attributes", "cvc"]).collect()) == [("=====>", "a,b", "1/5"), ("row", "c", "")]
    with pytest.raises(PySparkException):
        sources.search_rows(lines, ["rank"]).collect()
    sources.write_parts(net.withColumn("fold", F.lit(1)), str(tmp_path / "parts"), "fold")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2


def test_counts_by_matrix_products(spark, rows, monkeypatch):
    """Tiles, slices and several scans give what exploded rows give, bad codes and labels included."""
    rng = random.Random(3)
    odd = [(i, rng.choice([0, 1, 0, 1, 2, None]), None if i == 5 else [rng.choice([0, 1, 2, 0, 1, 2, 3, None]) for _ in range(rng.choice([9, 9, 9, 6, 11]))]) for i in range(300)]
    m = spark.createDataFrame(odd, M).repartition(3)
    table = lambda df: sorted(tuple(-9 if x != x else round(x, 9) for x in r) for r in df.collect())
    for blocks in ({}, {"left": range(1, 4), "right": range(5, 9)}):
        narrow = [table(f(m, 9, **blocks)) for f in (pairs.pair_cells, pairs.pair_counts, pairs.pair_gains)]
        assert table(pairs.gain(pairs.pair_cells(m, 9, **blocks))) == narrow[2]
        with monkeypatch.context() as patched:
            for name, value in (("EXPLODED", 0), ("TILE", 2), ("ROWS", 50), ("HELD", 1)):
                patched.setattr(pairs, name, value)
            assert [table(f(m, 9, **blocks)) for f in (pairs.pair_cells, pairs.pair_counts, pairs.pair_gains)] == narrow
            patched.setattr(pairs, "HELD", 1 << 20)
            assert table(pairs.pair_gains(m, 9, **blocks)) == narrow[2]
            assert pairs.pair_gains(m.limit(0), 9, **blocks).count() == 0
    one = lambda label: pairs.pair_gains(spark.createDataFrame([(1, label, [0, 1])], M), 2).first()
    assert one(0)[2:] == one(None)[2:] == (0.0, 0.0, 0.0, 0.0) and math.isnan(one(1).ig)


def test_combinations_listed_or_exploded(spark, monkeypatch):
    rng = random.Random(4)
    m = spark.createDataFrame([(i, rng.choice([0, 1, None]), [rng.choice([0, 1, 2, None]) for _ in range(rng.choice([5, 5, 4]))]) for i in range(80)], M)
    listed = {(r.attributes, r.n_attributes): round(r.balanced_accuracy, 9) for r in search.kway_models(m, 5, [1, 2, 3, 6]).collect()}
    assert len(listed) == 5 + 10 + 10
    monkeypatch.setattr(search, "LISTED", 0)
    assert {(r.attributes, r.n_attributes): round(r.balanced_accuracy, 9) for r in search.kway_models(m, 5, [1, 2, 3, 6]).collect()} == listed
    rows = [(r.label, tuple((r.g + [None] * 5)[:5])) for r in m.collect() if r.label is not None]
    n = [sum(1 for y, _ in rows if y == k) for k in (0, 1)]
    cells = {}
    for y, g in rows:
        cells.setdefault((g[0], g[3]), [0, 0])[y] += 1
    high = [c for c in cells.values() if c[1] * n[0] > c[0] * n[1]]
    want = (sum(c[1] for c in high) / n[1] + (n[0] - sum(c[0] for c in high)) / n[0]) / 2
    assert listed["0,3", 2] == round(want, 9)


def test_rows_keep_their_place_however_files_are_split(spark, tmp_path):
    wide = [[i % 3, i // 3 % 3, i // 9 % 3, i % 2] for i in range(900)]
    for folder, columns in (("a", (0, 3)), ("b", (0, 1, 2, 0, 1, 2, 0, 1, 2, 3))):
        (tmp_path / folder).mkdir()
        for k, part in enumerate((wide[:200], wide[200:])):  # the second file is larger
            (tmp_path / folder / f"{k}.csv").write_text("\n".join([",".join([*(f"c{j}" for j in range(len(columns) - 1)), "Labels"]), *(",".join(str(r[j]) for j in columns) for r in part)]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        a, b = (sources.read_matrix_csv(spark, str(tmp_path / f))[0] for f in "ab")
        assert a.rdd.getNumPartitions() > 2
        assert [(r.sid, r.label, r.g) for r in a.orderBy("sid").collect()] == [(i, r[3], [r[0]]) for i, r in enumerate(wide)]
        merged = pairs.merge_subsets(a, b).orderBy("sid").collect()
        assert [r.g for r in merged] == [[r[0], *r[:3] * 3] for r in wide]
        assert pairs.join_blocks(a.where("sid < 5"), b).count() == 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sources.attribute_count(spark, str(tmp_path / "b" / "0.csv"), ",") == 9


def test_search_outputs(spark, rows, tmp_path):
    assert search.permutation_chunks(6, 3, 10) == [(10, 2), (12, 2), (14, 2)]
    with pytest.raises(ValueError):
        search.permutation_chunks(7, 3)
    assert search.sweep({"seed": 1}, {"min": [1, 2], "max": [3]}) == [{"seed": 1, "min": 1, "max": 3}, {"seed": 1, "min": 2, "max": 3}]
    assert search.sweep({"seed": 1}, {}) == [{"seed": 1}]
    assert sources.result_path("out/", igCutoff=0.0208, minCompSize=60) == "out/igCutoff_0.0208_minCompSize_60"
    results = spark.createDataFrame([("a", 0.9, False), ("b", 0.8, True), ("c", 0.1, False)], "name string, score double, is_real boolean")
    ranked = search.permutation_rank(results, [F.desc("score")])
    jobs = spark.createDataFrame([("done", 3, 2)], "state string, expected long, found long")
    sources.write_permutation_report(ranked, search.p_values(ranked), search.job_states(jobs), str(tmp_path / "r"), ["name", "score"])
    read = lambda x: sorted(tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r" / x)).collect())
    assert read("ranked") == [("1", "a", "0.9"), ("2", "c", "0.1"), ("=====>", "b", "0.8")]
    assert read("p_values") == [("b", "0.8", "0.6667")]
    assert spark.read.text(str(tmp_path / "r" / "warning")).first()[0] == "partial results: 2 of 3 rows"
    top = spark.createDataFrame([(1, ["2"]), (2, ["0", "2"]), (2, ["0", "2"])], "n_attributes int, attributes array<string>")
    sources.write_top_models(top, str(tmp_path / "top"))
    assert sorted((r.n_attributes, r.value) for r in spark.read.text(str(tmp_path / "top")).collect()) == [(1, "2"), (2, "0,2"), (2, "2")]
    m = spark.createDataFrame(rows, M)
    again = {tuple(r) for r in search.reanalysed(m, 4, [1, 2], top).collect()}
    assert again == {tuple(r) for r in search.kway_models(m, 4, [1, 2]).where("attributes IN ('0', '2', '0,2')").collect()}
    models = pairs.sparse_models(m.where("label IN (0, 1)").withColumn("label", F.col("label") + 1), 4)
    sources.write_models(models, str(tmp_path / "models"))
    assert spark.read.option("header", True).csv(str(tmp_path / "models")).count() == models.count()


def test_streamed_cells_add_up(spark, rows, tmp_path):
    m = spark.createDataFrame(rows, M)
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streamed_cells(stream, 4).writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("cells").collect()} == {tuple(r) for r in pairs.pair_cells(m, 4).collect()}


@pytest.mark.parametrize("most", [10_000, 2])
def test_short_and_null_arrays_meet_every_edge(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "PACKED_EDGES", most)
    m = spark.createDataFrame([(1, 1, [0, 1, 2]), (2, 0, [0]), (3, 1, None), (4, 0, [])], "sid long, label int, g array<int>")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 0)], "f1 int, f2 int")
    met = [(r.sid, r.f1, r.f2) for r in pairs.at_edges(m, edges).collect()]
    assert sorted(met) == [(s, *e) for s in (1, 2, 3, 4) for e in ((0, 1), (1, 2), (2, 0))]
    none = spark.createDataFrame([], "f1 int, f2 int, v1 int, v2 int, sign int")
    dd = {r.sid: r.dd for r in pairs.delta_degrees(m, edges, none, 3).collect()}
    assert dd == dict.fromkeys((1, 2, 3, 4), [3, 2, 3])
    signs = pairs.cell_signs(m, edges).collect()
    assert sum((r.f1, r.f2, r.v1, r.v2) == (0, 1, 0, None) for r in signs) == 1 and len(signs) == 8


@pytest.mark.parametrize("most", [100_000, 2])
def test_delta_degrees_keep_subjects_where_they_are(spark, rows, monkeypatch, most):
    """No subject is shuffled, however many parts the network has."""
    monkeypatch.setattr(pairs, "PACKED_EDGES", most)
    m = spark.createDataFrame([r for r in rows if r[1] in (0, 1)], M)
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 1), (3, 3), (2, 3)], "f1 int, f2 int")
    signs = stage(pairs.cell_signs(m, e), "signs")
    found = pairs.delta_degrees(m, e, signs, 4)
    sign = {(r.f1, r.f2, r.v1, r.v2): r.sign for r in signs.collect()}
    for r in found.join(m.select("sid", "g"), "sid").collect():
        want = [0] * 4
        for i, j in ((0, 1), (1, 2), (0, 1), (3, 3), (2, 3)):
            s = 1 if None in (r.g[i], r.g[j]) else sign.get((i, j, r.g[i], r.g[j]), 1)
            want[i] += s
            want[j] += s
        assert r.dd == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sid" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x) and "SortMergeJoin [sid" not in plan


def test_sums_before_every_row(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(6), rng.randrange(1000), i, rng.randrange(4)) for i in range(3000)]
    got = {r.i: r.before for r in order.sum_before(spark.createDataFrame(rows, "a int, b int, i int, w int").repartition(7), [F.desc("a"), F.asc("b"), F.asc("i")], F.col("w"), "before").collect()}
    total, want = 0, {}
    for _, _, i, w in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        want[i] = total
        total += w
    assert got == want
    assert order.sum_before(spark.createDataFrame([], "a int"), [F.asc("a")], F.lit(1), "n").count() == 0


def test_grouped_permutation_ranks(spark):
    rows = [(k, i * 7 % 40, i % 9 == 0) for k in ("x", "y", None) for i in range(40)]
    got = search.permutation_rank(spark.createDataFrame(rows, "k string, v int, is_real boolean"), [F.desc("v")], by=["k"]).collect()
    for r in got:
        assert r["rank"] == 1 + sum(k == r.k and v > r.v and not real for k, v, real in rows)
    assert len(got) == len(rows)


def test_chunks_of_many_rows_end_where_they_should(spark):
    """The quotient of the first rank of a piece is less than 1e-6 over a whole number."""
    n = 3_000_001
    got = splits.chunks(spark.range(1, n + 1).withColumnRenamed("id", "rank"), 7).groupBy("chunk").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).collect()
    assert {r["chunk"]: (r["first"], r["last"]) for r in got} == {i: (i * n // 7 + 1, (i + 1) * n // 7) for i in range(7)}


def test_files_written_from_files_keep_their_order(spark, tmp_path):
    """A scan takes the largest file first; rows keep their places all the same."""
    source = tmp_path / "source"
    source.mkdir()
    sizes, at = [3, 400, 20, 900, 1], 0
    for i, n in enumerate(sizes):
        (source / f"part-{i}.csv").write_text("target\ta\tsid\n" + "".join(f"{k % 2}\t{k}\t9\n" for k in range(at, at + n)))
        at += n
    plain = spark.read.option("header", True).option("sep", "\t").csv(str(source))
    sources.label_last(sources.in_file_order(plain)).write.option("header", True).csv(str(tmp_path / "relabelled"))
    lines = [x for f in sorted((tmp_path / "relabelled").glob("part-*")) for x in f.read_text().splitlines() if x != "a,sid,Labels"]
    assert lines == [f"{k},9,{k % 2}" for k in range(at)]
    (tmp_path / "tabs").mkdir()
    for i, n in enumerate((2, 50, 9)):
        (tmp_path / "tabs" / f"part-{i}.csv").write_text("".join(f"{i}\t{k}\n" for k in range(n)))
    sources.transcode(spark, str(tmp_path / "tabs"), str(tmp_path / "commas"), "\t", ",")
    lines = [x for f in sorted((tmp_path / "commas").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"{i},{k}" for i, n in enumerate((2, 50, 9)) for k in range(n)]


def test_permuted_gains_are_those_of_each_permutation(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "HELD", 1 << 10)  # several scans
    m = spark.createDataFrame(rows, M)
    got = {(r.perm, r.f1, r.f2): round(r.ig, 9) for r in search.permuted_gains(m, 4, 3, 9, start=5).collect()}
    want = {(r.perm, r.f1, r.f2): round(r.ig, 9) for r in pairs.pair_gains(search.permuted(m, 3, 9, 5), 4, keys=["perm"]).collect()}
    assert got == want and {k[0] for k in got} == {5, 6, 7}


def test_explicit_test_keeps_main_effects(spark):
    """A pure interaction is found; a label that follows one feature alone gives no interaction."""
    rng = random.Random(6)
    rows = []
    for s in range(600):
        g = [rng.randrange(3) for _ in range(4)]
        rows.append((s, int((g[0] + g[1]) % 3 == 0), g))
    got = {(r.f1, r.f2): r for r in search.explicit_test(spark.createDataFrame(rows, M), 4, 9, 3).collect()}
    assert got[0, 1].p_value == 0.1 and got[0, 1].n_above == 0 and sum(r.p_value > 0.1 for r in got.values()) >= 3


def test_cross_validation_by_hand(spark):
    rng = random.Random(9)
    rows = [(s, rng.randrange(2), [rng.randrange(3) for _ in range(3)], rng.randrange(3)) for s in range(90)]
    m = spark.createDataFrame(rows, "sid long, label int, g array<int>, fold int")
    got = {r.attributes: r for r in search.kway_cross_validated(m, 3, [1, 2], 3).collect()}

    def balanced(cols, train, test):
        cells, n = {}, [sum(y == k for _, y, _, _ in train) for k in (0, 1)]
        for _, y, g, _ in train:
            cells.setdefault(tuple(g[c] for c in cols), [0, 0])[y] += 1
        high = {c for c, (a, b) in cells.items() if b * n[0] > a * n[1]}
        hit = [sum((tuple(g[c] for c in cols) in high) == bool(k) for _, y, g, _ in test if y == k) for k in (0, 1)]
        size = [sum(y == k for _, y, _, _ in test) for k in (0, 1)]
        return sum(h / s for h, s in zip(hit, size, strict=True)) / 2

    wins = dict.fromkeys(got, 0)
    scores = {}
    for name in got:
        cols = [int(c) for c in name.split(",")]
        scores[name] = []
        for k in range(3):
            train, test = [r for r in rows if r[3] != k], [r for r in rows if r[3] == k]
            scores[name].append((balanced(cols, train, train), balanced(cols, train, test)))
        r = got[name]
        assert (r.cv_training, r.cv_testing) == pytest.approx(tuple(sum(x) / 3 for x in zip(*scores[name], strict=True)))
        assert r.overall == pytest.approx(balanced(cols, rows, rows))
    for k in range(3):
        for size in (1, 2):
            wins[min((n for n in scores if n.count(",") == size - 1), key=lambda n: (-round(scores[n][k][0], 9), n))] += 1
    assert {n: r.cvc for n, r in got.items()} == wins


def test_covariates_are_made_independent(spark, rows):
    m = spark.createDataFrame([(s, y, g, None if s % 7 == 0 else s % 3) for s, y, g in rows], M + ", level int")
    w = pairs.covariate_weights(m, "level").collect()
    share = {k: sum(r.weight for r in w if r.level == k and r.label == 1) / sum(r.weight for r in w if r.level == k) for k in {r.level for r in w}}
    assert len(share) == 4 and max(share.values()) - min(share.values()) < 1e-9
    assert sum(r.weight for r in w) == pytest.approx(len(w)) and len(w) == sum(y in (0, 1) for _, y, _ in rows)
    flat = {(r.f1, r.f2): r.ig for r in pairs.adjusted_gains(m.withColumn("level", F.lit(1)), 4, "level").collect()}
    assert flat == {(r.f1, r.f2): pytest.approx(r.ig) for r in pairs.pair_gains(m, 4).collect()}


def test_networks_merge(spark):
    one = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.1)], "a string, b string, ig double")
    two = spark.createDataFrame([("b", "a", 0.7), ("c", "d", 0.2), ("d", "c", 0.3)], "a string, b string, ig double")
    assert sorted(tuple(r) for r in graph.merge_networks([one, two], "ig", 0.2).collect()) == [("a", "b", 0.7), ("c", "d", 0.3)]


def test_study_finds_the_planted_pair(spark):
    rng = random.Random(2)
    rows = []
    for s in range(300):
        g = [rng.randrange(3) for _ in range(5)]
        rows.append((s, int((g[1] + g[3]) % 3 == 0), g))
    m = spark.createDataFrame(rows, M)
    got = study(m, list("vwxyz"), 0.3, 2, 2, kinds=("decisionTree",)).collect()
    assert {(r.component, r.features, r.cohort) for r in got} == {(0, f, c) for f in ("raw", "delta") for c in ("train", "test")}
    best = [r.precision for r in got if r.metric_row == "accuracy" and r.cohort == "test"]
    assert len(got) == 20 and min(best) > 0.8
    assert study(m, list("vwxyz"), 0.99999, 6, 2).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from genoloom import scratch

    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key: None)}))

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        scratch.shared_dir(Cluster)
    assert scratch.shared_dir(spark)
    before = {key: spark.conf.get(key) for key in scratch.SCOPED}
    assert stage(spark.range(3), "x").count() == 3 and before == {key: spark.conf.get(key) for key in scratch.SCOPED} != scratch.SCOPED


def test_hot_keys_join_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 3), (3, 1), (None, 4), (4, 12)) for i in range(n)], "k int, i int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")).where("n > 1")
    want = sorted((k, i, 0) for k, n in ((1, 30), (2, 3), (4, 12)) for i in range(n))
    for top, keys in ((50_000, 20_000), (10, 20_000), (10, 1)):
        monkeypatch.setattr(hot, "HOT", top)
        monkeypatch.setattr(hot, "BROADCAST_KEYS", keys)
        assert sorted((r.k, r.i, r.least) for r in hot.join_groups(rows, groups, ["k"]).collect()) == want


def test_small_tables_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    table = spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string")
    hint = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hint(hot.few(table, 2)) and not hint(hot.few(table, 1)) and hint(hot.few(table, 2, "t"))
    monkeypatch.setattr(hot, "TEXT_BYTES", 1)
    assert not hint(hot.few(table, 2, "t")) and hint(hot.few(table.limit(0), 2, "t"))
