"""Registered queries of wide matrices: bitmaps by columns, ranges of combinations, permutation products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from genoloom.operators import bitmaps, chunked, forest, keyed, pairs, reports, search, splits
from genoloom.operators.hot import even
from genoloom.plans.queries import CELLS_SQL, FOLD_SQL, FOLDS, GAIN_COLS, GAIN_SQL, M_SQL, P_SQL, PERMUTED_SQL, SEED, SIGN_SQL, STATS_SQL, W_SQL, WIDE, WIDTH, WP_SQL, edge_table, folded, matrix, network, query, rounded, table, wide_matrix
from genoloom.scratch import new_path, stage

#: Columns of the widest matrix, and of that of three-way searches.
COLUMNS, SEARCHED, NODES = 200, 60, 16
CODE = "(o_orderkey {div} (1 + {i} % 7) + o_custkey * {i} + CAST(floor(o_totalprice) AS BIGINT) {div} (1 + {i} % 11)) % 3"


def columns_sql(width: int) -> str:
    codes = ", ".join(f"CAST({CODE.format(div='//', i=i)} AS INTEGER)" for i in range(width))
    return f"""m0 AS (SELECT o_orderkey AS sid, CAST(o_orderstatus = 'F' AS INTEGER) AS status, [{codes}] AS g FROM orders),
m AS (SELECT sid, CASE WHEN sid % 7 < 5 THEN CAST((g[4] + g[58]) % 3 = 0 AS INTEGER) ELSE status END AS label, g FROM m0)"""


def columns_matrix(spark, sf_dir, width):
    """Mixed digits of orders; the label of most rows tells of features 3 and 57 together."""
    g = F.array(*[F.expr(CODE.format(div="DIV", i=i)).cast("int") for i in range(width)])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_orderstatus") == "F").cast("int").alias("status"), g.alias("g"))
    planted = ((F.col("g")[3] + F.col("g")[57]) % 3 == 0).cast("int")
    return rows.select("sid", F.when(F.col("sid") % 7 < 5, planted).otherwise(F.col("status")).alias("label"), "g")


#: The gain that a pair must reach; it grows with chance in small tables.
LEAST = 0.002
#: The same codes in long rows: every pair is counted by one join of a code list with itself.
WIDE_SQL = GAIN_SQL.replace(M_SQL, columns_sql(COLUMNS)).replace(P_SQL, f"p(f1, f2) AS (SELECT a.i, b.i FROM range({COLUMNS}) a(i), range({COLUMNS}) b(i) WHERE a.i < b.i)")


@query(f"WITH {WIDE_SQL} SELECT CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, {GAIN_COLS} FROM gains WHERE mi - main_f1 - main_f2 >= {LEAST}")
def block_pair_ig(spark, sf_dir):
    """19,900 pairs of 200 columns, counted between blocks of bitmaps; those over a threshold."""
    found = bitmaps.block_gains(columns_matrix(spark, sf_dir, COLUMNS), COLUMNS, LEAST)
    return rounded(found.select("f1", "f2", "ig", "mi"), "ig", "mi")


#: Who has which code of which feature, as bit strings over the rows' numbers.
BITS_SQL = f"""{columns_sql(SEARCHED)}, r AS (SELECT label, g, row_number() OVER (ORDER BY sid) AS k FROM m),
size AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM m),
b AS (SELECT s, f, v, y, bitstring_agg(k, 0, 16383) AS bits FROM (SELECT k // 16384 AS s, f, g[f + 1] AS v, label AS y, CAST(k % 16384 AS INTEGER) AS k FROM r, range({SEARCHED}) t(f)) GROUP BY ALL),
cells AS (SELECT x.f || ',' || y.f || ',' || z.f AS attributes, x.v AS vx, y.v AS vy, z.v AS vz, bit_count(x.bits & y.bits & z.bits) AS n, x.y AS label
  FROM b x JOIN b y ON x.s = y.s AND x.y = y.y AND x.f < y.f JOIN b z ON z.s = y.s AND z.y = y.y AND y.f < z.f),
c AS (SELECT attributes, coalesce(sum(n) FILTER (label = 0), 0) AS ctl, coalesce(sum(n) FILTER (label = 1), 0) AS cas FROM cells GROUP BY attributes, vx, vy, vz),
scores AS (SELECT attributes, coalesce(sum(cas) FILTER (cas * n0 > ctl * n1), 0) / any_value(n1) / 2 + coalesce(sum(ctl) FILTER (cas * n0 <= ctl * n1), 0) / any_value(n0) / 2 AS s FROM c, size GROUP BY attributes)"""


@query(f"WITH {BITS_SQL} SELECT attributes, 3 AS n_attributes, round(s, 9) AS balanced_accuracy FROM scores")
def bitmap_kway_search(spark, sf_dir):
    """34,220 combinations of three of sixty features, 64 subjects a word."""
    return rounded(bitmaps.kway_bits(columns_matrix(spark, sf_dir, SEARCHED), SEARCHED, [3]), "balanced_accuracy")


@query(f"""WITH n AS (SELECT unnest(range({NODES})) AS node), t AS (SELECT 34220 AS total, (SELECT count(*) FROM orders) AS subjects)
SELECT CAST(node AS INTEGER) AS node, (node + 1) * total // {NODES} - node * total // {NODES} AS combinations, node * total // {NODES} AS first, (node + 1) * total // {NODES} - 1 AS last,
  subjects * ((node + 1) * total // {NODES} - node * total // {NODES}) AS subjects FROM n, t""")
def search_nodes(spark, sf_dir):
    """What each of sixteen nodes of the search counted: its ranks, and every subject once for each of them."""
    counts = bitmaps.kway_counts(columns_matrix(spark, sf_dir, SEARCHED), SEARCHED, 3, NODES)
    cells = F.aggregate(F.concat("ctl", "cas"), F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.groupBy("node").agg(F.count_distinct("attributes").alias("combinations"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum(cells).alias("subjects"))


PERMUTATIONS = 100
LABELS_SQL = f"""{W_SQL}, {WP_SQL}, places AS (SELECT g, row_number() OVER (ORDER BY md5('{SEED}:place:' || sid), 'place:' || sid) AS r FROM m),
labs AS (SELECT perm, label, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}:' || perm || ':' || sid), perm || ':' || sid) AS r FROM m, range({PERMUTATIONS}) t(perm)),
x AS (SELECT perm, g, label FROM places JOIN labs USING (r)),
cells AS (SELECT perm, f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, count(*) FILTER (label = 0) AS ctl, count(*) FILTER (label = 1) AS cas FROM x, p GROUP BY ALL)""" + GAIN_SQL.removeprefix(CELLS_SQL).replace("f1, f2", "perm, f1, f2")


@query(f"WITH {LABELS_SQL} SELECT CAST(perm AS INTEGER) AS perm, CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, round(mi - main_f1 - main_f2, 9) AS ig FROM gains")
def wide_permuted_gains(spark, sf_dir):
    """91 pairs under a hundred permutations of the labels, by products of cells and labels."""
    return rounded(search.permuted_gains(wide_matrix(spark, sf_dir), WIDE, PERMUTATIONS, SEED).select("perm", "f1", "f2", "ig"), "ig")


# ---------------------------------------------------------------- many models at once

FOLDED_SQL = f"""{W_SQL}, f AS (SELECT sid, label, g, (row_number() OVER (PARTITION BY label ORDER BY {FOLD_SQL}, sid) - 1) % {FOLDS} AS fold FROM m)"""


def keyed_rows(spark, sf_dir):
    """The fourteen features of orders by fold, as one set."""
    rows = splits.kfold(wide_matrix(spark, sf_dir), FOLDS, SEED, by=["label"])
    return stage(rows.select("fold", "label", F.lit("all").alias("set"), F.col("g").alias("x")), "keyed")


@query(f"WITH {FOLDED_SQL}, n AS (SELECT k, count(*) FILTER (fold <> k) AS n FROM f, range({FOLDS}) t(k) GROUP BY k) SELECT 'all/' || k AS model, CAST(i AS INTEGER) AS coefficient, n, true AS stationary FROM n, range({WIDE + 1}) c(i)")
def logistic_gradients(spark, sf_dir):
    """Five logistic regressions fitted together: the penalised gradient is 0 at each weight found."""
    rows = keyed_rows(spark, sf_dir)
    models = stage(keyed.logistic_models(keyed.training_sets(rows, FOLDS)), "models")
    seen = keyed.training_sets(rows, FOLDS).join(F.broadcast(models.select("model", "w", "n0", "n1")), "model")
    score = F.col("w")[0] + reduce(Column.__add__, [F.col("x")[i] * F.col("w")[i + 1] for i in range(WIDE)])
    weight = (F.col("n0") + F.col("n1")) / (2 * F.when(F.col("label") == 1, F.col("n1")).otherwise(F.col("n0")))
    slope = seen.select("model", "x", "w", (weight * (1 / (1 + F.exp(-score)) - F.col("label"))).alias("s"))
    # A sum for each coefficient beside the others: no row is copied for its features.
    each = [F.sum("s"), *[F.sum(F.col("s") * F.col("x")[i]) for i in range(WIDE)]]
    wide = slope.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("g"), F.first("w").alias("w"))
    sums = wide.select("model", "n", F.posexplode(F.arrays_zip("g", "w")).alias("coefficient", "e")).select("model", "n", "coefficient", "e.g", "e.w")
    penalty = F.when(F.col("coefficient") == 0, 0.0).otherwise(F.col("w"))
    return sums.select("model", "coefficient", "n", (F.abs(F.col("g") + penalty) < 1e-6 * F.col("n")).alias("stationary"))


@query(f"""WITH {FOLDED_SQL}, x AS (SELECT k, label, i AS feature, g[i + 1] AS v FROM f, range({FOLDS}) t(k), range({WIDE}) c(i) WHERE fold <> k),
h AS (SELECT k, feature, v, count(*) FILTER (label = 0) AS c, count(*) FILTER (label = 1) AS d FROM x GROUP BY ALL),
s AS (SELECT k, feature, v, lead(v) OVER w AS next, sum(c) OVER w AS l0, sum(d) OVER w AS l1, sum(c) OVER (PARTITION BY k, feature) AS n0, sum(d) OVER (PARTITION BY k, feature) AS n1 FROM h WINDOW w AS (PARTITION BY k, feature ORDER BY v)),
p AS (SELECT k, feature, (v + next) / 2.0 AS threshold, n0, n1, l0 / (2.0 * n0) AS a, l1 / (2.0 * n1) AS b, (n0 - l0) / (2.0 * n0) AS c, (n1 - l1) / (2.0 * n1) AS d FROM s
  WHERE next IS NOT NULL AND l0 + l1 >= ceil(0.05 * (n0 + n1)) AND n0 + n1 - l0 - l1 >= ceil(0.05 * (n0 + n1))),
q AS (SELECT k, feature, threshold, round(2 * (0.25 - coalesce(a * b / nullif(a + b, 0), 0) - coalesce(c * d / nullif(c + d, 0), 0)), 9) AS gain, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1 FROM p)
SELECT 'all/' || k AS model, CAST(feature AS INTEGER) AS feature, threshold::DOUBLE AS threshold, n0, n1 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, feature, threshold) AS r FROM q WHERE gain > 0) WHERE r = 1""")
def tree_roots(spark, sf_dir):
    """The first split of five decision trees grown together."""
    trees = keyed.tree_models(keyed.training_sets(keyed_rows(spark, sf_dir), FOLDS))
    return trees.where("node = 1 AND feature IS NOT NULL").select("model", "feature", "threshold", "n0", "n1")


@query(f"WITH {FOLDED_SQL} SELECT 'all/' || k AS model, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS cohort, CASE label WHEN 0 THEN 'control' ELSE 'case' END AS metric_row, count(*)::DOUBLE AS support, true AS whole FROM f, range({FOLDS}) t(k) GROUP BY ALL")
def tree_reports(spark, sf_dir):
    """Reports of five trees on both cohorts; every row ends in a leaf whose class is predicted."""
    rows = keyed_rows(spark, sf_dir)
    trees = stage(keyed.tree_models(keyed.training_sets(rows, FOLDS)), "trees")
    scored = keyed.tree_predictions(keyed.scoring_sets(rows, FOLDS), trees)
    ends = trees.where("feature IS NULL").select("model", "node", F.col("label").alias("class"))
    whole = scored.join(ends, ["model", "node"], "left").groupBy("model", "cohort").agg(F.bool_and(F.coalesce(F.col("class") == F.col("prediction"), F.lit(False))).alias("whole"))
    found = reports.classification_report(scored, ["model", "cohort"]).where("metric_row IN ('control', 'case')")
    return found.join(whole, ["model", "cohort"]).select("model", "cohort", "metric_row", "support", "whole")


@query(f"""WITH {SIGN_SQL.split("train AS")[0]} k AS (SELECT * FROM range({FOLDS}) t(k)),
ratio AS (SELECT k, count(*) FILTER (label = 1 AND fold <> k)::DOUBLE / count(*) FILTER (label = 0 AND fold <> k) AS r FROM folds, k GROUP BY k)
SELECT CAST(k AS INTEGER) AS fold, f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, CASE WHEN count(*) FILTER (label = 0) * any_value(r) >= count(*) FILTER (label = 1) THEN 1 ELSE -1 END AS sign FROM folds JOIN ratio ON fold <> k, e GROUP BY k, f1, f2, v1, v2""")
def fold_cell_signs(spark, sf_dir):
    """Signs of every cell of four edges for five folds, from one count by fold."""
    return pairs.fold_signs(stage(folded(spark, sf_dir), "folds"), edge_table(spark), FOLDS)


# ---------------------------------------------------------------- studies in chunks


def interrupted(spark, sf_dir):
    """(results, plan) of ten permutations in five jobs: two ran, one lost rows, then the study went on."""
    m, path = stage(even(matrix(spark, sf_dir), "sid")[0], "matrix"), new_path(spark, "study")
    run = lambda only=None: chunked.permutation_study(m, WIDTH, 10, 5, SEED, path, only)
    assert run([1, 3])[1] == [1, 3]
    found = run([])[0]
    stage(found.where("chunk = 3 AND f1 > 0"), "kept").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
    return run, chunked.permutation_plan(spark, WIDTH, 10, 5)


@query(f"WITH {PERMUTED_SQL} SELECT CAST(perm AS INTEGER) AS perm, CAST(perm // 2 AS INTEGER) AS chunk, f1, f2, ig FROM rounded WHERE perm >= 0")
def resumed_permutations(spark, sf_dir):
    """A study of permutations whose missing and partial chunks, and no others, ran a second time."""
    run, _ = interrupted(spark, sf_dir)
    found, ran = run()
    assert ran == [0, 2, 3, 4] and run()[1] == []
    return rounded(found.select("perm", "chunk", "f1", "f2", "ig"), "ig")


@query(f"""WITH {PERMUTED_SQL}, c AS (SELECT perm // 2 AS chunk, count(*) AS expected, count(*) FILTER (perm // 2 = 1 OR perm // 2 = 3 AND f1 > 0) AS found FROM rounded WHERE perm >= 0 GROUP BY ALL)
SELECT count(*) FILTER (found = expected) AS done, count(*) FILTER (found > 0 AND found < expected) AS partial, count(*) FILTER (found = 0) AS missing, sum(expected)::BIGINT AS expected, sum(found)::BIGINT AS found, bool_and(found = expected) AS complete FROM c""")
def job_counters(spark, sf_dir):
    """Counters of a study's jobs before it goes on: what is done, partial and missing."""
    run, plan = interrupted(spark, sf_dir)
    return chunked.state_counters(chunked.chunk_states(run([])[0], plan))


# ---------------------------------------------------------------- sweeps of a network's parameters

CUTOFFS, SIZES = [0.015, 0.02, 0.025], [2, 3, 5, 10]
KEPT_SQL = STATS_SQL.split("deg AS (")[0].replace("(VALUES (0.02::DOUBLE), (0.025), (0.03))", f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in CUTOFFS)})")


@query(f"""{KEPT_SQL} n AS (SELECT th, c.component, count(*) AS edges FROM te JOIN comp c ON c.th = te.th AND c.node = te.a GROUP BY ALL)
SELECT s.th, at_least, count(*) AS components, sum(size)::BIGINT AS nodes, sum(edges)::BIGINT AS edges FROM sizes s JOIN n ON n.th = s.th AND n.component = s.component, (VALUES {', '.join(f'({x})' for x in SIZES)}) v(at_least) WHERE size >= at_least GROUP BY ALL""".replace("n AS (SELECT th, c.component", "n AS (SELECT te.th, c.component"))
def parameter_sweep(spark, sf_dir):
    """Components, nodes and edges that every cutoff and smallest component size keep."""
    nodes = stage(forest.threshold_nodes(network(spark, sf_dir), "ig", CUTOFFS), "nodes")
    return forest.kept_components(nodes, SIZES)
