"""Registered queries of the network engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom import functions as fn
from genoloom.operators import forest, graph, learn, pairs, reports, search, splits
from genoloom.plans.study import study
from genoloom.scratch import stage

WIDTH, SEED, FOLDS = 4, 25, 5
NAMES = ["key", "price", "month", "priority"]
EDGES = [(0, 1), (1, 2), (2, 3), (0, 3)]
THRESHOLDS = [0.015, 0.02, 0.025, 0.03]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- fixtures

M_SQL = """m AS (SELECT o_orderkey AS sid, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
  [CAST(o_orderkey % 3 AS INTEGER), CAST(floor(o_totalprice) AS INTEGER) % 3, CAST(month(o_orderdate) AS INTEGER) % 3, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3] AS g FROM orders)"""
P_SQL = "p(f1, f2) AS (VALUES (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))"
CELLS_SQL = f"""{M_SQL}, {P_SQL}, cells AS (
  SELECT f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, count(*) FILTER (label = 0) AS ctl, count(*) FILTER (label = 1) AS cas FROM m, p GROUP BY ALL)"""
GAIN_SQL = CELLS_SQL + """, n AS (SELECT f1, f2, sum(ctl) AS c, sum(cas) AS d FROM cells GROUP BY ALL),
buckets AS (
  SELECT 'both' AS k, f1, f2, v1, v2, sum(ctl) AS x, sum(cas) AS y FROM cells GROUP BY ALL
  UNION ALL SELECT 'one', f1, f2, v1, NULL, sum(ctl), sum(cas) FROM cells GROUP BY ALL
  UNION ALL SELECT 'two', f1, f2, NULL, v2, sum(ctl), sum(cas) FROM cells GROUP BY ALL),
parts AS (
  SELECT k, f1, f2, CASE WHEN x > 0 AND y > 0 THEN -((x * d / c + y) / (2 * d)) * ((x * d / c) / (x * d / c + y) * log2((x * d / c) / (x * d / c + y)) + y / (x * d / c + y) * log2(y / (x * d / c + y))) ELSE 0 END AS h
  FROM buckets JOIN n USING (f1, f2)),
gains AS (
  SELECT f1, f2, 1 - sum(h) FILTER (k = 'both') AS mi, 1 - sum(h) FILTER (k = 'one') AS main_f1, 1 - sum(h) FILTER (k = 'two') AS main_f2 FROM parts GROUP BY ALL)"""
GAIN_COLS = "round(mi - main_f1 - main_f2, 9) AS ig, round(mi, 9) AS mi"
G_SQL = """e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*) / 200.0 AS ig FROM lineitem GROUP BY ALL HAVING count(*) >= 3)"""
COMP_SQL = G_SQL + """, both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS least FROM both_ UNION SELECT both_.b, least FROM reach JOIN both_ ON both_.a = node WHERE least < both_.b),
comp AS (SELECT node, min(least) AS component FROM reach GROUP BY node),
sizes AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS rank FROM comp GROUP BY component)"""
FOLD_SQL = f"md5('{SEED}:' || sid)"
F4_SQL = f"""s AS (SELECT doc_id, toxic AS label, 1 - quality AS prediction, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1) % 5 AS fold FROM labels)"""
REPORT_SQL = """
c AS (SELECT {k} count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn, count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp FROM s GROUP BY {g}),
d AS (SELECT {k} 'control' AS metric_row, tn AS hit, fn AS wrong, fp AS missed FROM c UNION ALL SELECT {k} 'case', tp, fp, fn FROM c),
q AS (SELECT {k} metric_row, CASE WHEN hit + wrong = 0 THEN 0 ELSE hit / (hit + wrong) END AS precision, CASE WHEN hit + missed = 0 THEN 0 ELSE hit / (hit + missed) END AS recall, hit + missed AS support FROM d),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q),
report AS (
  SELECT {k} metric_row, precision, recall, f1, support FROM f
  UNION ALL SELECT {k} 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f GROUP BY {g}
  UNION ALL SELECT {k} 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f GROUP BY {g}
  UNION ALL SELECT {k} 'accuracy', (tn + tp) / (tn + tp + fn + fp), (tn + tp) / (tn + tp + fn + fp), (tn + tp) / (tn + tp + fn + fp), (tn + tp) / (tn + tp + fn + fp) FROM c)"""
ROUND4 = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(support, 9) AS support"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genotype-like matrix of orders: four features of three values and a label."""
    three = lambda c: F.expr(c).cast("int") % 3
    g = F.array((F.col("o_orderkey") % 3).cast("int"), three("floor(o_totalprice)"), three("month(o_orderdate)"), three("substr(o_orderpriority, 1, 1)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), g.alias("g"))


#: A wider matrix: digits to the base 3 of three columns, the month and the priority.
DIGITS = [(c, 3**k) for c in ("o_orderkey", "o_custkey", "floor(o_totalprice)") for k in range(4)]
WIDE = len(DIGITS) + 2
WIDE_NAMES = [f"n{i}" for i in range(WIDE)]
W_SQL = f"""w0 AS (SELECT o_orderkey AS sid, CAST(o_orderstatus = 'F' AS INTEGER) AS status,
  [{', '.join(f'CAST(CAST({c} AS BIGINT) // {d} % 3 AS INTEGER)' for c, d in DIGITS)}, CAST(month(o_orderdate) AS INTEGER) % 3, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3] AS g FROM orders),
m AS (SELECT sid, CASE WHEN sid % 7 < 5 THEN CAST((g[1] + g[6]) % 3 = 0 AS INTEGER) ELSE status END AS label, g FROM w0)"""
WP_SQL = f"p(f1, f2) AS (SELECT a.i, b.i FROM range({WIDE}) a(i), range({WIDE}) b(i) WHERE a.i < b.i)"


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen features of orders; the label of most rows tells of features 0 and 5 together."""
    digits = [F.expr(f"CAST(CAST({c} AS BIGINT) DIV {d} % 3 AS INT)") for c, d in DIGITS]
    g = F.array(*digits, F.expr("CAST(month(o_orderdate) AS INT) % 3"), F.expr("CAST(substr(o_orderpriority, 1, 1) AS INT) % 3"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_orderstatus") == "F").cast("int").alias("status"), g.alias("g"))
    planted = ((F.col("g")[0] + F.col("g")[5]) % 3 == 0).cast("int")
    return rows.select("sid", F.when(F.col("sid") % 7 < 5, planted).otherwise(F.col("status")).alias("label"), "g")


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, ig): parts and suppliers that meet in three rows or more."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").count().where("count >= 3")
    return counts.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), (F.col("count") / 200).alias("ig"))


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "f1 int, f2 int")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), (1 - F.col("quality")).alias("prediction"))
    return splits.kfold(rows, FOLDS, SEED, "doc_id")


# ---------------------------------------------------------------- pairs


@query(f"WITH {CELLS_SQL} SELECT * FROM cells WHERE v1 IS NOT NULL AND v2 IS NOT NULL AND ctl + cas > 0")
def pair_cells(spark, sf_dir):
    return pairs.pair_cells(matrix(spark, sf_dir), WIDTH)


@query(f"WITH {GAIN_SQL} SELECT f1, f2, {GAIN_COLS} FROM gains")
def pair_ig(spark, sf_dir):
    return rounded(pairs.pair_gains(matrix(spark, sf_dir), WIDTH).select("f1", "f2", "ig", "mi"), "ig", "mi")


@query(f"WITH {GAIN_SQL} SELECT f1, f2, {GAIN_COLS}, round(main_f2, 9) AS main_f2, round(main_f1, 9) AS main_f1 FROM gains")
def pair_main_effects(spark, sf_dir):
    return rounded(pairs.pair_gains(matrix(spark, sf_dir), WIDTH), "ig", "mi", "main_f2", "main_f1")


@query(f"WITH {M_SQL}, {P_SQL} SELECT f1 AS f1_i, g[f1 + 1] AS f1_v, f2 AS f2_i, g[f2 + 1] AS f2_v, CAST(label AS VARCHAR) AS l, count(*) AS n FROM m, p GROUP BY ALL")
def pair_models_sparse(spark, sf_dir):
    return pairs.sparse_models(matrix(spark, sf_dir).withColumn("label", F.col("label") + 1), WIDTH)


@query(f"WITH {GAIN_SQL} SELECT f1, f2, {GAIN_COLS} FROM gains WHERE f1 < 2 AND f2 >= 2")
def pair_ig_bipartite(spark, sf_dir):
    found = pairs.pair_gains(matrix(spark, sf_dir), WIDTH, left=range(0, 2), right=range(2, 4))
    return rounded(found.select("f1", "f2", "ig", "mi"), "ig", "mi")


@query(f"WITH {GAIN_SQL} SELECT f1, f2, {GAIN_COLS} FROM gains ORDER BY mi - main_f1 - main_f2 DESC, f1, f2 LIMIT 3")
def top_pairs(spark, sf_dir):
    found = pairs.pair_gains(matrix(spark, sf_dir), WIDTH)
    return rounded(found.orderBy(F.desc("ig"), "f1", "f2").limit(3).select("f1", "f2", "ig", "mi"), "ig", "mi")


@query(f"""WITH {M_SQL.replace("CAST(o_orderstatus = 'F' AS INTEGER) AS label", "CAST((o_orderkey % 3 + CAST(floor(o_totalprice) AS INTEGER) % 3) % 3 = 0 AS INTEGER) AS label")}, {GAIN_SQL.removeprefix(M_SQL + ", ")} SELECT f1, f2, {GAIN_COLS} FROM gains""")
def planted_pair_ig(spark, sf_dir):
    m = matrix(spark, sf_dir).withColumn("label", ((F.col("g")[0] + F.col("g")[1]) % 3 == 0).cast("int"))
    return rounded(pairs.pair_gains(m, WIDTH).select("f1", "f2", "ig", "mi"), "ig", "mi")


WIDE_CELLS_SQL = CELLS_SQL.replace(M_SQL, W_SQL).replace(P_SQL, WP_SQL)
WIDE_GAIN_SQL = GAIN_SQL.replace(M_SQL, W_SQL).replace(P_SQL, WP_SQL)


@query(f"WITH {WIDE_CELLS_SQL} SELECT CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, v1, v2, ctl, cas FROM cells")
def wide_pair_cells(spark, sf_dir):
    """91 pairs: counted by matrix products."""
    return pairs.pair_cells(wide_matrix(spark, sf_dir), WIDE).select("f1", "f2", "v1", "v2", F.col("ctl").cast("long").alias("ctl"), F.col("cas").cast("long").alias("cas"))


@query(f"WITH {WIDE_GAIN_SQL} SELECT CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, {GAIN_COLS} FROM gains")
def wide_pair_ig(spark, sf_dir):
    return rounded(pairs.pair_gains(wide_matrix(spark, sf_dir), WIDE).select("f1", "f2", "ig", "mi"), "ig", "mi")


@query(f"WITH {WIDE_GAIN_SQL} SELECT 'n' || f1 AS a, 'n' || f2 AS b, max(round(mi - main_f1 - main_f2, 9)) AS ig FROM gains WHERE (f1 < 7) = (f2 < 7) AND round(mi - main_f1 - main_f2, 9) >= 0.0002 GROUP BY ALL")
def merged_networks(spark, sf_dir):
    """The networks of two blocks of columns, one of them given twice and turned round, as one."""
    m = wide_matrix(spark, sf_dir)
    block = lambda lo, hi, one, two: pairs.pair_gains(m.withColumn("g", F.slice("g", lo + 1, hi - lo)), hi - lo).select(F.concat(F.lit("n"), F.col("f1") + lo).alias(one), F.concat(F.lit("n"), F.col("f2") + lo).alias(two), F.round("ig", 9).alias("ig"))
    found = graph.merge_networks([block(0, 7, "a", "b"), block(7, WIDE, "a", "b"), block(0, 7, "b", "a")], "ig", 0.0002)
    number = lambda c: F.substring(c, 2, 9).cast("int")
    turn = number("a") > number("b")
    return found.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), "ig")


# ---------------------------------------------------------------- thresholds and graphs


@query(f"WITH {G_SQL} SELECT a, b, ig FROM e WHERE ig >= 0.02")
def ig_threshold(spark, sf_dir):
    return network(spark, sf_dir).where("ig >= 0.02")


HALF = "round_even({x} / power(2, floor(log2({x})) - 10), 0) * power(2, floor(log2({x})) - 10)"


@query(f"WITH {G_SQL} SELECT a, b, ig FROM (SELECT a, b, {HALF.format(x='ig')} AS h, ig FROM e) WHERE h >= (SELECT {HALF.format(x='0.02')})")
def ig_threshold_half(spark, sf_dir):
    edges = network(spark, sf_dir).where(fn.half_guard(F.col("ig"), 0.02))
    return edges.where(fn.half(F.col("ig")) >= fn.half(F.lit(0.02)))


@query(f"WITH {G_SQL}, t(th) AS (VALUES (0.015::DOUBLE), (0.02), (0.025), (0.03)) SELECT th, count(*) AS edges, round(sum(ig), 6) AS total FROM e, t WHERE ig >= th GROUP BY th")
def threshold_sweep(spark, sf_dir):
    ths = F.array(*[F.lit(t) for t in THRESHOLDS])
    rows = network(spark, sf_dir).select("ig", F.explode(F.filter(ths, lambda t: F.col("ig") >= t)).alias("th"))
    return rows.groupBy("th").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("ig"), 6).alias("total"))


@query("""WITH e AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_orderkey * 10 + l_linenumber AS place, l_quantity AS ig FROM lineitem)
SELECT a, b, ig FROM (SELECT a, b, ig, row_number() OVER (PARTITION BY a, b ORDER BY place DESC, ig DESC) AS k FROM e) WHERE k = 1""")
def edge_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").alias("ig"))
    return graph.canonical_edges(rows)


@query(f"WITH RECURSIVE {COMP_SQL} SELECT node, component FROM comp")
def components(spark, sf_dir):
    return graph.connected_components(network(spark, sf_dir))


@query(f"WITH RECURSIVE {COMP_SQL} SELECT rank, size FROM sizes")
def component_sizes(spark, sf_dir):
    return graph.ranked_components(graph.connected_components(network(spark, sf_dir))).select("rank", "size")


@query(f"WITH RECURSIVE {COMP_SQL} SELECT rank, size, node FROM comp JOIN sizes USING (component) WHERE size >= 3")
def large_components(spark, sf_dir):
    return graph.large_components(network(spark, sf_dir), 3)


@query(f"WITH RECURSIVE {COMP_SQL} SELECT rank, e.a, e.b, ig FROM e JOIN comp ON comp.node = e.a JOIN sizes USING (component) WHERE size >= 3")
def component_edges(spark, sf_dir):
    edges = stage(network(spark, sf_dir), "network")
    return graph.component_edges(edges, graph.large_components(edges, 3)).select("rank", "a", "b", "ig")


@query(f"WITH {G_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node) SELECT degree, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 9) AS share FROM d GROUP BY degree")
def degree_histogram(spark, sf_dir):
    return rounded(graph.degree_histogram(network(spark, sf_dir)), "share")


STATS_SQL = f"""WITH RECURSIVE {G_SQL}, t(th) AS (VALUES (0.02::DOUBLE), (0.025), (0.03)), te AS (SELECT th, a, b FROM e, t WHERE ig >= th),
both_ AS (SELECT th, a, b FROM te UNION SELECT th, b, a FROM te),
reach AS (SELECT DISTINCT th, a AS node, a AS least FROM both_ UNION SELECT both_.th, both_.b, least FROM reach JOIN both_ ON both_.th = reach.th AND both_.a = node WHERE least < both_.b),
comp AS (SELECT th, node, min(least) AS component FROM reach GROUP BY ALL),
sizes AS (SELECT th, component, count(*) AS size, row_number() OVER (PARTITION BY th ORDER BY count(*) DESC, component) AS k FROM comp GROUP BY th, component),
deg AS (SELECT th, a AS node, count(*) AS degree FROM both_ GROUP BY ALL)
SELECT th, (SELECT count(*) FROM comp c WHERE c.th = t.th) AS nodes, (SELECT count(*) FROM te WHERE te.th = t.th) AS edges, (SELECT count(*) FROM sizes s WHERE s.th = t.th) AS components,
  (SELECT max(degree) FROM deg WHERE deg.th = t.th) AS largest_hub, (SELECT size FROM sizes s WHERE s.th = t.th AND k = 1) AS lc_nodes,
  (SELECT count(*) FROM te JOIN comp c ON c.th = te.th AND c.node = te.a JOIN sizes s ON s.th = c.th AND s.component = c.component WHERE te.th = t.th AND k = 1) AS lc_edges,
  (SELECT max(degree) FROM deg JOIN comp c ON c.th = deg.th AND c.node = deg.node JOIN sizes s ON s.th = c.th AND s.component = c.component WHERE deg.th = t.th AND k = 1) AS lc_largest_hub
FROM t WHERE EXISTS (SELECT 1 FROM te WHERE te.th = t.th)"""


@query(STATS_SQL)
def network_stats(spark, sf_dir):
    return graph.sweep_statistics(network(spark, sf_dir), "ig", [0.02, 0.025, 0.03])[0]


SWEEP = [round(0.03 - 0.0002 * i, 4) for i in range(76)]


@query(STATS_SQL.replace("t(th) AS (VALUES (0.02::DOUBLE), (0.025), (0.03))", f"t(th) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in SWEEP)})"))
def network_sweep(spark, sf_dir):
    """Statistics at all 76 thresholds, from one maximum spanning forest."""
    return forest.threshold_statistics(stage(forest.threshold_nodes(network(spark, sf_dir), "ig", SWEEP), "nodes"))


@query(f"""WITH {G_SQL}, t(th) AS (VALUES (0.015::DOUBLE), (0.02), (0.025)), te AS (SELECT th, a, b FROM e, t WHERE ig >= th),
d AS (SELECT th, node, count(*) AS degree FROM (SELECT th, a AS node FROM te UNION ALL SELECT th, b FROM te) GROUP BY ALL)
SELECT th, count(DISTINCT degree) AS degrees, count(DISTINCT degree) > 1 AS stationary FROM d GROUP BY th""")
def power_law_fit(spark, sf_dir):
    """Whether the fitted power law of the degrees is a least squares fit: both derivatives are 0 there."""
    ths = F.array(*[F.lit(t) for t in (0.015, 0.02, 0.025)])
    tagged = network(spark, sf_dir).select("a", "b", F.explode(F.filter(ths, lambda t: F.col("ig") >= t)).alias("th"))
    h = stage(graph.degree_histogram(tagged, ["th"]), "histogram")
    x, power = F.col("degree").cast("double"), F.pow(F.col("degree").cast("double"), -F.col("b"))
    gap = F.col("a") * power - F.col("share")
    sums = h.join(graph.power_law(h, ["th"]), "th").groupBy("th").agg(F.count(F.lit(1)).alias("degrees"), F.sum(gap * power).alias("by_a"), F.sum(-gap * F.col("a") * F.log(x) * power).alias("by_b"))
    return sums.select("th", "degrees", F.coalesce((F.abs("by_a") < 1e-7) & (F.abs("by_b") < 1e-7), F.lit(False)).alias("stationary"))


@query()
def threshold_study(spark, sf_dir):
    """Statistics and power-law exponents at 76 thresholds, of the graph and its largest component."""
    nodes = stage(forest.threshold_nodes(network(spark, sf_dir), "ig", SWEEP), "nodes")
    stats = forest.threshold_statistics(nodes)
    whole = graph.power_law(forest.degree_shares(nodes), ["th"]).select("th", F.col("b").alias("power_coeff"))
    lc = graph.power_law(forest.degree_shares(forest.in_largest(nodes)), ["th"]).select("th", F.col("b").alias("lc_power_coeff"))
    return stats.join(whole, "th", "left").join(lc, "th", "left")


# ---------------------------------------------------------------- splits


@query(f"WITH {M_SQL} SELECT sid, (row_number() OVER (ORDER BY {FOLD_SQL}, sid) - 1) % 5 AS fold FROM m")
def kfold(spark, sf_dir):
    return splits.kfold(matrix(spark, sf_dir), FOLDS, SEED).select("sid", F.col("fold").cast("long").alias("fold"))


@query(f"WITH {M_SQL} SELECT sid, label, (row_number() OVER (PARTITION BY label ORDER BY {FOLD_SQL}, sid) - 1) % 5 AS fold FROM m")
def stratified_kfold(spark, sf_dir):
    return splits.kfold(matrix(spark, sf_dir), FOLDS, SEED, by=["label"]).select("sid", "label", F.col("fold").cast("long").alias("fold"))


@query(f"WITH {M_SQL} SELECT sid, label, row_number() OVER (PARTITION BY label ORDER BY {FOLD_SQL}, sid) <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM m")
def holdout_split(spark, sf_dir):
    return splits.holdout(matrix(spark, sf_dir), 0.2, SEED).select("sid", "label", "is_test")


@query(f"WITH {M_SQL}, r AS (SELECT sid, row_number() OVER (ORDER BY {FOLD_SQL}, sid) AS rank, count(*) OVER () AS n FROM m) SELECT sid, CAST(ceil(rank * 7 / n) - 1 AS INTEGER) AS chunk FROM r")
def balanced_chunks(spark, sf_dir):
    return splits.chunks(splits.shuffled_rank(matrix(spark, sf_dir), SEED, "sid"), 7).select("sid", "chunk")


# ---------------------------------------------------------------- signs and delta degrees

SIGN_SQL = f"""{M_SQL}, e(f1, f2) AS (VALUES (0, 1), (1, 2), (2, 3), (0, 3)),
folds AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {FOLD_SQL}, sid) - 1) % 5 AS fold FROM m),
train AS (SELECT * FROM folds WHERE fold <> 0), ratio AS (SELECT count(*) FILTER (label = 1)::DOUBLE / count(*) FILTER (label = 0) AS r FROM train),
signs AS (SELECT f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, CASE WHEN count(*) FILTER (label = 0) * any_value(r) >= count(*) FILTER (label = 1) THEN 1 ELSE -1 END AS sign FROM train, e, ratio GROUP BY f1, f2, g[f1 + 1], g[f2 + 1])"""


def _delta_sql(where: str) -> str:
    return f"""WITH {SIGN_SQL}, x AS (SELECT sid, label, g, e.f1, e.f2 FROM folds, e WHERE {where}),
s AS (SELECT sid, label, x.f1, x.f2, coalesce(sign, 1) AS sign FROM x LEFT JOIN signs ON signs.f1 = x.f1 AND signs.f2 = x.f2 AND v1 = g[x.f1 + 1] AND v2 = g[x.f2 + 1]),
d AS (SELECT sid, label, f1 AS f, sign FROM s UNION ALL SELECT sid, label, f2, sign FROM s)
SELECT sid, label, {', '.join(f'CAST(coalesce(sum(sign) FILTER (f = {i}), 0) AS INTEGER) AS d{i}' for i in range(WIDTH))} FROM d GROUP BY sid, label"""


def folded(spark, sf_dir):
    return splits.kfold(matrix(spark, sf_dir), FOLDS, SEED, by=["label"])


def _delta(spark, sf_dir, where):
    rows = stage(folded(spark, sf_dir), "folds")
    edges = edge_table(spark)
    dd = pairs.delta_degrees(rows.where(where), edges, pairs.cell_signs(rows.where("fold <> 0"), edges), WIDTH)
    return dd.select("sid", "label", *[F.col("dd")[i].alias(f"d{i}") for i in range(WIDTH)])


@query(f"WITH {SIGN_SQL} SELECT * FROM signs")
def cell_sign(spark, sf_dir):
    return pairs.cell_signs(folded(spark, sf_dir).where("fold <> 0"), edge_table(spark))


@query(_delta_sql("fold <> 0"))
def delta_degree_train(spark, sf_dir):
    return _delta(spark, sf_dir, "fold <> 0")


@query(_delta_sql("fold = 0"))
def delta_degree_test(spark, sf_dir):
    return _delta(spark, sf_dir, "fold = 0")


@query(f"WITH {M_SQL} SELECT sid, label, 1 AS f, 'price' AS snp, g[2] AS v FROM m UNION ALL SELECT sid, label, 3, 'priority', g[4] FROM m")
def component_projection(spark, sf_dir):
    return pairs.project_nodes(matrix(spark, sf_dir), NAMES, spark.createDataFrame([("priority",), ("price",), ("unknown",)], "snp string"))


@query(f"WITH {M_SQL} SELECT sid, label, g[1] AS g0, g[2] AS g1, g[3] AS g2, g[4] AS g3 FROM m")
def subset_merge(spark, sf_dir):
    m = matrix(spark, sf_dir)
    both = pairs.merge_subsets(m.withColumn("g", F.slice("g", 1, 2)), m.withColumn("g", F.slice("g", 3, 2)))
    return both.select("sid", "label", *[F.col("g")[i].alias(f"g{i}") for i in range(WIDTH)])


@query("""WITH n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS at FROM (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part)), e AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT CAST(a.at AS INTEGER) AS f1, CAST(b.at AS INTEGER) AS f2 FROM e JOIN n a ON a.name = p_brand JOIN n b ON b.name = p_type""")
def edge_name_to_index(spark, sf_dir):
    """Edges between brands and types, by their places in the list of all names."""
    edges = table(spark, sf_dir, "part").select(F.col("p_brand").alias("snp1"), F.col("p_type").alias("snp2")).distinct()
    names = edges.select(F.explode(F.array("snp1", "snp2")).alias("name")).distinct().orderBy("name").collect()  # the header's names
    return pairs.name_edges_to_index(edges, [r["name"] for r in names])


# ---------------------------------------------------------------- reports


@query("SELECT toxic AS label, count(*) AS n, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 9) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf_dir):
    return rounded(reports.class_weights(table(spark, sf_dir, "labels"), "toxic"), "weight")


@query(f"WITH {F4_SQL}, {REPORT_SQL.format(k='fold,', g='fold')} SELECT fold, metric_row, {ROUND4} FROM report")
def confusion_report(spark, sf_dir):
    found = reports.classification_report(scored_labels(spark, sf_dir), ["fold"])
    return rounded(found, "precision", "recall", "f1", "support").withColumn("fold", F.col("fold").cast("long"))


@query(f"WITH {F4_SQL}, {REPORT_SQL.format(k='fold,', g='fold')} SELECT metric_row, {', '.join(f'round(avg({c}), 9) AS {c}' for c in ('precision', 'recall', 'f1', 'support'))} FROM report GROUP BY metric_row")
def fold_mean(spark, sf_dir):
    found = reports.fold_mean(reports.classification_report(scored_labels(spark, sf_dir), ["fold"]), [])
    return rounded(found, "precision", "recall", "f1", "support")


COHORT_SQL = F4_SQL.replace("s AS (SELECT", "s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS cohort,", 1)
STACK_SQL = f"WITH {COHORT_SQL}, {REPORT_SQL.format(k='cohort,', g='cohort')}"


def _cohorts(spark, sf_dir):
    rows = stage(scored_labels(spark, sf_dir), "scored")
    return reports.stack({"test": reports.classification_report(rows.where("doc_id % 3 = 0")), "train": reports.classification_report(rows.where("doc_id % 3 <> 0"))}, "cohort")


@query(f"{STACK_SQL} SELECT cohort, metric_row, {ROUND4} FROM report")
def report_stack(spark, sf_dir):
    return rounded(_cohorts(spark, sf_dir), "precision", "recall", "f1", "support")


@query(f"{STACK_SQL} SELECT metric_row, {', '.join(f'round(max({c}) FILTER (cohort = {chr(39)}{k}{chr(39)}), 9) AS {k}_{c}' for k in ('test', 'train') for c in ('precision', 'recall', 'f1', 'support'))} FROM report GROUP BY metric_row")
def cohort_pivot(spark, sf_dir):
    wide = reports.cohort_pivot(_cohorts(spark, sf_dir), ["test", "train"], [])
    return rounded(wide, *[c for c in wide.columns if c != "metric_row"])


@query(f"""WITH {M_SQL}, f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY {FOLD_SQL}, sid) - 1) % 5 AS fold FROM m)
SELECT model, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS cohort, CASE label WHEN 0 THEN 'control' ELSE 'case' END AS metric_row, count(*)::DOUBLE AS support FROM f, (VALUES ('logisticRegression'), ('decisionTree'), ('randomForest')) k(model) GROUP BY ALL""")
def ml_support(spark, sf_dir):
    """How many controls and cases each classifier's reports are about."""
    return ml_report(spark, sf_dir).where("metric_row IN ('control', 'case')").select("model", "cohort", "metric_row", "support")


@query()
def ml_report(spark, sf_dir):
    """Three classifiers on delta degrees learnt from training folds, scored on two cohorts."""
    rows = stage(folded(spark, sf_dir), "folds")
    edges = edge_table(spark)
    signs = stage(pairs.cell_signs(rows.where("fold <> 0"), edges), "signs")
    train, test = (stage(learn.counted(pairs.delta_degrees(rows.where(w), edges, signs, WIDTH), "dd"), "delta") for w in ("fold <> 0", "fold = 0"))
    return reports.stack({kind: learn.report(learn.fit(train, "dd", kind, "n"), {"train": train, "test": test}, "dd", "n") for kind in learn.KINDS}, "model")


# ---------------------------------------------------------------- search and permutations

RANK_SQL = """r AS (SELECT event_id, event_type, value, event_id = 0 AS is_real, 1 + coalesce(sum((event_id <> 0)::INTEGER) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM events)"""


def ranked_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("event_id") == 0).alias("is_real"))
    return search.permutation_rank(rows, [F.desc("value"), F.asc("event_id")], by=["event_type"])


@query(f"WITH {RANK_SQL} SELECT * FROM r")
def permutation_rank(spark, sf_dir):
    return ranked_events(spark, sf_dir)


@query(f"WITH {RANK_SQL}, n AS (SELECT event_type, count(*) FILTER (NOT is_real) AS n FROM r GROUP BY event_type) SELECT event_type, event_id, rank, round(rank / (n + 1.0), 4)::DOUBLE AS p_value FROM r JOIN n USING (event_type) WHERE is_real")
def permutation_pvalue(spark, sf_dir):
    return search.p_values(ranked_events(spark, sf_dir), by=["event_type"]).select("event_type", "event_id", "rank", "p_value")


@query("SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topn_per_level(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return search.top_per_level(rows, "event_type", 5, [F.desc("value"), F.asc("event_id")]).withColumn("rank", F.col("rank").cast("long"))


KWAY_SQL = f"""{M_SQL}, a(attributes, n_attributes, i, j, k) AS (VALUES {', '.join([f"('{i},{j}', 2, {i}, {j}, NULL)" for i in range(4) for j in range(i + 1, 4)] + [f"('{i},{j},{k}', 3, {i}, {j}, {k})" for i in range(4) for j in range(i + 1, 4) for k in range(j + 1, 4)])}),
n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM m),
cells AS (SELECT attributes, n_attributes, g[i + 1] AS x, g[j + 1] AS y, g[k + 1] AS z, count(*) FILTER (label = 0) AS ctl, count(*) FILTER (label = 1) AS cas FROM m, a GROUP BY ALL),
scores AS (SELECT attributes, n_attributes, coalesce(sum(cas) FILTER (cas * n0 > ctl * n1), 0) / any_value(n1) / 2 + coalesce(sum(ctl) FILTER (cas * n0 <= ctl * n1), 0) / any_value(n0) / 2 AS b FROM cells, n GROUP BY ALL)"""


@query(f"WITH {KWAY_SQL} SELECT attributes, n_attributes, round(b, 9) AS balanced_accuracy FROM scores")
def kway_search(spark, sf_dir):
    return rounded(search.kway_models(matrix(spark, sf_dir), WIDTH, [2, 3]), "balanced_accuracy")


@query(f"WITH {KWAY_SQL}, t AS (SELECT attributes, row_number() OVER (PARTITION BY n_attributes ORDER BY round(b, 9) DESC, attributes) AS k FROM scores) SELECT DISTINCT unnest(string_split(attributes, ',')) AS attribute FROM t WHERE k <= 1")
def distinct_top_attributes(spark, sf_dir):
    models = kway_search(spark, sf_dir)
    top = search.top_per_level(models, "n_attributes", 1, [F.desc("balanced_accuracy"), F.asc("attributes")])
    return search.distinct_attributes(top.withColumn("attributes", F.split("attributes", ",")))


def _keyed_gains(rows: str, key: str = "perm") -> str:
    """The gains of x (perm, g, label), by perm."""
    tail = GAIN_SQL.removeprefix(CELLS_SQL)
    cells = f"cells AS (SELECT {key}, f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, count(*) FILTER (label = 0) AS ctl, count(*) FILTER (label = 1) AS cas FROM x, p GROUP BY ALL)"
    return f"{rows}, {P_SQL}, {cells}" + tail.replace("f1, f2", f"{key}, f1, f2") + ", rounded AS (SELECT perm, f1, f2, round(mi - main_f1 - main_f2, 9) AS ig FROM gains)"


PERMUTED_SQL = _keyed_gains(f"""{M_SQL}, places AS (SELECT g, row_number() OVER (ORDER BY md5('{SEED}:place:' || sid), 'place:' || sid) AS r FROM m),
labs AS (SELECT perm, label, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}:' || perm || ':' || sid), perm || ':' || sid) AS r FROM m, range(10) t(perm)),
x AS (SELECT perm, g, label FROM places JOIN labs USING (r) UNION ALL SELECT -1, g, label FROM m)""")


@query(f"WITH {PERMUTED_SQL} SELECT CAST(perm AS INTEGER) AS perm, f1, f2, ig FROM rounded WHERE perm >= 0")
def permuted_gains(spark, sf_dir):
    """Gains of every pair under ten permutations of the labels, all counted in one pass."""
    return rounded(search.permuted_gains(matrix(spark, sf_dir), WIDTH, 10, SEED).select("perm", "f1", "f2", "ig"), "ig")


@query(f"WITH {PERMUTED_SQL} SELECT a.f1, a.f2, a.ig, 1 + count(*) FILTER (b.ig > a.ig) AS rank, round((1 + count(*) FILTER (b.ig > a.ig)) / 11.0, 4)::DOUBLE AS p_value FROM rounded a JOIN rounded b ON a.perm = -1 AND b.perm >= 0 AND a.f1 = b.f1 AND a.f2 = b.f2 GROUP BY a.f1, a.f2, a.ig")
def permutation_test(spark, sf_dir):
    """Pair gains under ten label permutations beside the real ones, ranked per pair, with p-values."""
    m = matrix(spark, sf_dir)
    real = pairs.pair_gains(m, WIDTH).select("f1", "f2", "ig", F.lit(True).alias("is_real"))
    many = search.permuted_gains(m, WIDTH, 10, SEED).select("f1", "f2", "ig", F.lit(False).alias("is_real"))
    ranked = search.permutation_rank(rounded(real.unionByName(many), "ig"), [F.desc("ig"), F.desc("is_real")], by=["f1", "f2"])
    return search.p_values(ranked, by=["f1", "f2"]).select("f1", "f2", "ig", "rank", "p_value")


EXPLICIT_SQL = _keyed_gains(f"""{M_SQL}, vals AS (SELECT perm, f, label, g[f + 1] AS v, row_number() OVER (PARTITION BY perm, f, label ORDER BY md5('{SEED}:' || perm || ':' || f || ':' || sid), perm || ':' || f || ':' || sid) AS r FROM m, range(5) t(perm), range({WIDTH}) u(f)),
x AS (SELECT perm, list(v ORDER BY f) AS g, label FROM vals GROUP BY perm, label, r UNION ALL SELECT -1, g, label FROM m)""")


@query(f"WITH {EXPLICIT_SQL} SELECT a.f1, a.f2, a.ig, count(*) FILTER (b.ig >= a.ig) AS n_above, round((1 + count(*) FILTER (b.ig >= a.ig)) / 6.0, 4)::DOUBLE AS p_value FROM rounded a JOIN rounded b ON a.perm = -1 AND b.perm >= 0 AND a.f1 = b.f1 AND a.f2 = b.f2 GROUP BY a.f1, a.f2, a.ig")
def explicit_test(spark, sf_dir):
    """The test of interaction that keeps main effects: features shuffled inside classes, five times."""
    return rounded(search.explicit_test(matrix(spark, sf_dir), WIDTH, 5, SEED), "ig")


ADJUSTED_SQL = GAIN_SQL.replace(
    CELLS_SQL,
    f"""{M_SQL}, {P_SQL}, lev AS (SELECT sid // 3 % 4 AS s, label, count(*) AS n FROM m GROUP BY ALL),
wt AS (SELECT s, label, sum(n) OVER (PARTITION BY s) * sum(n) OVER (PARTITION BY label) / (sum(n) OVER () * n) AS weight FROM lev),
cells AS (SELECT f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, coalesce(sum(weight) FILTER (m.label = 0), 0) AS ctl, coalesce(sum(weight) FILTER (m.label = 1), 0) AS cas FROM m JOIN wt ON wt.s = sid // 3 % 4 AND wt.label = m.label, p GROUP BY ALL)""",
)


@query(f"WITH {ADJUSTED_SQL} SELECT f1, f2, round(mi - main_f1 - main_f2, 8) AS ig, round(mi, 8) AS mi FROM gains")
def covariate_adjusted_ig(spark, sf_dir):
    """Gains in which label and a covariate of four levels are made independent."""
    m = matrix(spark, sf_dir).withColumn("level", F.expr("sid DIV 3 % 4"))
    return pairs.adjusted_gains(m, WIDTH, "level").select("f1", "f2", F.round("ig", 8).alias("ig"), F.round("mi", 8).alias("mi"))


CV_SQL = KWAY_SQL.split("n AS (SELECT")[0] + f"""folds AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {FOLD_SQL}, sid) - 1) % 5 AS fold FROM m),
c AS (SELECT attributes, n_attributes, g[i + 1] AS x, g[j + 1] AS y, g[k + 1] AS z, fold, count(*) FILTER (label = 0) AS ctl, count(*) FILTER (label = 1) AS cas FROM folds, a GROUP BY ALL),
r AS (SELECT t, attributes, n_attributes, x, y, z, coalesce(sum(ctl) FILTER (fold <> t), 0) AS r0, coalesce(sum(cas) FILTER (fold <> t), 0) AS r1, coalesce(sum(ctl) FILTER (t = -1 OR fold = t), 0) AS t0, coalesce(sum(cas) FILTER (t = -1 OR fold = t), 0) AS t1 FROM c, range(-1, 5) f(t) GROUP BY ALL),
n AS (SELECT t, attributes, sum(r0) AS a0, sum(r1) AS a1, sum(t0) AS b0, sum(t1) AS b1 FROM r GROUP BY ALL),
q AS (SELECT t, attributes, n_attributes, (coalesce(sum(r1) FILTER (r1 * a0 > r0 * a1), 0) / any_value(a1) + coalesce(sum(r0) FILTER (r1 * a0 <= r0 * a1), 0) / any_value(a0)) / 2 AS training, (coalesce(sum(t1) FILTER (r1 * a0 > r0 * a1), 0) / any_value(b1) + coalesce(sum(t0) FILTER (r1 * a0 <= r0 * a1), 0) / any_value(b0)) / 2 AS testing FROM r JOIN n USING (t, attributes) GROUP BY ALL),
w AS (SELECT *, CAST(t >= 0 AND row_number() OVER (PARTITION BY t, n_attributes ORDER BY round(training, 9) DESC, attributes) = 1 AS BIGINT) AS won FROM q)"""


@query(f"WITH {CV_SQL} SELECT attributes, n_attributes, round(avg(training) FILTER (t >= 0), 9) AS cv_training, round(avg(testing) FILTER (t >= 0), 9) AS cv_testing, CAST(sum(won) AS BIGINT) AS cvc, round(max(training) FILTER (t = -1), 9) AS overall FROM w GROUP BY ALL")
def kway_cross_validated(spark, sf_dir):
    """Every combination of two and three features, five-fold, with its consistency count."""
    return rounded(search.kway_cross_validated(folded(spark, sf_dir), WIDTH, [2, 3], FOLDS), "cv_training", "cv_testing", "overall")


WIDE_KWAY_SQL = f"""{W_SQL}, a AS (SELECT x.i || ',' || y.i || ',' || z.i AS attributes, 3 AS n_attributes, x.i AS i, y.i AS j, z.i AS k FROM range({WIDE}) x(i), range({WIDE}) y(i), range({WIDE}) z(i) WHERE x.i < y.i AND y.i < z.i), """ + "n AS (SELECT" + KWAY_SQL.split("n AS (SELECT")[1]


@query(f"WITH {WIDE_KWAY_SQL} SELECT attributes, n_attributes, round(b, 9) AS balanced_accuracy FROM scores")
def wide_kway_search(spark, sf_dir):
    """364 combinations of three features: exploded feature by feature."""
    return rounded(search.kway_models(wide_matrix(spark, sf_dir), WIDE, [3]), "balanced_accuracy")


@query()
def network_study(spark, sf_dir):
    """The whole study on the wide matrix: scored, thresholded, components re-encoded, classified over
    two folds on raw features and delta degrees, both cohorts scored, folds averaged."""
    return study(wide_matrix(spark, sf_dir), WIDE_NAMES, 0.05, 2, 2, SEED)


# ---------------------------------------------------------------- scalars and text


@query("SELECT CAST(f1_i AS INTEGER) AS f1_i, f1_v, CAST(f2_i AS INTEGER) AS f2_i, f2_v, l, n FROM (SELECT 0 AS f1_i, CAST(o_orderkey % 3 AS INTEGER) AS f1_v, 1 AS f2_i, CAST(o_custkey % 3 AS INTEGER) AS f2_v, CASE o_orderkey % 2 + 1 WHEN 1 THEN '0' ELSE '1' END AS l, count(*) AS n FROM orders GROUP BY ALL)")
def label_recode(spark, sf_dir):
    """Labels 1 and 2 become '0' and '1' in sparse models; any other would be an error."""
    g = F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("label"), g.alias("g"))
    return pairs.sparse_models(rows, 2)


@query("SELECT 0 AS f1, 1 AS f2, v1, v2, count(*) FILTER (label = 0) AS ctl, count(*) FILTER (label = 1) AS cas FROM (SELECT CAST(o_orderkey % 5 AS INTEGER) AS v1, CAST(o_custkey % 4 AS INTEGER) AS v2, o_custkey % 3 AS label FROM orders) WHERE v1 < 3 AND v2 < 3 AND label < 2 GROUP BY ALL")
def genotype_domain_filter(spark, sf_dir):
    """Codes over 2 and labels over 1 fall in no cell."""
    g = F.array((F.col("o_orderkey") % 5).cast("int"), (F.col("o_custkey") % 4).cast("int"))
    return pairs.pair_cells(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_custkey") % 3).cast("int").alias("label"), g.alias("g")), 2)


@query("""SELECT page_id, string_split(string_split(url, '://')[2], '/')[1] AS host, string_split(url, '/')[-1] AS last, string_split(string_split(string_split(url, '/')[-1], '?')[1], '.')[1] AS stem, lpad(CAST(page_id AS VARCHAR), 7, '0') AS padded, right(url, 10) AS tail, len(string_split(url, '/')) - 1 AS slashes FROM pages""")
def name_parsing(spark, sf_dir):
    u = F.col("url")
    last = F.element_at(F.split(u, "/"), -1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.split_part(F.split_part(u, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), last.alias("last"),
        F.split_part(F.split_part(last, F.lit("?"), F.lit(1)), F.lit("."), F.lit(1)).alias("stem"),
        F.lpad(F.col("page_id").cast("string"), 7, "0").alias("padded"), F.right(u, F.lit(10)).alias("tail"), (F.size(F.split(u, "/")) - 1).cast("long").alias("slashes"),
    )


FILE = "'her_0.' || (p_partkey % 5) || '_maf_0.' || (p_partkey % 3 + 1) || '_EDM-' || (p_partkey % 4) || '_' || p_size || '.txt'"


@query(f"WITH f AS (SELECT p_partkey, {FILE} AS name FROM part) SELECT p_partkey, CAST(regexp_extract(name, 'her_([0-9.]*[0-9])', 1) AS DOUBLE) AS heritability, CAST(regexp_extract(name, 'maf_([0-9.]*[0-9])', 1) AS DOUBLE) AS maf, CAST(regexp_extract(name, 'EDM-([0-9]+)', 1) AS INTEGER) AS model, CAST(regexp_extract(name, 'EDM-[0-9]+_([0-9]+)', 1) AS INTEGER) AS replicate FROM f")
def filename_metadata(spark, sf_dir):
    name = F.expr(FILE)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in fn.simulation_fields(name).items()])


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id, turn, line, len(string_split(line, ' ')) AS fields FROM l WHERE trim(line) <> '' AND regexp_matches(line, '^[A-E]')""")
def text_line_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.where((F.trim("line") != "") & F.col("line").rlike("^[A-E]")).withColumn("fields", F.size(F.split("line", " ", -1)).cast("long"))


@query("""SELECT round(log2(l_quantity), 9) AS lg, printf('%.9f', l_discount) AS text, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, concat_ws(chr(9), l_returnflag, l_linestatus) AS joined, count(*) AS n FROM lineitem GROUP BY ALL""")
def scalar_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.round(F.log2("l_quantity"), 9).alias("lg"), F.format_string("%.9f", "l_discount").alias("text"), F.col("l_extendedprice").cast("long").alias("whole"), F.concat_ws("\t", "l_returnflag", "l_linestatus").alias("joined"))
    return rows.groupBy("lg", "text", "whole", "joined").agg(F.count(F.lit(1)).alias("n"))
