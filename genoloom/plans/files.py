"""Registered round trips of readers and writers, through the shared folder, with their SQL twins.

Each writes rows of the driver's tables in a format of the network engine and reads them back; the
twin takes the same rows from the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom import functions as fn
from genoloom import sources
from genoloom.operators import pairs, reports, search
from genoloom.operators.graph import sweep_statistics
from genoloom.plans.queries import CELLS_SQL, COHORT_SQL, F4_SQL, FOLDS, G_SQL, GAIN_SQL, KWAY_SQL, M_SQL, NAMES, RANK_SQL, REPORT_SQL, ROUND4, SIGN_SQL, STATS_SQL, WIDTH, edge_table, folded, kway_search, matrix, network, query, ranked_events, rounded, scored_labels, table
from genoloom.scratch import new_path, stage

PLACED_SQL = f"{M_SQL}, s AS (SELECT row_number() OVER (ORDER BY sid) - 1 AS place, * FROM m)"
G_SELECT = "g[1] AS g0, g[2] AS g1, g[3] AS g2, g[4] AS g3"


def _codes() -> list[Column]:
    return [F.col("g")[i].alias(f"g{i}") for i in range(WIDTH)]


def _written(spark: SparkSession, sf_dir: str, name: str, **options) -> str:
    path = new_path(spark, name)
    sources.write_matrix(matrix(spark, sf_dir), path, **({"names": NAMES} | options))
    return path


# ---------------------------------------------------------------- matrices


@query(f"WITH {PLACED_SQL} SELECT place, label, {G_SELECT} FROM s")
def matrix_csv(spark, sf_dir):
    """A headed matrix with its label in the middle; rows are numbered by their place in the files."""
    m, _ = sources.read_matrix_csv(spark, _written(spark, sf_dir, "csv", label="Labels", sep=",", place=2))
    return m.select(F.col("sid").alias("place"), "label", *_codes())


@query(f"WITH {PLACED_SQL} SELECT place, label, {G_SELECT} FROM s")
def matrix_tsv(spark, sf_dir):
    """A headless numeric matrix, the label last."""
    m = sources.read_matrix_tsv(spark, _written(spark, sf_dir, "tsv", header=False))
    return m.select(F.col("sid").alias("place"), "label", *_codes())


@query("SELECT 4 AS n_attributes, 'key,price,month,priority' AS names")
def header_peek(spark, sf_dir):
    """Attributes of a headed file, from its first line and by the reader."""
    path = _written(spark, sf_dir, "peek", label="Labels", sep=",", place=1)
    names = sources.read_matrix_csv(spark, path)[1]
    return spark.range(1).select(F.lit(sources.attribute_count(spark, path, ",")).alias("n_attributes"), F.lit(",".join(names)).alias("names"))


@query(f"WITH {GAIN_SQL} SELECT f1, f2, round(mi - main_f1 - main_f2, 9) AS ig, round(mi, 9) AS mi FROM gains WHERE f1 < 2 AND f2 >= 2")
def two_file_pairs(spark, sf_dir):
    """Gains of the pairs across two files of columns whose rows meet by place."""
    m = matrix(spark, sf_dir)
    paths = []
    for part, names in ((F.slice("g", 1, 2), NAMES[:2]), (F.slice("g", 3, 2), NAMES[2:])):
        paths.append(new_path(spark, "block"))
        sources.write_matrix(m.withColumn("g", part), paths[-1], names, label="Labels", sep=",")
    one, two = (sources.read_matrix_csv(spark, p)[0] for p in paths)
    found = pairs.pair_gains(pairs.join_blocks(one, two), WIDTH, left=range(0, 2), right=range(2, 4))
    return rounded(found.select("f1", "f2", "ig", "mi"), "ig", "mi")


@query(f"WITH {PLACED_SQL} SELECT place, label, {G_SELECT} FROM s")
def simulated_sets(spark, sf_dir):
    """A simulated set (TAB, label named target) recoded to commas with its label renamed and last."""
    source = new_path(spark, "simulated")
    m = matrix(spark, sf_dir)
    sources.write_matrix(m, source, NAMES, label="target", place=0)
    plain = spark.read.option("header", True).option("sep", "\t").csv(source)
    path = new_path(spark, "relabelled")
    sources.label_last(sources.in_file_order(plain)).write.option("header", True).csv(path)
    back, names = sources.read_matrix_csv(spark, path)
    assert names == NAMES
    return back.select(F.col("sid").alias("place"), "label", *_codes())


@query(f"WITH {M_SQL}, f AS (SELECT label, g, (row_number() OVER (PARTITION BY label ORDER BY md5('25:' || sid), sid) - 1) % 5 AS fold FROM m) SELECT fold, label, g[1] AS key, g[2] AS price, g[3] AS month, g[4] AS priority, count(*) AS n FROM f GROUP BY ALL")
def fold_files(spark, sf_dir):
    """Matrices with feature names, a folder for each fold."""
    rows = folded(spark, sf_dir)
    path = new_path(spark, "fold-files")
    sources.write_parts(rows.select("fold", *[F.col("g")[i].cast("string").alias(n) for i, n in enumerate(NAMES)], F.col("label").cast("string").alias("label")), path, "fold", fmt="csv")
    back = spark.read.schema(", ".join(f"{n} int" for n in [*NAMES, "label", "fold"])).csv(path)
    return back.groupBy(F.col("fold").cast("long").alias("fold"), "label", *NAMES).agg(F.count(F.lit(1)).alias("n"))


FOLD_DELTA_SQL = f"""{SIGN_SQL.split("train AS")[0]} k AS (SELECT * FROM range({FOLDS}) t(k)), ratio AS (SELECT k, count(*) FILTER (label = 1 AND fold <> k)::DOUBLE / count(*) FILTER (label = 0 AND fold <> k) AS r FROM folds, k GROUP BY k),
signs AS (SELECT k, f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, CASE WHEN count(*) FILTER (label = 0) * any_value(r) >= count(*) FILTER (label = 1) THEN 1 ELSE -1 END AS sign FROM folds JOIN ratio ON fold <> k, e GROUP BY k, f1, f2, v1, v2),
x AS (SELECT k, fold, sid, label, g, f1, f2 FROM folds, k, e),
s AS (SELECT x.k, fold, sid, label, x.f1, x.f2, coalesce(sign, 1) AS sign FROM x LEFT JOIN signs ON signs.k = x.k AND signs.f1 = x.f1 AND signs.f2 = x.f2 AND v1 = g[x.f1 + 1] AND v2 = g[x.f2 + 1]),
d AS (SELECT k, fold, sid, label, f1 AS f, sign FROM s UNION ALL SELECT k, fold, sid, label, f2, sign FROM s),
w AS (SELECT k, fold, sid, label, {", ".join(f"CAST(coalesce(sum(sign) FILTER (f = {i}), 0) AS INTEGER) AS d{i}" for i in range(WIDTH))} FROM d GROUP BY k, fold, sid, label)"""


@query(f"WITH {FOLD_DELTA_SQL} SELECT CAST(k AS INTEGER) AS fold, CASE WHEN fold = k THEN 'Test' ELSE 'Train' END AS cohort, label, d0, d1, d2, d3, count(*) AS n FROM w GROUP BY ALL")
def subject_network_files(spark, sf_dir):
    """Signed degrees under the signs of every fold, headed files by fold and cohort."""
    rows, edges = stage(folded(spark, sf_dir), "folds"), edge_table(spark)
    signs = stage(pairs.fold_signs(rows, edges, FOLDS), "signs")
    path = new_path(spark, "subject-networks")
    parts = []
    for k in range(FOLDS):
        encoded = pairs.delta_degrees(rows.withColumn("sid", F.struct("sid", "fold")), edges, signs.where(F.col("fold") == k), WIDTH)
        parts.append(encoded.select(F.lit(k).alias("fold"), F.when(F.col("sid.fold") == k, "Test").otherwise("Train").alias("cohort"), "label", "dd"))
    sources.write_subject_networks(reduce(DataFrame.unionByName, parts), path, WIDTH)
    back = sources.read_subject_networks(spark, path, WIDTH)
    return back.select("fold", "cohort", "label", *[F.col("dd")[i].alias(f"d{i}") for i in range(WIDTH)]).groupBy("fold", "cohort", "label", *[f"d{i}" for i in range(WIDTH)]).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- networks

NET_SQL = f"{G_SQL}, w AS (SELECT a AS snp1, b AS snp2, round(ig / 3, 9) AS ig, round(ig / 7, 9) AS mi FROM e)"


def _named(spark, sf_dir):
    return network(spark, sf_dir).select(F.col("a").alias("snp1"), F.col("b").alias("snp2"), (F.col("ig") / 3).alias("ig"), (F.col("ig") / 7).alias("mi"))


@query(f"WITH {NET_SQL} SELECT * FROM w")
def network_file(spark, sf_dir):
    """A headless network, nine decimals, split at white space."""
    path = new_path(spark, "network-file")
    sources.write_network(_named(spark, sf_dir), path)
    return sources.read_network(spark, path)


@query(f"WITH {NET_SQL} SELECT * FROM w")
def network_headed_file(spark, sf_dir):
    """A headed TSV edge list."""
    path = new_path(spark, "headed-network")
    sources.write_network(_named(spark, sf_dir), path, header=True)
    return sources.read_edges(spark, path)


@query(f"WITH {NET_SQL} SELECT snp1, snp2 FROM w")
def named_edges_file(spark, sf_dir):
    """The first two columns of a headless edge list with others, after a change of delimiter."""
    source, path = new_path(spark, "tabs"), new_path(spark, "commas")
    sources.write_network(_named(spark, sf_dir), source)
    sources.transcode(spark, source, path, "\t", ",")
    return sources.read_named_edges(spark, path)


@query("SELECT CAST(l_partkey AS INTEGER) AS f1, CAST(l_suppkey AS INTEGER) AS f2, count(*) AS n FROM lineitem GROUP BY ALL")
def index_edges_file(spark, sf_dir):
    """Index edges written as decimals."""
    path = new_path(spark, "index-edges")
    table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("double"), F.col("l_suppkey")).write.csv(path)
    return sources.read_index_edges(spark, path).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {G_SQL} SELECT DISTINCT a AS snp FROM e")
def node_list_file(spark, sf_dir):
    path = new_path(spark, "nodes")
    network(spark, sf_dir).select("a").distinct().write.csv(path)
    return sources.read_nodes(spark, path)


@query(f"WITH {CELLS_SQL} SELECT f1 AS f1_i, v1 AS f1_v, f2 AS f2_i, v2 AS f2_v, CAST(l AS VARCHAR) AS l, n FROM (SELECT f1, v1, f2, v2, 0 AS l, ctl AS n FROM cells UNION ALL SELECT f1, v1, f2, v2, 1, cas FROM cells) WHERE n > 0")
def models_file(spark, sf_dir):
    """Sparse pair models as headed CSV."""
    path = new_path(spark, "models")
    sources.write_models(pairs.sparse_models(matrix(spark, sf_dir).withColumn("label", F.col("label") + 1), WIDTH), path)
    return spark.read.schema("f1_i int, f1_v int, f2_i int, f2_v int, l string, n long").option("header", True).csv(path)


# ---------------------------------------------------------------- reports and statistics


@query(f"WITH {F4_SQL}, {REPORT_SQL.format(k='fold,', g='fold')} SELECT 'fold' || fold AS file, metric_row, {ROUND4} FROM report")
def report_files(spark, sf_dir):
    """A report file for each fold, read back by one pattern."""
    found = stage(reports.classification_report(scored_labels(spark, sf_dir), ["fold"]), "reports")
    root = new_path(spark, "reports")
    for fold in range(5):
        sources.write_report(found.where(F.col("fold") == fold), sources.result_path(root, fold=fold))
    back = sources.read_reports(spark, f"{root}/fold_*")
    out = back.withColumn("file", F.concat(F.lit("fold"), F.regexp_extract(F.col("path"), "/fold_([0-9]+)/", 1)))
    return rounded(out.drop("path"), "precision", "recall", "f1", "support")


@query(f"WITH {COHORT_SQL}, {REPORT_SQL.format(k='cohort,', g='cohort')} SELECT cohort, metric_row, {ROUND4} FROM report")
def two_level_report(spark, sf_dir):
    """Reports of two cohorts in one file, whose rows are named by row and cohort."""
    rows = stage(scored_labels(spark, sf_dir), "scored")
    found = reports.stack({"test": reports.classification_report(rows.where("doc_id % 3 = 0")), "train": reports.classification_report(rows.where("doc_id % 3 <> 0"))}, "cohort")
    path = new_path(spark, "cohort-reports")
    sources.write_report(found, path, ["cohort"])
    return rounded(sources.read_reports(spark, path, ["cohort"]).drop("file", "path"), "precision", "recall", "f1", "support")


@query(STATS_SQL)
def statistics_file(spark, sf_dir):
    """Statistics of a sweep as text."""
    path = new_path(spark, "statistics")
    stats = sweep_statistics(network(spark, sf_dir), "ig", [0.02, 0.025, 0.03])[0]
    sources.write_statistics(stats, path)
    return spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)).option("header", True).option("sep", "\t").csv(path)


# ---------------------------------------------------------------- search outputs


@query(f"WITH {RANK_SQL} SELECT CASE WHEN NOT is_real THEN rank END AS rank, is_real, event_type, event_id FROM r WHERE event_type = (SELECT event_type FROM events WHERE event_id = 0)")
def permutation_file(spark, sf_dir):
    """The collated file of a permutation study; the unpermuted row is told by its marker."""
    kind = table(spark, sf_dir, "events").where("event_id = 0").first()["event_type"]
    ranked = stage(ranked_events(spark, sf_dir).where(F.col("event_type") == kind), "ranked")
    jobs = spark.createDataFrame([("done", 1, 1)], "state string, expected long, found long")
    path = new_path(spark, "collated")
    sources.write_permutation_report(ranked, search.p_values(ranked), search.job_states(jobs), path, ["event_type", "event_id"])
    back = sources.read_permutation_report(spark, path, "event_type string, event_id long")
    return back.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {KWAY_SQL}, t AS (SELECT n_attributes, attributes, row_number() OVER (PARTITION BY n_attributes ORDER BY round(b, 9) DESC, attributes) AS k FROM scores) SELECT DISTINCT l.n_attributes, t.attributes FROM t JOIN t l ON t.n_attributes <= l.n_attributes WHERE t.k <= 2")
def top_model_files(spark, sf_dir):
    """The best models' attribute lists, a folder for each number of attributes with those of fewer too."""
    top = search.top_per_level(kway_search(spark, sf_dir), "n_attributes", 2, [F.desc("balanced_accuracy"), F.asc("attributes")])
    path = new_path(spark, "top")
    sources.write_top_models(top.withColumn("attributes", F.split("attributes", ",")), path)
    return spark.read.schema("value string, n_attributes int").text(path).select("n_attributes", F.col("value").alias("attributes"))


@query(f"WITH {KWAY_SQL}, b AS (SELECT round(max(b), 9) AS best FROM scores) SELECT attributes, n_attributes, round(b, 9) AS balanced_accuracy FROM scores WHERE NOT contains(attributes, '3')")
def reanalysed_search(spark, sf_dir):
    """The search again, over the attributes of given models only."""
    top = spark.createDataFrame([(["0", "1"],), (["2"],)], "attributes array<string>")
    return rounded(search.reanalysed(matrix(spark, sf_dir), WIDTH, [2, 3], top), "balanced_accuracy")


RESULTS_SQL = "r AS (SELECT CAST(l_partkey AS VARCHAR) AS attributes, max(l_quantity) AS cv_testing, count(*) AS cvc, min(l_quantity) AS model_testing, sum(l_extendedprice) AS overall FROM lineitem GROUP BY l_partkey)"
ORDERS = {"cv_test": "cv_testing DESC, cvc DESC, ", "cvc_cv_test": "cvc DESC, cv_testing DESC, ", "cvc_model_test": "cvc DESC, model_testing DESC, ", "single": ""}


@query(f"WITH {RESULTS_SQL} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, attributes, rank FROM (SELECT attributes, row_number() OVER (ORDER BY {first}overall DESC, attributes) AS rank FROM r) WHERE rank <= 20" for kind, first in ORDERS.items()))
def search_result_order(spark, sf_dir):
    """The twenty best search results in each of the four orders of measures."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.array(F.col("l_partkey").cast("string")).alias("attributes")).agg(F.max("l_quantity").alias("cv_testing"), F.count(F.lit(1)).alias("cvc"), F.min("l_quantity").alias("model_testing"), F.sum("l_extendedprice").alias("overall"))
    rows = stage(rows, "results")
    tops = [search.top_per_level(rows.withColumn("kind", F.lit(kind)), "kind", 20, search.search_order(kind)) for kind in ORDERS]
    return reduce(DataFrame.unionByName, tops).select("kind", F.array_join("attributes", ",").alias("attributes"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- lines of text


@query("""WITH l AS (SELECT 'c' || (conv_id % 3) || '.txt' AS file, unnest(string_split(replace(text, chr(9), ' '), chr(10))) AS line FROM conversations WHERE text IS NOT NULL)
SELECT file, line, count(*) AS n FROM l WHERE trim(line) <> '' AND regexp_matches(line, '^[A-E]') GROUP BY ALL""")
def line_files(spark, sf_dir):
    """Lines of files at any depth under a folder that match a pattern; blank ones are skipped."""
    root = new_path(spark, "lines")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") % 3).alias("k"), F.replace("text", F.lit("\t"), F.lit(" ")).alias("value"))
    rows.write.partitionBy("k").option("lineSep", "\n").text(root)
    found = sources.read_lines(spark, root, pattern="^[A-E]")
    return found.groupBy(F.concat(F.lit("c"), F.regexp_extract("file", "/k=([0-9]+)/", 1), F.lit(".txt")).alias("file"), F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS tail FROM events")
def search_lines(spark, sf_dir):
    """Search output lines as columns: a trailing empty field counts, another number of fields is an error."""
    path = new_path(spark, "search-lines")
    rows = table(spark, sf_dir, "events")
    rows.select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", F.when(F.col("event_id") % 2 == 0, "").otherwise("x"))).write.text(path)
    return sources.search_rows(sources.read_lines(spark, path), ["id", "kind", "tail"]).drop("file")


@query("SELECT sum(len(replace(url, 'example', 'x')) + 1)::BIGINT AS chars, 0::BIGINT AS left_over FROM pages WHERE url IS NOT NULL")
def replaced_text(spark, sf_dir):
    """Whole files with a literal replaced."""
    path = new_path(spark, "replace")
    table(spark, sf_dir, "pages").where("url IS NOT NULL").select("url").write.text(path)
    found = sources.replace_text(spark, path, "example", "x")
    return found.agg(F.sum(F.length("value")).cast("long").alias("chars"), F.count_if(F.col("value").contains("example")).alias("left_over"))


@query("SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem FROM pages")
def file_stems(spark, sf_dir):
    """Names of files without folders and last suffix."""
    return table(spark, sf_dir, "pages").select("page_id", fn.file_stem(F.col("url")).alias("stem"))


@query("SELECT p_partkey, printf('%.4f', 0.015 + 0.0002 * p_size) AS th, ceil(p_size / 7.0)::BIGINT AS up, pow(2, p_size % 9)::BIGINT AS power, least(p_size, 40) AS low, greatest(p_size, 40) AS high, round(p_size / 7.0, 4)::DOUBLE AS part, len(range(p_size)) AS steps, list_sum(range(p_size))::BIGINT AS total FROM part")
def numeric_functions(spark, sf_dir):
    """Sequences, rounding, powers, extremes of each part's size."""
    i = F.col("p_size")
    steps = F.transform(F.sequence(F.lit(1), i), lambda k: k - 1)
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, k: a + k)
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.4f", 0.015 + 0.0002 * i).alias("th"), F.ceil(i / 7).alias("up"), F.pow(F.lit(2.0), i % 9).cast("long").alias("power"), F.least(i, F.lit(40)).alias("low"), F.greatest(i, F.lit(40)).alias("high"), F.round(i / 7, 4).alias("part"), F.size(steps).cast("long").alias("steps"), total.alias("total"))
