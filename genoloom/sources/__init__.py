"""Readers and writers of matrices, networks, lists, reports and search outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NETWORK = "snp1 string, snp2 string, ig double, mi double"
#: Fixed value: what stands for the rank of the unpermuted row in collated files.
REAL = "=====>"
REPORT = "metric_row string, precision double, recall double, f1 double, support double"


def _numbered(lines: DataFrame, name: str = "sid") -> DataFrame:
    """Rows of a file scan with sid (or ``name``), their number from 0: files in path order, lines in file order.

    Rows of a split lie together in one task, so a row's number is its distance from the split's
    first row plus the rows of all splits before it. Splits are counted, rows are not moved, and the
    numbers do not depend on how the files are split.
    """
    rows = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_place"))
    splits = rows.groupBy("_file", "_from").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return rows.join(splits, ["_file", "_from"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_file", "_from", "_place", "_before")


def in_file_order(lines: DataFrame) -> DataFrame:
    """Rows of a file scan in the order of files and lines, so that files written from them keep it.

    A scan itself deals out files by size, the largest first.
    """
    return _numbered(lines, "_at").orderBy("_at").drop("_at")


def attribute_count(spark: SparkSession, path: str, sep: str = "\t") -> int:
    """Attributes of a headed file: the fields of its first line less the label."""
    first = spark.read.text(path).limit(1).select(F.size(F.split("value", sep, -1)).alias("n")).first()
    return first["n"] - 1 if first else 0


def read_matrix_csv(spark: SparkSession, path: str, label: str = "Labels", sep: str = ",") -> tuple[DataFrame, list[str]]:
    """(sid, label, g) and the feature names of a headed genotype file; the label column may stand
    anywhere. Codes are read as integers; a cell that is none becomes null and falls in no bucket."""
    header = spark.read.option("header", True).option("sep", sep).csv(path)
    names = [c for c in header.columns if c != label]
    g = F.array(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").cast("int") for c in names])
    return _numbered(header).select("sid", F.col(f"`{label}`").cast("double").cast("int").alias("label"), g.alias("g")), names


def read_matrix_tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(sid, label, g) of a headless numeric file whose last column is the label; any cell that is
    blank or no number is an error."""
    cells = F.split(F.col("value"), sep, -1).cast("array<double>").cast("array<int>")
    rows = _numbered(spark.read.text(path)).select("sid", cells.alias("c"))
    return rows.select("sid", F.element_at("c", -1).alias("label"), F.slice("c", 1, F.size("c") - 1).alias("g"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """NETWORK rows of a headless file, split at any white space."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(p[0].alias("snp1"), p[1].alias("snp2"), p[2].cast("double").alias("ig"), p[3].cast("double").alias("mi"))


def read_edges(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    return spark.read.schema(NETWORK).option("header", header).option("sep", sep).option("mode", "FAILFAST").csv(path)


def read_index_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    rows = spark.read.schema("f1 double, f2 double").option("sep", sep).option("mode", "FAILFAST").csv(path)
    return rows.select(F.col("f1").cast("int").alias("f1"), F.col("f2").cast("int").alias("f2"))


def read_named_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(snp1, snp2) of a headless edge list: its first two columns, whatever follows."""
    p = F.split("value", sep, -1)
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(p[0]).alias("snp1"), F.trim(F.get(p, F.lit(1))).alias("snp2"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("snp string").csv(path)


def read_reports(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """REPORT rows of all files under a path or pattern, with each one's name (file) and path. ``keys``
    name further index columns behind the first (component, cohort)."""
    first, rest = REPORT.split(", ", 1)
    rows = spark.read.schema(", ".join([first, *[f"{k} string" for k in keys or []], rest])).option("header", True).csv(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("file", F.element_at(F.split("path", "/"), -1))


def read_permutation_report(spark: SparkSession, path: str, columns: str, sep: str = "\t") -> DataFrame:
    """Ranked rows of a collated file: rank int (null for the unpermuted row), is_real, ``columns``."""
    rows = spark.read.schema(f"rank string, {columns}").option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(f"{path}/ranked")
    real = F.col("rank") == REAL
    return rows.select(F.when(~real, F.col("rank").cast("int")).alias("rank"), real.alias("is_real"), *rows.columns[1:])


def read_lines(spark: SparkSession, folder: str, suffix: str = ".txt", pattern: str | None = None) -> DataFrame:
    """(file, value): lines of all files with the suffix under a folder, at any depth; those that
    match ``pattern`` if given; blank lines are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return rows.where(F.col("value").rlike(pattern)) if pattern else rows


def search_rows(lines: DataFrame, header: list[str], sep: str = "\t") -> DataFrame:
    """Search output lines as columns of ``header``; another number of fields is an error; the
    trailing empty field counts."""
    parts = F.split("value", sep, -1)
    fields = F.when(F.size(parts) == len(header), parts).otherwise(F.raise_error(F.concat(F.lit("fields: "), F.col("value"))).cast("array<string>"))
    return lines.withColumn("_f", fields).select("file", *[F.col("_f")[i].alias(c) for i, c in enumerate(header)])


def write_network(df: DataFrame, path: str, header: bool = False, sep: str = "\t") -> None:
    """Network rows with ig and mi to nine decimals, ordered by name."""
    text = df.orderBy("snp1", "snp2").select("snp1", "snp2", *[F.format_string("%.9f", F.col(c)).alias(c) for c in ("ig", "mi")])
    text.write.option("header", header).option("sep", sep).csv(path)


def write_parts(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    """One folder per key value (component rank, fold, cohort)."""
    df.repartition(*keys).write.partitionBy(*keys).format(fmt).save(path)


def write_matrix(df: DataFrame, path: str, names: list[str], column: str = "g", label: str = "label", keys: tuple[str, ...] = ("sid",), header: bool = True, sep: str = "\t", place: int | None = None) -> None:
    """A matrix (sid, label, array ``column``) as text in the order of ``keys``: a column for each name and
    the label, last or at ``place``."""
    cells = [F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)]
    cells.insert(len(cells) if place is None else place, F.col("label").alias(label))
    df.orderBy(*keys).select(*cells).write.option("header", header).option("sep", sep).csv(path)


def write_subject_networks(encoded: DataFrame, path: str, width: int, column: str = "dd", sep: str = "\t") -> None:
    """Signed degrees (fold, cohort, label, array ``column``) as headed text, a folder a fold and cohort.

    Columns are named by number, 0 up, the label is last. Rows of a folder are brought together, but one
    that is large is cut into several files, each written (and sorted) by another task.
    """
    cells = [F.get(column, F.lit(i)).alias(str(i)) for i in range(width)]
    encoded.select("fold", "cohort", *cells, "label").hint("rebalance", F.col("fold"), F.col("cohort")).write.partitionBy("fold", "cohort").option("header", True).option("sep", sep).csv(path)


def read_subject_networks(spark: SparkSession, path: str, width: int, sep: str = "\t") -> DataFrame:
    """(fold, cohort, label, dd array<int>) of the files that ``write_subject_networks`` wrote."""
    shape = ", ".join(f"`{i}` int" for i in range(width)) + ", label int, fold int, cohort string"
    rows = spark.read.schema(shape).option("header", True).option("enforceSchema", False).option("sep", sep).csv(path)
    return rows.select("fold", "cohort", "label", F.array(*[F.col(f"`{i}`") for i in range(width)]).alias("dd"))


def write_report(report: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """REPORT rows as headed CSV, the row's name (and ``keys``) first."""
    rows = report.select(F.col("metric_row").alias("row"), *(keys or []), "precision", "recall", F.col("f1").alias("f1-score"), "support")
    rows.write.option("header", True).csv(path)


def write_statistics(stats: DataFrame, path: str, sep: str = "\t") -> None:
    """Statistics of a threshold sweep as headed text, the highest threshold first."""
    stats.orderBy(F.desc("th")).write.option("header", True).option("sep", sep).csv(path)


def write_models(models: DataFrame, path: str) -> None:
    """Sparse pair models as headed CSV, in the order of their keys."""
    models.orderBy(*[c for c in models.columns if c != "n"]).write.option("header", True).csv(path)


def write_top_models(top: DataFrame, path: str, level: str = "n_attributes") -> None:
    """One folder per level, one distinct attribute set (comma list) per line, in order.

    Lists grow over the levels: that of a level also has the sets of all lower ones. So a set is written
    from its first level on; there are few levels.
    """
    sets = top.groupBy(F.array_join("attributes", ",").alias("value")).agg(F.min(level).alias("_first"))
    levels = sorted(r[0] for r in top.select(level).distinct().collect())
    each = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("_first")) if levels else F.array().cast("array<int>")
    sets = sets.select(F.explode(each).alias(level), "value")
    sets.repartition(level).sortWithinPartitions(level, "value").write.partitionBy(level).text(path)


def write_permutation_report(ranked: DataFrame, p_values: DataFrame, states: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """The collated file of a permutation study, in three folders: ``warning`` has a line if results
    are missing, ``ranked`` the rows in rank order (the unpermuted row's rank is written as REAL),
    ``p_values`` the block of p-values."""
    warning = states.where("NOT complete").select(F.concat_ws(" ", F.lit("partial results:"), F.col("found").cast("string"), F.lit("of"), F.col("expected").cast("string"), F.lit("rows")).alias("value"))
    warning.write.text(f"{path}/warning")
    rows = ranked.orderBy("rank", F.desc("is_real")).select(F.when(F.col("is_real"), REAL).otherwise(F.col("rank").cast("string")).alias("rank"), *columns)
    rows.write.option("header", True).option("sep", sep).csv(f"{path}/ranked")
    p_values.orderBy("p_value").select(*columns, F.format_string("%.4f", "p_value").alias("p_value")).write.option("header", True).option("sep", sep).csv(f"{path}/p_values")


def result_path(root: str, **parameters) -> str:
    """The folder of a result, named by its parameters in the order given."""
    return "/".join([root.rstrip("/"), "_".join(f"{k}_{v}" for k, v in parameters.items())])


def transcode(spark: SparkSession, source: str, target: str, sep_in: str, sep_out: str) -> None:
    """A headless delimited text with another delimiter, cells and their order unchanged."""
    in_file_order(spark.read.option("sep", sep_in).csv(source)).write.option("sep", sep_out).csv(target)


def replace_text(spark: SparkSession, source: str, old: str, new: str) -> DataFrame:
    """(file, value): whole files with a literal replaced."""
    rows = spark.read.text(source, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit(old), F.lit(new)).alias("value"))


def label_last(df: DataFrame, name: str = "target", to: str = "Labels") -> DataFrame:
    """The label column renamed and moved to the end."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col(f"`{name}`").alias(to))
