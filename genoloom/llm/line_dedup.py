"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines are hashed (128 bits); a text of fewer lines is one window. Windows are
counted over all documents, with the first place of each, aggregated before the shuffle. Windows that
occur again are later occurrences; the lines they cover are merged into runs, and what lies between
the runs is kept. A window that very many texts have meets them by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.hot import join_groups
from genoloom.scratch import stage

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, own, at, h1, h2): each window of LINES lines, or of all lines if these are fewer (an empty
    text has none); own is a hash of the whole text."""
    rows = docs.where(F.col(text_col) != "").select("id", F.xxhash64(text_col).alias("own"), _lines(F.col(text_col)).alias("lines"))
    none = F.array_repeat(F.lit(None).cast("string"), LINES)
    few = F.size("lines") < LINES
    rows = rows.select("id", "own", F.least(F.size("lines"), F.lit(LINES)).alias("n"), F.when(few, F.slice(F.concat("lines", none), 1, LINES)).otherwise(F.col("lines")).alias("lines"))
    shifted = [F.slice("lines", 1 + i, F.size("lines") - (LINES - 1)).alias(f"l{i}") for i in range(LINES)]
    each = rows.select("id", "own", "n", F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    parts = [F.col("n"), *[F.col(f"w.l{i}") for i in range(LINES)]]
    return each.select("id", "own", "at", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def covered_runs(windows: DataFrame) -> DataFrame:
    """(id, own, runs): the merged line runs [first, last] that later occurrences cover (last may lie
    behind a text of fewer than LINES lines)."""
    place = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("id"), "own", "at")
    firsts = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    later = join_groups(windows, firsts, ["h1", "h2"]).where(place != F.col("first")).select("id", "own", "at").distinct()
    by_doc = Window.partitionBy("id", "own").orderBy("at")
    fresh = F.coalesce((F.col("at") > F.lag("at").over(by_doc) + LINES).cast("int"), F.lit(1))
    islands = later.withColumn("island", F.sum(fresh).over(by_doc))
    runs = islands.groupBy("id", "own", "island").agg(F.min("at").alias("first"), (F.max("at") + (LINES - 1)).alias("last"))
    return runs.groupBy("id", "own").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated windows cut out of the text, and n_lines, n_removed.

    Lines lie between line feeds and are compared exactly. Occurrences are ordered by id (null
    first), text hash and line; the first of a window stays unless another window's later
    occurrence covers it. A text of fewer than LINES lines is compared whole, with others of as many
    lines. Empty texts and nulls stay as they are (a null has null counts); a text may become empty;
    rows stay whole. Rows with the same id and text
    are one document: each gets its result. Columns named n_lines or n_removed are replaced.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    windows = stage(window_hashes(rows), "line-windows")
    runs = covered_runs(windows).select(F.col("id").alias("_id"), F.col("own").alias("_own"), F.col("runs").alias("_runs"))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    text = F.col(f"`{text_col}`").cast("string")
    # Other columns travel in one struct, so none of theirs can clash with those used here.
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep if c != text_col])
    plain = docs.select(rest.alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_key"), _lines(text).alias("_lines"), F.xxhash64(text).alias("_hash"))
    both = plain.join(runs, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_own")), "left")
    n = F.size("_lines")
    both = both.withColumn("_runs", F.transform("_runs", lambda r: F.struct(r["first"].alias("first"), F.least(r["last"], n - 1).alias("last"))))
    starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("_runs", lambda r: r["first"]), F.array(n))
    both = both.withColumn("_kept", F.arrays_zip(starts.alias("a"), ends.alias("b")))
    left = F.flatten(F.transform("_kept", lambda k: F.slice(F.col("_lines"), k["a"] + 1, k["b"] - k["a"])))
    text = F.array_join(F.when(F.col("_runs").isNull(), F.col("_lines")).otherwise(left), "\n")
    gone = F.coalesce(F.aggregate("_runs", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0))
    lines = F.when(F.col("_lines").isNotNull(), n)
    return both.select(*[(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c)) for c in keep], lines.cast("long").alias("n_lines"), F.when(F.col("_lines").isNotNull(), gone).cast("long").alias("n_removed"))
