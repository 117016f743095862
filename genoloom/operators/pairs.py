"""Pairs of genotype-like features: contingency cells, information gain, models, cell signs.

A matrix is (sid long, label int, g array<int>). Pairs come from one row's own array, so counting
needs no join and no row key: one scan, a partial count per task, one shuffle of at most nine rows
a pair and task (of one row where only the gains are asked for).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import entropy

#: Pairs exploded from a row; more are counted by matrix products, features in tiles of TILE, rows in
#: slices of ROWS, at most HELD bytes of counters at once (more tile pairs take another scan).
EXPLODED, TILE, ROWS, HELD = 64, 256, 1024, 256 << 20
CELLS = [f"c{k}" for k in range(9)] + [f"d{k}" for k in range(9)]


def exploded_pairs(m: DataFrame, width: int, left: range | None = None, right: range | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, sid, label, f1, f2, v1, v2) for every pair f1 < f2, or left x right for two blocks."""
    keep = [*(keys or []), "sid", "label"]
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)] if left is None else [(i, j) for i in left for j in right]
    if len(pairs) <= EXPLODED:
        items = F.array(*[F.struct(F.lit(i).alias("f1"), F.lit(j).alias("f2"), F.get("g", F.lit(i)).alias("v1"), F.get("g", F.lit(j)).alias("v2")) for i, j in pairs])
        return m.select(*keep, F.inline(items))
    firsts = F.explode(F.sequence(F.lit(0), F.lit(width - 2))) if left is None else F.explode(F.sequence(F.lit(left.start), F.lit(left.stop - 1)))
    rows = m.select(*keep, "g", firsts.alias("f1"))
    seconds = F.sequence(F.col("f1") + 1, F.lit(width - 1)) if left is None else F.sequence(F.lit(right.start), F.lit(right.stop - 1))
    rows = rows.select(*keep, "g", "f1", F.explode(seconds).alias("f2"))
    return rows.select(*keep, "f1", "f2", F.get("g", F.col("f1")).alias("v1"), F.get("g", F.col("f2")).alias("v2"))


def pair_cells(m: DataFrame, width: int, keys: list[str] | None = None, left: range | None = None, right: range | None = None) -> DataFrame:
    """(keys, f1, f2, v1, v2, ctl, cas): controls and cases of each observed cell; codes other than 0, 1,
    2 and labels other than 0, 1 (nulls too) fall in no cell."""
    if not (keys or m.isStreaming) and _number(width, left, right) > EXPLODED:
        cells = F.array(*[F.struct(F.lit(k // 3).alias("v1"), F.lit(k % 3).alias("v2"), F.col(f"c{k}").alias("ctl"), F.col(f"d{k}").alias("cas")) for k in range(9)])
        return pair_counts(m, width, None, left, right).select("f1", "f2", F.inline(cells)).where("ctl + cas > 0")
    rows = exploded_pairs(m, width, left, right, keys).where("v1 IN (0, 1, 2) AND v2 IN (0, 1, 2) AND label IN (0, 1)")
    return rows.groupBy(*(keys or []), "f1", "f2", "v1", "v2").agg(F.count_if(F.col("label") == 0).alias("ctl"), F.count_if(F.col("label") == 1).alias("cas"))


def _number(width: int, left: range | None, right: range | None) -> int:
    return width * (width - 1) // 2 if left is None else len(left) * len(right)


def gain(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, f1, f2, ig, mi, main_f1, main_f2) of each pair, balanced: controls are scaled by the pair's
    own ratio of cases to controls, so the label has one bit.

    No case at all: every number is 0. No control at all: NaN (the ratio has no value).
    """
    pair = [*(keys or []), "f1", "f2"]
    sums = cells.groupBy(*pair).agg(F.sum("ctl").alias("all_ctl"), F.sum("cas").alias("all_cas"))
    # Cells and both one-way margins in one pass; in grouping_id, 1 stands for v2 summed up, 2 for v1.
    sets = cells.groupingSets([[*pair, "v1", "v2"], [*pair, "v1"], [*pair, "v2"]], *pair, "v1", "v2").agg(F.sum("ctl").alias("c"), F.sum("cas").alias("d"), F.grouping_id().alias("gid"))
    ratio = F.try_divide(F.col("all_cas").cast("double"), F.col("all_ctl"))
    rows = sets.join(sums, pair).withColumns({"ctl": F.col("c") * ratio, "cas": F.col("d").cast("double")})
    part = (F.col("ctl") + F.col("cas")) / (2 * F.col("all_cas")) * entropy(F.col("ctl"), F.col("cas"))
    both = rows.where("all_cas > 0 AND all_ctl > 0").groupBy(*pair).agg(*[F.sum(F.when(F.col("gid") == g, part).otherwise(0.0)).alias(n) for g, n in ((0, "h"), (1, "h1"), (2, "h2"))])
    out = sums.join(both, pair, "left")
    empty = F.when((F.col("all_cas") > 0) & (F.col("all_ctl") == 0), float("nan")).otherwise(0.0)
    mi, m1, m2 = (F.when(F.col(n).isNotNull(), 1 - F.col(n)).otherwise(empty) for n in ("h", "h1", "h2"))
    return out.select(*pair, (mi - m1 - m2).alias("ig"), mi.alias("mi"), m1.alias("main_f1"), m2.alias("main_f2"))


def _codes(column: pa.Array, width: int, missing: int = -1) -> np.ndarray:
    """Rows by features of a list column; what a row lacks, and nulls, are ``missing``."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy()
    values = pa.compute.fill_null(column.flatten(), missing).to_numpy()
    if len(n) and (n == width).all():
        return values.reshape(len(n), width)
    out = np.full((len(n), width), missing, values.dtype)
    inside = np.arange(width) < n[:, None]
    out[inside] = values[((np.cumsum(n) - n)[:, None] + np.arange(width))[inside]]
    return out


def _tile_counts(m: DataFrame, width: int, tiles: list[tuple[range, range]]) -> DataFrame:
    """(f1, f2, CELLS) of the pairs f1 < f2 or f1 x f2 of these tiles, one row a pair and task.

    With a row per subject and a 0/1 column per feature and code, the products of the columns of
    two tiles are the counts of all their cells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 3 * len(a), 3 * len(b)), np.int32) for a, b in tiles]
        some = False
        for batch in batches:
            label, g = batch.column(0).fill_null(-1).to_numpy(), _codes(batch.column(1), width)
            some = some or len(label) > 0
            for y in (0, 1):
                mine = np.flatnonzero(label == y)
                for at in range(0, len(mine), ROWS):
                    rows = g[mine[at : at + ROWS]]
                    hot = {t: (rows[:, t.start : t.stop, None] == np.arange(3)).reshape(len(rows), -1).astype(np.float32) for t in {t for pair in tiles for t in pair}}
                    for sums, (a, b) in zip(held, tiles, strict=True):
                        sums[y] += (hot[a].T @ hot[b]).astype(np.int32)
        for sums, (a, b) in zip(held if some else [], tiles if some else [], strict=True):
            cells = sums.reshape(2, len(a), 3, len(b), 3).transpose(1, 3, 0, 2, 4).reshape(len(a), len(b), 18)
            i, j = np.nonzero(np.less.outer(np.array(a), np.array(b)) if a == b else np.ones((len(a), len(b)), bool))
            yield pa.RecordBatch.from_arrays([pa.array((i + a.start).astype(np.int32)), pa.array((j + b.start).astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in cells[i, j].T]], names=["f1", "f2", *CELLS])

    return m.select("label", F.col("g").cast("array<int>").alias("g")).mapInArrow(count, "f1 int, f2 int, " + ", ".join(f"{c} int" for c in CELLS))


def pair_counts(m: DataFrame, width: int, keys: list[str] | None = None, left: range | None = None, right: range | None = None) -> DataFrame:
    """(keys, f1, f2, c0..c8, d0..d8): controls and cases of cell 3 * v1 + v2, a row for every pair.

    Codes and labels out of their domains (nulls too) fall in no cell. An empty table gives no rows.
    """
    group = [*(keys or []), "f1", "f2"]
    if keys or _number(width, left, right) <= EXPLODED:
        rows = exploded_pairs(m, width, left, right, keys)
        cell = F.when(F.col("v1").isin(0, 1, 2) & F.col("v2").isin(0, 1, 2), 3 * F.col("v1") + F.col("v2"))
        rows = rows.select(*group, "label", cell.alias("cell"))
        return rows.groupBy(*group).agg(*[F.count_if((F.col("label") == y) & (F.col("cell") == k)).alias(CELLS[9 * y + k]) for y in (0, 1) for k in range(9)])
    cut = lambda r: [range(i, min(i + TILE, r.stop)) for i in range(r.start, r.stop, TILE)]
    tiles = cut(range(width)) if left is None else []
    pairs = [(a, b) for k, a in enumerate(tiles) for b in tiles[k:]] if left is None else [(a, b) for a in cut(left) for b in cut(right)]
    each = max(1, HELD // (2 * (3 * TILE) ** 2 * 4))
    parts = [_tile_counts(m, width, pairs[i : i + each]) for i in range(0, len(pairs), each)]
    return reduce(DataFrame.unionByName, parts).groupBy("f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])


def pair_gains(m: DataFrame, width: int, keys: list[str] | None = None, left: range | None = None, right: range | None = None) -> DataFrame:
    """What ``gain`` gives of ``pair_cells``, from one row a pair: one shuffle, then arithmetic.

    A pair without any valid cell has 0 everywhere.
    """
    return count_gains(pair_counts(m, width, keys, left, right), [*(keys or []), "f1", "f2"])


def count_gains(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, ig, mi, main_f1, main_f2) of rows with the counters c0..c8, d0..d8 of a pair.

    Row by row, without a shuffle. The entropies are sums over an array of buckets (cells, then the
    margins of either feature), so the plan's code stays small.
    """
    plus = lambda columns: reduce(lambda a, b: a + b, columns)
    ways = [*[("h", [k]) for k in range(9)], *[("h1", [3 * v, 3 * v + 1, 3 * v + 2]) for v in range(3)], *[("h2", [v, v + 3, v + 6]) for v in range(3)]]
    buckets = F.array(*[F.struct(F.lit(way).alias("way"), plus([F.col(f"c{k}") for k in ks]).cast("double").alias("ctl"), plus([F.col(f"d{k}") for k in ks]).cast("double").alias("cas")) for way, ks in ways])
    rows = counts.select(*group, buckets.alias("b"), plus([F.col(c) for c in CELLS[:9]]).alias("all_ctl"), plus([F.col(c) for c in CELLS[9:]]).alias("all_cas"))
    rows = rows.withColumn("ratio", F.try_divide(F.col("all_cas").cast("double"), F.col("all_ctl")))
    bits = lambda x: (x["ctl"] * F.col("ratio") + x["cas"]) * entropy(x["ctl"] * F.col("ratio"), x["cas"])
    rows = rows.withColumn("parts", F.transform("b", lambda x: F.struct(x["way"].alias("way"), F.coalesce(bits(x), F.lit(0.0)).alias("bits"))))
    total = lambda way: F.try_divide(F.aggregate("parts", F.lit(0.0), lambda n, x: n + F.when(x["way"] == way, x["bits"]).otherwise(0.0)), 2.0 * F.col("all_cas"))
    some = (F.col("all_cas") > 0) & (F.col("all_ctl") > 0)
    empty = F.when((F.col("all_cas") > 0) & (F.col("all_ctl") == 0), float("nan")).otherwise(0.0)
    mi, m1, m2 = (F.when(some, 1 - total(way)).otherwise(empty) for way in ("h", "h1", "h2"))
    rows = rows.select(*group, F.array(mi, m1, m2).alias("x"))
    mi, m1, m2 = (F.col("x")[i] for i in range(3))
    return rows.select(*group, (mi - m1 - m2).alias("ig"), mi.alias("mi"), m1.alias("main_f1"), m2.alias("main_f2"))


def covariate_weights(m: DataFrame, covariate: str) -> DataFrame:
    """``m`` with a column weight under which label and covariate are independent.

    A row of level s and label y weighs n(s) * n(y) / (n * n(s, y)), so every level has the share of
    cases of all rows and the sums of weights by level and by label stay counts. Rows with another
    label than 0 and 1 are left out; a null level is a level.
    """
    rows = m.where("label IN (0, 1)")
    both = rows.groupBy(F.col(covariate).alias("_s"), F.col("label").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    by = lambda *c: F.sum("_n").over(Window.partitionBy(*c))
    total = both.agg(F.sum("_n").alias("_all"))
    weights = both.crossJoin(F.broadcast(total)).withColumn("weight", by("_s") * by("_y") / (F.col("_all") * F.col("_n"))).drop("_n", "_all")
    return rows.join(weights, F.col(covariate).eqNullSafe(F.col("_s")) & (F.col("label") == F.col("_y"))).drop("_s", "_y")


def adjusted_gains(m: DataFrame, width: int, covariate: str) -> DataFrame:
    """What ``pair_gains`` gives, adjusted for a covariate: rows count by their ``covariate_weights``."""
    rows = exploded_pairs(covariate_weights(m, covariate), width, keys=["weight"]).where("v1 IN (0, 1, 2) AND v2 IN (0, 1, 2)")
    of = lambda y: F.sum(F.when(F.col("label") == y, F.col("weight")).otherwise(0.0))
    return gain(rows.groupBy("f1", "f2", "v1", "v2").agg(of(0).alias("ctl"), of(1).alias("cas")))


def sparse_models(m: DataFrame, width: int) -> DataFrame:
    """(f1_i, f1_v, f2_i, f2_v, l, n): observed genotype pairs by label; 1 is '0', 2 is '1', any other
    label is an error."""
    label = F.when(F.col("label") == 1, "0").when(F.col("label") == 2, "1").otherwise(F.raise_error(F.concat(F.lit("label "), F.coalesce(F.col("label").cast("string"), F.lit("null")))))
    rows = exploded_pairs(m, width).withColumn("l", label)
    return rows.groupBy(F.col("f1").alias("f1_i"), F.col("v1").alias("f1_v"), F.col("f2").alias("f2_i"), F.col("v2").alias("f2_v"), "l").agg(F.count(F.lit(1)).alias("n"))


#: Distinct edges that travel with every row in one broadcast array; more are joined as a table.
PACKED_EDGES = 100_000


def _one_row(table: DataFrame, name: str) -> DataFrame:
    """All rows of a small table in one array of structs, to be broadcast."""
    return F.broadcast(table.agg(F.collect_list(F.struct(*table.columns)).alias(name)))


def at_edges(m: DataFrame, edges: DataFrame) -> DataFrame:
    """Every row of ``m`` with every distinct edge (f1, f2).

    Up to PACKED_EDGES edges are broadcast in one array and exploded inside the scan; more become a
    table that the planner joins with each row's copies, one for every f1 that an edge has. Neither
    looks at the row's array, so short and null ones meet every edge.
    """
    distinct = edges.select("f1", "f2").distinct()
    if distinct.limit(PACKED_EDGES + 1).count() <= PACKED_EDGES:
        return m.crossJoin(_one_row(distinct, "_edges")).select(*m.columns, F.inline("_edges"))
    firsts = edges.agg(F.collect_set("f1").alias("_f1s"))  # at most as many as there are features
    return m.crossJoin(F.broadcast(firsts)).select(*m.columns, F.explode("_f1s").alias("f1")).join(distinct, "f1")


def cell_signs(train: DataFrame, edges: DataFrame) -> DataFrame:
    """(f1, f2, v1, v2, sign): -1 where a cell of an edge has relatively more training cases, else +1.

    Controls are scaled by the ratio of all training cases to controls; ties are +1. Cells that no
    training row has are absent (callers read +1). At most nine rows an edge.
    """
    ratio = train.agg(F.try_divide(F.count_if(F.col("label") == 1).cast("double"), F.count_if(F.col("label") == 0)).alias("ratio"))
    cells = at_edges(train, edges).select("label", "f1", "f2", F.get("g", F.col("f1")).alias("v1"), F.get("g", F.col("f2")).alias("v2")).groupBy("f1", "f2", "v1", "v2").agg(F.count_if(F.col("label") == 0).alias("ctl"), F.count_if(F.col("label") == 1).alias("cas"))
    sign = F.when(F.col("ctl") * F.col("ratio") >= F.col("cas"), 1).otherwise(-1)
    return cells.crossJoin(F.broadcast(ratio)).select("f1", "f2", "v1", "v2", sign.alias("sign"))


#: Cells (subjects times edges) that a task looks at together.
TOGETHER = 32 << 20


def fold_signs(rows: DataFrame, edges: DataFrame, folds: int) -> DataFrame:
    """(fold, f1, f2, v1, v2, sign): ``cell_signs`` of each fold's training rows, those of other folds.

    ``rows`` has a column fold. Cells are counted by fold in one scan (for each PACKED_EDGES edges), as an
    array of edges, cells and classes that a task keeps; what a fold learns from is the sum less its
    own. No row is copied for an edge. Codes other than 0, 1, 2 make no cell; rows of another fold than
    0 to ``folds`` - 1 are left out.
    """
    rows = rows.where(F.col("label").isin(0, 1) & F.col("fold").between(0, folds - 1)).select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), F.col("g").cast("array<int>").alias("g"))
    distinct = edges.select("f1", "f2").distinct()
    parts = -(-distinct.count() // PACKED_EDGES) or 1

    def counted(part: int) -> DataFrame:
        mine = distinct.where(F.pmod(F.xxhash64("f1", "f2"), F.lit(parts)) == part).orderBy("f1", "f2").collect()  # PACKED_EDGES about
        held = rows.sparkSession.sparkContext.broadcast((np.array([r["f1"] for r in mine], np.int32), np.array([r["f2"] for r in mine], np.int32)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = held.value
            sums, some = np.zeros((folds, 2, 9, len(first)), np.int64), False
            width = int(max(first.max(initial=-1), second.max(initial=-1))) + 1
            for batch in batches:
                some = some or batch.num_rows > 0
                fold, label, g = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _codes(batch.column(2), width)
                g = np.where((g >= 0) & (g <= 2), g, 9).astype(np.int8)
                step = max(1, TOGETHER // max(len(first), 1))
                for k in range(folds):
                    for y in (0, 1):
                        own = np.flatnonzero((fold == k) & (label == y))
                        for at in range(0, len(own), step):
                            a, b = g[own[at : at + step]][:, first], g[own[at : at + step]][:, second]
                            cell = np.where((a == 9) | (b == 9), 9, 3 * a + b)
                            for c in range(9):
                                sums[k, y, c] += (cell == c).sum(axis=0)
            for k in range(folds if some else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(first), pa.array(second), *[pa.array(sums[k, y, c]) for y in (0, 1) for c in range(9)]], names=["fold", "f1", "f2", *CELLS])

        return rows.mapInArrow(count, "fold int, f1 int, f2 int, " + ", ".join(f"{c} long" for c in CELLS))

    own = reduce(DataFrame.unionByName, map(counted, range(parts))).groupBy("fold", "f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])
    every = own.groupBy("f1", "f2").agg(*[F.sum(c).alias(f"all_{c}") for c in CELLS])
    each = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(own, ["fold", "f1", "f2"], "left")
    left = lambda c: F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0))
    cells = F.array(*[F.struct(F.lit(k // 3).alias("v1"), F.lit(k % 3).alias("v2"), left(f"c{k}").alias("ctl"), left(f"d{k}").alias("cas")) for k in range(9)])
    classes = rows.groupBy("fold").agg(F.count_if(F.col("label") == 0).alias("c"), F.count_if(F.col("label") == 1).alias("d"))
    total = classes.agg(F.sum("c").alias("all_c"), F.sum("d").alias("all_d"))
    numbers = rows.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")).join(classes, "fold", "left").crossJoin(F.broadcast(total))
    ratio = F.try_divide((F.col("all_d") - F.coalesce("d", F.lit(0))).cast("double"), F.col("all_c") - F.coalesce("c", F.lit(0))).alias("ratio")
    rows_ = each.select("fold", "f1", "f2", F.inline(cells)).where("ctl + cas > 0").join(F.broadcast(numbers.select("fold", ratio)), "fold")  # a row a fold
    sign = F.when(F.col("ctl") * F.col("ratio") >= F.col("cas"), 1).otherwise(-1)
    return rows_.select("fold", "f1", "f2", "v1", "v2", sign.alias("sign"))


#: Cells of all edges that a task keeps in tables; more are searched for, edge by edge.
TABLED = 64 << 20


def _held_edges(known: DataFrame) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]], bool]:
    """(codes of cells that count -1, (f1, f2, times, cells), tabled) of edges: ``known`` is collected.

    A cell is n * place of the first code + place of the second, of n - 1 codes and what is none of
    them. ``tabled``: cells are a table of what each adds, else the sorted cells that count -1.
    """
    found = known.orderBy("f1", "f2").collect()  # PACKED_EDGES about
    codes = np.array(sorted({v for r in found for cell in r["minus"] for v in cell}), np.int64)
    n, place = len(codes) + 1, {int(v): i for i, v in enumerate(codes)}
    tabled, out = n * n * len(found) <= TABLED, []
    for r in found:
        cells = np.unique(np.array([n * place[c["v1"]] + place[c["v2"]] for c in r["minus"]], np.int64))
        if tabled:
            table = np.full(n * n, r["times"], np.int32)
            table[cells] *= -1
            cells = table
        out.append((r["f1"], r["f2"], r["times"], cells))
    return codes, out, tabled


def _edge_degrees(known: DataFrame, width: int):
    """A function of a row's codes: the degrees that these edges give."""
    held = known.sparkSession.sparkContext.broadcast(_held_edges(known))

    @F.arrow_udf("array<int>")
    def degrees(g: pa.Array) -> pa.Array:
        codes, edges, tabled = held.value
        n, out = len(codes) + 1, np.zeros((width, len(g)), np.int32)
        last = max((f for e in edges for f in e[:2]), default=-1) + 1
        missing = next(v for v in range(-1, -len(codes) - 2, -1) if v not in codes)
        seen = _codes(g, last, missing).T
        places = np.searchsorted(codes, seen).astype(np.int64) if n > 1 else np.zeros(seen.shape, np.int64)
        if n > 1:
            places[codes[np.minimum(places, n - 2)] != seen] = n - 1
        lacking = np.full(len(g), n - 1)
        at = lambda f: places[f] if f >= 0 else lacking
        for first, second, times, cells in edges:
            cell = n * at(first) + at(second)
            step = cells[cell] if tabled else np.where(np.isin(cell, cells), -times, times).astype(np.int32)
            for f in (first, second):
                if 0 <= f < width:
                    out[f] += step
        return pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(out.T).reshape(-1)))

    return degrees


def delta_degrees(subjects: DataFrame, edges: DataFrame, signs: DataFrame, width: int) -> DataFrame:
    """(sid, label, dd array<int>): the signed degree of each feature for each subject.

    For an edge, +1 to both ends if the subject's cell is protective or was never seen in training,
    else -1. An edge listed twice counts twice, a self edge both ends; features without an edge are
    0. ``signs`` comes from training subjects only. Up to PACKED_EDGES edges, each with the cells that
    count -1, are broadcast, and a batch of subjects is looked up edge by edge in its own codes: no
    shuffle of subjects. A larger network is cut into parts of that size, whose degrees add up row by row.
    """
    times = edges.groupBy("f1", "f2").agg(F.count(F.lit(1)).cast("int").alias("times"))
    minus = signs.where("sign < 0 AND v1 IS NOT NULL AND v2 IS NOT NULL").groupBy("f1", "f2").agg(F.collect_list(F.struct("v1", "v2")).alias("minus"))
    known = times.join(minus, ["f1", "f2"], "left").withColumn("minus", F.coalesce("minus", F.array().cast(minus.schema["minus"].dataType)))
    parts = -(-known.count() // PACKED_EDGES) or 1
    known = known.withColumn("part", F.pmod(F.xxhash64("f1", "f2"), F.lit(parts)))
    g, out = F.col("g").cast("array<int>"), subjects.select("sid", "label", "g")
    for part in range(parts):
        mine = _edge_degrees(known.where(F.col("part") == part), width)(g)
        out = out.withColumn("_d", mine)
        out = out.select("sid", "label", "g", (F.zip_with("dd", "_d", lambda x, y: x + y) if part else F.col("_d")).alias("dd"))
    return out.select("sid", "label", "dd")


def project_nodes(m: DataFrame, names: list[str], nodes: DataFrame) -> DataFrame:
    """(sid, label, f, snp, v) of the features named in ``nodes`` (snp), in matrix order; no common
    name gives no rows."""
    table = m.sparkSession.createDataFrame(list(enumerate(names)), "f int, snp string").join(nodes.select("snp").distinct(), "snp", "left_semi")
    return m.select("sid", "label", F.posexplode("g").alias("f", "v")).join(table, "f").select("sid", "label", "f", "snp", "v")


def name_edges_to_index(edges: DataFrame, names: list[str]) -> DataFrame:
    """(f1, f2) column numbers of named edges (snp1, snp2); the first of equal names counts; an
    unknown name is an error."""
    firsts = {n: i for i, n in reversed(list(enumerate(names)))}
    table = edges.sparkSession.createDataFrame(sorted(firsts.items()), "name string, at int")
    a, b = (table.select(F.col("name").alias(f"snp{i}"), F.col("at").alias(f"f{i}")) for i in (1, 2))
    known = lambda c, n: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("unknown name "), F.coalesce(F.col(n), F.lit("null")))).cast("int")).alias(c)
    return edges.join(a, "snp1", "left").join(b, "snp2", "left").select(known("f1", "snp1"), known("f2", "snp2"))


def join_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(sid, label, g): columns of two files side by side for pairs across them, labels of the left
    one only; subjects of the longer file that the other lacks fall out."""
    both = left.select("sid", "label", F.col("g").alias("ga")).join(right.select("sid", F.col("g").alias("gb")), "sid")
    return both.select("sid", "label", F.concat("ga", "gb").alias("g"))


def merge_subsets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(sid, label, g): two column blocks of the same subjects side by side, labels from the right.

    A subject that one side lacks, or other labels, are an error.
    """
    both = left.select("sid", F.col("label").alias("la"), F.col("g").alias("ga")).join(right.select("sid", F.col("label").alias("lb"), F.col("g").alias("gb")), "sid", "full")
    same = F.coalesce(F.col("la") == F.col("lb"), F.lit(False))
    checked = F.when(same, F.col("lb")).otherwise(F.raise_error(F.concat(F.lit("blocks differ at "), F.col("sid").cast("string"))).cast("int"))
    return both.select("sid", checked.alias("label"), F.concat("ga", "gb").alias("g"))
