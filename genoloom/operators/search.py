"""Multi-way search and permutation results: models, ranks, p-values, top lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.dealt import OTHER, chunked, chunks, dealt
from genoloom.operators.order import sum_before
from genoloom.operators.pairs import CELLS, EXPLODED, ROWS, count_gains, exploded_pairs, gain, pair_gains
from genoloom.operators.splits import shuffled_rank


#: Combinations listed in one literal array; more are exploded feature by feature.
LISTED = 256


def combined(m: DataFrame, width: int, ways: list[int], keys: list[str] | None = None) -> DataFrame:
    """(keys, label, attributes, n_attributes, cell) of every row and combination of features, from the
    row's own array: no join. A null code, or one that a short row lacks, is a code of its own."""
    own = ["label", *(keys or [])]
    code = lambda i: F.coalesce(F.get("g", i).cast("string"), F.lit("-"))
    ways = sorted({k for k in ways if 0 < k <= width})
    if sum(comb(width, k) for k in ways) <= LISTED:
        sets = [c for k in ways for c in combinations(range(width), k)]
        items = [F.struct(F.lit(",".join(map(str, c))).alias("attributes"), F.lit(len(c)).alias("n_attributes"), F.concat_ws(",", *[code(F.lit(i)) for i in c]).alias("cell")) for c in sets]
        return m.select(*own, F.inline(F.array(*items))) if sets else m.select(*own, F.lit("").alias("attributes"), F.lit(0).alias("n_attributes"), F.lit("").alias("cell")).limit(0)
    parts = []
    for k in ways:
        rows = m.select(*own, "g", F.lit(-1).alias("last"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("codes"))
        for level in range(k):
            rows = rows.select(*own, "g", "names", "codes", F.explode(F.sequence(F.col("last") + 1, F.lit(width - k + level))).alias("last"))
            rows = rows.select(*own, "g", "last", F.array_append("names", F.col("last").cast("string")).alias("names"), F.array_append("codes", code(F.col("last"))).alias("codes"))
        parts.append(rows.select(*own, F.array_join("names", ",").alias("attributes"), F.lit(k).alias("n_attributes"), F.array_join("codes", ",").alias("cell")))
    return reduce(DataFrame.unionByName, parts)


def kway_models(m: DataFrame, width: int, ways: list[int]) -> DataFrame:
    """(attributes, n_attributes, balanced_accuracy) of every combination of features.

    A cell is high risk if its cases exceed its controls times the ratio of all cases to controls;
    high-risk cells predict cases.
    """
    cells = combined(m.where("label IN (0, 1)"), width, ways).groupBy("attributes", "n_attributes", "cell").agg(F.count_if(F.col("label") == 0).alias("ctl"), F.count_if(F.col("label") == 1).alias("cas"))
    all_ = Window.partitionBy("attributes")
    rows = cells.withColumns({"all_ctl": F.sum("ctl").over(all_), "all_cas": F.sum("cas").over(all_)})
    high = F.col("cas") * F.col("all_ctl") > F.col("ctl") * F.col("all_cas")
    sums = rows.groupBy("attributes", "n_attributes").agg(F.sum(F.when(high, F.col("cas")).otherwise(0)).alias("tp"), F.sum(F.when(high, 0).otherwise(F.col("ctl"))).alias("tn"), F.max("all_ctl").alias("n0"), F.max("all_cas").alias("n1"))
    half = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)) / 2
    return sums.select("attributes", "n_attributes", (half(F.col("tp"), F.col("n1")) + half(F.col("tn"), F.col("n0"))).alias("balanced_accuracy"))


def permuted_labels(m: DataFrame, permutations: int, seed: int, start: int = 0) -> DataFrame:
    """(sid, label, g, labels array<int>): ``m`` with its shuffled labels, from permutation ``start`` on.

    A permutation pairs the rows' order by md5(seed:place:sid) with the labels' order by
    md5(seed:number:sid). Only (number, rank, label) rows are dealt out; the matrix moves once.
    """
    numbers = F.explode(F.sequence(F.lit(start), F.lit(start + permutations - 1))).alias("perm")
    many = m.select(numbers, "sid", "label").withColumn("_key", F.concat_ws(":", "perm", "sid"))
    ranks = shuffled_rank(many, seed, "_key", ["perm"])
    labels = ranks.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("perm", "label"))).alias("_l")).select("rank", F.transform("_l", lambda x: x["label"]).alias("labels"))
    places = shuffled_rank(m.withColumn("_key", F.concat(F.lit("place:"), F.col("sid").cast("string"))), seed, "_key")
    return places.join(labels, "rank").select("sid", "label", "g", "labels")


def permuted(m: DataFrame, permutations: int, seed: int, start: int = 0) -> DataFrame:
    """(perm, sid, label, g): rows with labels shuffled for each permutation number from ``start``."""
    rows = permuted_labels(m, permutations, seed, start)
    return rows.select("sid", "g", F.posexplode("labels").alias("perm", "label")).select((F.col("perm") + start).alias("perm"), "sid", "label", "g")


#: Bytes of counters that a task holds (more pairs take another scan); pairs in one product.
HELD, PAIRS = 256 << 20, 512


def _permuted_counts(pieces: DataFrame, pairs: list[tuple[int, int]], permutations: int, taken: list[list[int]]) -> DataFrame:
    """(perm, f1, f2, c0..c8, d0..d8), a row a task, of chunks: the places' codes, then each permutation's labels.

    With a 0/1 column for every cell of every pair, and one for the controls (cases) of every
    permutation, the product of the two is all counters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, len(pairs) * 9, permutations), np.int64)
        first, second = (np.array([p[k] for p in pairs]) for k in (0, 1))
        some = False
        for _, (places, *rest) in chunks(batches, taken):
            g, labels, some = places.T, np.concatenate(rest).T, True
            for at in range(0, len(g), ROWS):
                codes = g[at : at + ROWS]
                classes = [(labels[at : at + ROWS] == y).astype(np.float32) for y in (0, 1)]
                for k in range(0, len(pairs), PAIRS):
                    cell = 3 * codes[:, first[k : k + PAIRS]] + codes[:, second[k : k + PAIRS]]
                    cell[(codes[:, first[k : k + PAIRS]] == OTHER) | (codes[:, second[k : k + PAIRS]] == OTHER)] = 9
                    hot = (cell[:, :, None] == np.arange(9, dtype=np.uint8)).reshape(len(codes), -1).astype(np.float32).T
                    for y in (0, 1):
                        held[y, 9 * k : 9 * k + len(hot)] += (hot @ classes[y]).astype(np.int64)
        for perm in range(permutations if some else 0):
            cells = held[:, :, perm].reshape(2, len(pairs), 9)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), perm, np.int32)), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *[pa.array(np.ascontiguousarray(cells[y, :, k])) for y in (0, 1) for k in range(9)]], names=["perm", "f1", "f2", *CELLS])

    return pieces.mapInArrow(count, "perm int, f1 int, f2 int, " + ", ".join(f"{c} long" for c in CELLS))


def permuted_gains(m: DataFrame, width: int, permutations: int, seed: int, start: int = 0) -> DataFrame:
    """(perm, f1, f2, ig, mi, main_f1, main_f2) of every pair under every permutation of labels.

    Permutations are those of ``permuted_labels``, put in order as bytes; all are counted at once, by
    matrix products of cells and labels. No subject is exploded. A pair without a valid cell has no row.
    """
    pairs = list(combinations(range(width), 2))
    if not pairs or not permutations:
        return gain(exploded_pairs(m.limit(0), max(width, 2)).select(F.lit(0).alias("perm"), "f1", "f2", "v1", "v2", F.lit(0).alias("ctl"), F.lit(0).alias("cas")), ["perm"])
    # A row's codes are its features, padded, then its label: the first sequence has the features by
    # place, each other one the labels of a permutation.
    names = ["place", *map(str, range(start, start + permutations))]
    taken = [list(range(width)), *[[width]] * permutations]
    runs = dealt(m, width + 1, F.concat(padded(width), F.array(F.col("label").cast("int"))), F.lit(0), seed, names, taken)
    each = max(1, HELD // (2 * 9 * 8 * permutations))
    parts = [_permuted_counts(chunked(runs, taken), pairs[i : i + each], permutations, taken) for i in range(0, len(pairs), each)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("perm", "f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])
    some = reduce(Column.__add__, [F.col(c) for c in CELLS]) > 0
    return count_gains(sums.where(some), ["perm", "f1", "f2"]).withColumn("perm", (F.col("perm") + start).cast("int"))


def padded(width: int) -> Column:
    """The row's codes, as many as there are features; null for what it lacks."""
    if 0 < width <= EXPLODED:
        return F.array(*[F.get("g", F.lit(i)).cast("int") for i in range(width)])
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("g", i).cast("int"))


def _mixed_counts(pieces: DataFrame, width: int, perms: range, firsts: range, taken: list[list[int]]) -> DataFrame:
    """(perm, f1, f2, c0..c8, d0..d8), a row a task, of the pairs of features ``firsts`` with later ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, len(perms), 3 * len(firsts), 3 * width), np.int64)
        some = False
        for y, codes in chunks(batches, taken):
            some = True
            for at, perm in enumerate(perms):
                g = np.concatenate(codes[perm * width : (perm + 1) * width]).T
                for k in range(0, len(g), ROWS):
                    hot = (g[k : k + ROWS, :, None] == np.arange(3, dtype=np.uint8)).reshape(-1, 3 * width).astype(np.float32)
                    held[y, at] += (hot[:, 3 * firsts.start : 3 * firsts.stop].T @ hot).astype(np.int64)
        i, j = np.nonzero(np.less.outer(np.array(firsts), np.arange(width)))
        for at, perm in enumerate(perms if some else []):
            cells = held[:, at].reshape(2, len(firsts), 3, width, 3).transpose(1, 3, 0, 2, 4).reshape(len(firsts), width, 18)[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), perm, np.int32)), pa.array((i + firsts.start).astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in cells.T]], names=["perm", "f1", "f2", *CELLS])

    return pieces.mapInArrow(count, "perm int, f1 int, f2 int, " + ", ".join(f"{c} long" for c in CELLS))


def explicit_test(m: DataFrame, width: int, permutations: int, seed: int) -> DataFrame:
    """(f1, f2, ig, n_above, p_value): an explicit test of interaction for every pair.

    Each permutation shuffles every feature by itself inside each class: what a feature alone says of
    the label stays, what two say together goes. n_above permutations have at least the real gain;
    p_value = (1 + n_above) / (1 + permutations). The values of a class are put in the order of
    md5(seed:number:feature:sid); those of the same rank make a row.
    """
    names, taken = [f"{p}:{f}" for p in range(permutations) for f in range(width)], [[f] for _ in range(permutations) for f in range(width)]
    runs = dealt(m.where("label IN (0, 1)"), width, padded(width), F.col("label"), seed, names, taken)
    rows = max(1, min(width, HELD // (2 * 8 * 9 * width)))
    each = max(1, HELD // (2 * 8 * 9 * width * rows))
    parts = [_mixed_counts(chunked(runs, taken), width, range(p, min(p + each, permutations)), range(f, min(f + rows, width)), taken) for p in range(0, permutations, each) for f in range(0, width, rows)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("perm", "f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])
    null = count_gains(sums, ["perm", "f1", "f2"]).select("f1", "f2", F.col("ig").alias("_ig"))
    real = pair_gains(m, width).select("f1", "f2", "ig")
    above = F.count_if(F.col("_ig") >= F.col("ig") - 1e-12)
    out = real.join(null, ["f1", "f2"], "left").groupBy("f1", "f2", "ig").agg(above.alias("n_above"))
    return out.withColumn("p_value", F.round((1 + F.col("n_above")) / (1 + permutations), 4))


def kway_cross_validated(m: DataFrame, width: int, ways: list[int], folds: int) -> DataFrame:
    """(attributes, n_attributes, cv_training, cv_testing, cvc, overall) of every combination of features.

    ``m`` has a column fold, 0 .. folds - 1. Cells are high risk by the rows outside a fold, as in
    ``kway_models``; balanced accuracies inside (testing) and outside (training) the fold are averaged
    over folds. cvc counts the folds in which a combination trains best of its size (ties: the first
    by name). overall: the balanced accuracy on all rows. Every cell is counted once for all folds.
    """
    rows = combined(m.where("label IN (0, 1)"), width, ways, ["fold"])
    ks = range(folds)
    count = lambda y, k: F.count_if((F.col("label") == y) & (F.col("fold") == k))
    cells = rows.groupBy("attributes", "n_attributes", "cell").agg(*[count(y, k).alias(f"n{y}_{k}") for y in (0, 1) for k in ks])
    every = lambda y: reduce(Column.__add__, [F.col(f"n{y}_{k}") for k in ks])
    # Fold -1 stands for all rows: trained on them and tested on them.
    each = [F.struct(F.lit(k).alias("fold"), (every(0) - F.col(f"n0_{k}")).alias("r0"), (every(1) - F.col(f"n1_{k}")).alias("r1"), F.col(f"n0_{k}").alias("t0"), F.col(f"n1_{k}").alias("t1")) for k in ks]
    each.append(F.struct(F.lit(-1).alias("fold"), every(0).alias("r0"), every(1).alias("r1"), every(0).alias("t0"), every(1).alias("t1")))
    cells = cells.select("attributes", "n_attributes", "cell", F.inline(F.array(*each)))
    totals = Window.partitionBy("attributes", "fold")
    cells = cells.withColumns({f"all_{c}": F.sum(c).over(totals) for c in ("r0", "r1", "t0", "t1")})
    high = F.col("r1") * F.col("all_r0") > F.col("r0") * F.col("all_r1")
    hit = lambda t: [F.sum(F.when(high, F.col(f"{t}1")).otherwise(0)).alias(f"{t}p"), F.sum(F.when(high, 0).otherwise(F.col(f"{t}0"))).alias(f"{t}n")]
    sums = cells.groupBy("attributes", "n_attributes", "fold").agg(*hit("r"), *hit("t"), *[F.max(f"all_{c}").alias(f"all_{c}") for c in ("r0", "r1", "t0", "t1")])
    half = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) / 2
    scored = sums.select("attributes", "n_attributes", "fold", (half("rp", "all_r1") + half("rn", "all_r0")).alias("training"), (half("tp", "all_t1") + half("tn", "all_t0")).alias("testing"))
    # The best of a fold and size by one aggregate; rounding makes ties of equal models.
    best = scored.where("fold >= 0").groupBy("n_attributes", "fold").agg(F.min(F.struct(-F.round("training", 9), "attributes")).alias("_b")).select("n_attributes", "fold", F.col("_b.attributes").alias("attributes"), F.lit(1).alias("won"))
    joined = scored.join(best, ["n_attributes", "fold", "attributes"], "left")
    inside = F.col("fold") >= 0
    mean = lambda c: F.avg(F.when(inside, F.col(c)))
    return joined.groupBy("attributes", "n_attributes").agg(mean("training").alias("cv_training"), mean("testing").alias("cv_testing"), F.coalesce(F.sum("won"), F.lit(0)).alias("cvc"), F.max(F.when(~inside, F.col("training"))).alias("overall"))


def permutation_chunks(permutations: int, jobs: int, start: int = 0) -> list[tuple[int, int]]:
    """(start, number) of each job's permutations; they must divide evenly."""
    if jobs < 1 or permutations % jobs:
        raise ValueError(f"{permutations} permutations do not divide into {jobs} jobs")
    each = permutations // jobs
    return [(start + i * each, each) for i in range(jobs)]


def permutation_rank(results: DataFrame, order: list[Column], real: str = "is_real", by: list[str] | None = None) -> DataFrame:
    """``results`` with rank: real rows take a rank but do not use one up.

    Ranks are sums over the global order less those at the start of their group, so no group of
    ``by`` has to fit a task.
    """
    by = by or []
    rows = sum_before(results, [*[F.asc(c) for c in by], *order], (~F.col(real)).cast("long"), "_before")
    if not by:
        return rows.withColumn("rank", F.col("_before") + 1).drop("_before")
    starts = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_before").alias("_start"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return rows.join(starts, same).withColumn("rank", F.col("_before") - F.col("_start") + 1).drop("_before", "_start", *[f"_{c}" for c in by])


def p_values(ranked: DataFrame, real: str = "is_real", by: list[str] | None = None) -> DataFrame:
    """Real rows with p_value = rank / (permutations + 1), 4 decimals."""
    by = by or []
    n = ranked.groupBy(*by).agg(F.count_if(~F.col(real)).alias("n_permutations"))
    joined = ranked.where(real).join(n, by) if by else ranked.where(real).crossJoin(F.broadcast(n))
    return joined.withColumn("p_value", F.round(F.col("rank") / (F.col("n_permutations") + 1), 4))


def top_per_level(results: DataFrame, level: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each level, with their rank."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(level).orderBy(*order))).where(F.col("rank") <= n)


def search_order(kind: str) -> list[Column]:
    """Sort keys of search results by the chosen measure, then overall score, then fewer attributes."""
    first = {"cv_test": ["cv_testing", "cvc"], "cvc_cv_test": ["cvc", "cv_testing"], "cvc_model_test": ["cvc", "model_testing"], "single": []}[kind]
    return [*[F.desc(c) for c in first], F.desc("overall"), F.asc(F.size("attributes")), F.asc(F.array_join("attributes", ","))]


def distinct_attributes(top: DataFrame) -> DataFrame:
    return top.select(F.explode("attributes").alias("attribute")).distinct()


def job_states(jobs: DataFrame) -> DataFrame:
    """Counters of job states and rows: expected against found."""
    return jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("done", "running", "failed", "missing")], F.sum("expected").alias("expected"), F.sum("found").alias("found"), (F.sum("expected") == F.sum("found")).alias("complete"))


def sweep(base: dict, lists: dict[str, list]) -> list[dict]:
    """One parameter set for each combination of the listed values over ``base`` (none listed: base)."""
    return [base | dict(zip(lists, values, strict=True)) for values in product(*lists.values())]


def reanalysed(m: DataFrame, width: int, ways: list[int], top: DataFrame) -> DataFrame:
    """The search again, over only the attributes of the best models ``top`` (attributes array)."""
    best = sorted(int(r["attribute"]) for r in distinct_attributes(top).collect())  # at most ``width`` rows
    narrow = m.select("sid", "label", F.array(*[F.col("g")[i] for i in best]).alias("g"))
    found = kway_models(narrow, len(best), [k for k in ways if k <= len(best)])
    names = F.array(*[F.lit(str(i)) for i in best])
    original = F.array_join(F.transform(F.split("attributes", ","), lambda i: F.get(names, i.cast("int"))), ",")
    return found.withColumn("attributes", original)
