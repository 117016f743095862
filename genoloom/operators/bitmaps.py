"""A matrix by columns: bitmaps of feature codes, counted by AND and population counts.

``vertical`` turns a matrix (sid, label, g) into rows of blocks of columns. A row holds, for the
controls and for the cases of one part of the subjects, a bitmap of each column and code, 64 subjects
a word. It is written once; everything below reads it and never looks at a subject again.

* ``block_gains``: a task that may hold the counters of all pairs counts the subjects it reads and no
  bitmap is moved. Of wider matrices pairs of blocks meet on their number, so hundreds of thousands
  of columns are a join of blocks; only pairs over a threshold leave a task.
* ``kway_bits``: every k-way combination. A task gets a range of their ranks and finds its
  combinations by unranking, so none is listed or shuffled; prefixes are ANDed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators.pairs import CELLS, _codes, count_gains
from genoloom.scratch import stage

#: Bytes of bitmaps in a group; columns of a block; subjects, and bytes of codes, of a part.
GROUP_BYTES, BLOCK, ROWS, HELD = 64 << 20, 512, 1 << 16, 64 << 20
#: Bytes of counters of all pairs that a task may hold; a wider matrix goes by blocks.
COUNTERS = 256 << 20
#: Word operations of a range of combinations, about: some ten seconds.
WORDS = 1 << 33
VERTICAL = "block int, part long, n0 int, n1 int, others boolean, bits0 binary, bits1 binary"


def _bits(codes: np.ndarray) -> np.ndarray:
    """columns x 3 x words: who has which code, of codes (subjects x columns)."""
    n, columns = codes.shape
    hot = np.zeros((columns, 3, -(-n // 64) * 64), bool)
    hot[:, :, :n] = codes.T[:, None, :] == np.arange(3, dtype=codes.dtype)[None, :, None]
    return np.packbits(hot, axis=-1, bitorder="little").view("<u8")


def vertical(m: DataFrame, width: int, block: int) -> DataFrame:
    """VERTICAL rows: of each part of the subjects one for every block of columns.

    Subjects with another label than 0 and 1 are left out. A code other than 0, 1, 2 (null, or one
    that a short row lacks) sets no bit; others tells that the part has such codes.
    """
    most = max(64, min(ROWS, HELD // max(width, 1)))

    def part_rows(number: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        codes = [np.concatenate(x) for x in held]
        firsts = range(0, width, block)
        n, others = [len(x) for x in codes], any((x == 3).any() for x in codes)
        bits = [[_bits(x[:, at : at + block]).tobytes() for at in firsts] for x in codes]
        k = len(firsts)
        return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([number] * k, pa.int64()), pa.array([n[0]] * k, pa.int32()), pa.array([n[1]] * k, pa.int32()), pa.array([others] * k), *[pa.array(x, pa.binary()) for x in bits]], names=["block", "part", "n0", "n1", "others", "bits0", "bits1"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [[], []], 0
        for batch in batches:
            label, g = batch.column(0).to_numpy(zero_copy_only=False), _codes(batch.column(1), width)
            small = np.where((g >= 0) & (g <= 2), g, 3).astype(np.int8)
            for at in range(0, len(label), most):
                for y in (0, 1):
                    held[y].append(small[at : at + most][label[at : at + most] == y])
                size += len(label[at : at + most])
                if size >= most:
                    yield part_rows(number, held)
                    held, size, number = [[], []], 0, number + 1
        if size:
            yield part_rows(number, held)

    return m.where("label IN (0, 1)").select("label", F.col("g").cast("array<int>").alias("g")).mapInArrow(cut, VERTICAL)


def _words(v: DataFrame) -> int:
    """Words of a bitmap over all subjects."""
    words = lambda c: F.ceil(F.col(c) / 64)
    return int(v.where("block = 0").agg(F.sum(words("n0") + words("n1"))).first()[0] or 0)


def _dealt(v: DataFrame, words: int, columns: int) -> tuple[DataFrame, int]:
    """``v`` with segment, and their number: of ``columns`` a segment of subjects holds GROUP_BYTES about."""
    segments = max(1, -(-words * 24 * columns // GROUP_BYTES))
    return v.withColumn("segment", F.pmod(F.xxhash64("part"), F.lit(segments)).cast("int")), segments


def _held(table: pa.Table, columns: int) -> dict[int, list[np.ndarray]]:
    """Of each part, in order, the bitmaps (columns x 3 x words) of controls and of cases."""
    out = {}
    for part, *bits in zip(table["part"].to_pylist(), table["bits0"].to_pylist(), table["bits1"].to_pylist(), strict=True):
        out[part] = [np.frombuffer(x, "<u8").reshape(columns, 3, -1) for x in bits]
    return dict(sorted(out.items()))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that each bitmap of ``a`` shares with each of ``b`` (both: bitmaps x words)."""
    return np.stack([np.bitwise_count(x & b).sum(axis=1, dtype=np.int64) for x in a]) if len(a) else np.zeros((0, len(b)), np.int64)


def _about(cells: np.ndarray) -> np.ndarray:
    """Gains of pairs (pairs x 2 x 3 x 3 counters) to 12 digits or so; less than any without both classes."""
    counts = cells.astype(float)
    n = counts.sum(axis=(2, 3))
    with np.errstate(all="ignore"):
        ctl, cas = counts[:, 0] * (n[:, 1] / n[:, 0])[:, None, None], counts[:, 1]

        def left(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            total = x + y
            bits = np.where((x > 0) & (y > 0), -(x * np.log2(x / total) + y * np.log2(y / total)), 0.0)
            return bits.reshape(len(bits), -1).sum(axis=1) / (2 * n[:, 1])

        gain = left(ctl.sum(axis=2), cas.sum(axis=2)) + left(ctl.sum(axis=1), cas.sum(axis=1)) - left(ctl, cas) - 1
    return np.where((n > 0).all(axis=1), gain, -np.inf)


def _own_counts(m: DataFrame, width: int) -> DataFrame:
    """(f1, f2, CELLS) of all pairs f1 < f2, a row a pair and task: each counts the parts that it cuts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = np.zeros((2, 3 * width, 3 * width), np.int64), False
        for batch in batches:
            some = some or batch.num_rows > 0
            for y in (0, 1):
                for data in batch.column(y).to_pylist():
                    bits = np.frombuffer(data, "<u8").reshape(3 * width, -1)
                    for at in range(0, 3 * (width - 1), 3):
                        sums[y, at : at + 3, at + 3 :] += _both(bits[at : at + 3], bits[at + 3 :])
        i, j = np.nonzero(np.triu(np.ones((width, width), bool), 1) if some else np.zeros((width, width), bool))
        cells = sums.reshape(2, width, 3, width, 3).transpose(1, 3, 0, 2, 4)[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in cells.reshape(len(cells), 18).T]], names=["f1", "f2", *CELLS])

    return vertical(m, width, max(width, 1)).select("bits0", "bits1").mapInArrow(count, "f1 int, f2 int, " + ", ".join(f"{c} long" for c in CELLS))


def block_of(width: int) -> int:
    """Columns of a block, however many rows there are: some blocks to deal out, and as few copies of each as may be."""
    return max(1, min(BLOCK, -(-width // 4)))


def block_gains(m: DataFrame, width: int, at_least: float, block: int | None = None) -> DataFrame:
    """(f1, f2, ig, mi, main_f1, main_f2) of the pairs f1 < f2 whose gain is ``at_least`` so large.

    What ``pair_gains`` gives of them. The matrix is read once. If a task may hold the counters of all
    pairs (COUNTERS, and no ``block`` is named), a row a pair leaves it. Else blocks are shuffled to their
    partners, a group holds two of them (of one segment of subjects, if all are too many), and a pair leaves
    it only if its gain reaches the threshold; of several segments counters are added up before.
    """
    if block is None and 2 * (3 * width) ** 2 * 8 <= COUNTERS:
        counts = _own_counts(m, width).groupBy("f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])
        return count_gains(counts, ["f1", "f2"]).where(~F.isnan("ig") & (F.col("ig") >= at_least))
    block = block or block_of(width)
    last = -(-width // block) - 1
    v = stage(vertical(m, width, block), "vertical")
    dealt, segments = _dealt(v, _words(v), 2 * block)
    size = lambda k: min(block, width - k * block)

    def count(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        one, two = (_held(table.filter(pc.equal(table["block"], k)), size(k)) for k in (a, b))
        sums = np.zeros((2, 3 * size(a), 3 * size(b)), np.int64)
        for part, bits in one.items():
            for y in (0, 1):
                words = bits[y].shape[-1]
                sums[y] += _both(bits[y].reshape(-1, words), two[part][y].reshape(-1, words)) if words else 0
        cells = sums.reshape(2, size(a), 3, size(b), 3).transpose(1, 3, 0, 2, 4)
        i, j = np.nonzero(np.triu(np.ones((size(a), size(b)), bool), 1) if a == b else np.ones((size(a), size(b)), bool))
        cells = cells[i, j]
        if segments == 1:
            keep = _about(cells) >= at_least - 1e-9
            i, j, cells = i[keep], j[keep], cells[keep]
        return pa.table([pa.array((i + a * block).astype(np.int32)), pa.array((j + b * block).astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in cells.reshape(len(cells), 18).T]], names=["f1", "f2", *CELLS])

    partner = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("partner")
    pairs = dealt.select("*", partner).select(F.least("block", "partner").alias("a"), F.greatest("block", "partner").alias("b"), "segment", "block", "part", "bits0", "bits1")
    counts = pairs.groupBy("a", "b", "segment").applyInArrow(count, "f1 int, f2 int, " + ", ".join(f"{c} long" for c in CELLS))
    if segments > 1:
        counts = counts.groupBy("f1", "f2").agg(*[F.sum(c).alias(c) for c in CELLS])
    return count_gains(counts, ["f1", "f2"]).where(~F.isnan("ig") & (F.col("ig") >= at_least))


# ---------------------------------------------------------------- k-way combinations


def unrank(rank: int, n: int, k: int) -> list[int]:
    """The combination of k of n things that has this rank (0 up) in lexicographic order."""
    out, first = [], 0
    for left in range(k, 0, -1):
        while (size := comb(n - first - 1, left - 1)) <= rank:  # all that begin with ``first``
            rank, first = rank - size, first + 1
        out.append(first)
        first += 1
    return out


def runs(start: int, stop: int, n: int, k: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """(prefix, first, end): the combinations of ranks start to stop - 1 are prefix + (j,), first <= j < end."""
    if start >= stop:
        return
    *prefix, first = unrank(start, n, k)
    while True:
        end = min(n, first + stop - start)
        yield tuple(prefix), first, end
        start += end - first
        if start >= stop:
            return
        at = max(i for i in range(k - 1) if prefix[i] < n - k + i)
        prefix[at:] = range(prefix[at] + 1, prefix[at] + k - at)
        first = prefix[-1] + 1


def rank_ranges(n: int, k: int, nodes: int) -> list[tuple[int, int]]:
    """The ranks that each of ``nodes`` takes: (start, stop), balanced, together every one once."""
    total = comb(n, k)
    return [(i * total // nodes, (i + 1) * total // nodes) for i in range(nodes)]


def kway_counts(m: DataFrame, width: int, k: int, nodes: int | None = None, only: list[int] | None = None) -> DataFrame:
    """(node, rank, attributes, ctl array<long>, cas array<long>): counters of each k-way combination.

    Cells are in the order of their codes, first feature first: three codes a feature, and a fourth
    for any other (null too) if there is one anywhere. ``only``: the numbers of the nodes that run.
    """
    total = comb(width, k) if 0 < k <= width else 0
    v = stage(vertical(m, width, max(width, 1)), "vertical")
    found = v.agg(F.max("others")).first()[0]
    codes, words = 4 if found else 3, _words(v)
    least = max(1, min(total, m.sparkSession.sparkContext.defaultParallelism))
    nodes = nodes or max(least, -(-total * codes**k * max(words, 1) // WORDS))
    ranges = _ranges(nodes, only, total)
    dealt, segments = _dealt(v, words, width)

    def count(table: pa.Table) -> pa.Table:
        node, start, stop = (table[c][0].as_py() for c in ("node", "start", "stop"))
        held = list(_held(table, width).values())
        sizes = sorted(zip(table["part"].to_pylist(), table["n0"].to_pylist(), table["n1"].to_pylist(), strict=True))
        bits = []
        for y in (0, 1):
            known = np.concatenate([x[y] for x in held], axis=2)
            if codes == 4:
                every = np.concatenate([_bits(np.zeros((s[1 + y], 1), np.int8))[0, 0] for s in sizes])
                known = np.concatenate((known, (every & ~np.bitwise_or.reduce(known, axis=1))[:, None]), axis=1)
            bits.append(known)
        names, cells, ranks, rank = [], ([], []), [], start
        shared: list[list] = [[], []]  # of each class: ANDed bitmaps of the prefix, feature by feature
        before: tuple[int, ...] = ()
        for prefix, first, end in runs(start, stop, width, k):
            same = next((i for i, (x, y) in enumerate(zip(prefix, before, strict=False)) if x != y), min(len(prefix), len(before)))
            for y in (0, 1):
                del shared[y][same:]
                for f in prefix[same:]:
                    above = shared[y][-1] if shared[y] else np.full((1, bits[y].shape[2]), ~np.uint64(0))
                    shared[y].append((above[:, None] & bits[y][f][None]).reshape(-1, bits[y].shape[2]))
                above = shared[y][-1] if shared[y] else np.full((1, bits[y].shape[2]), ~np.uint64(0))
                last = bits[y][first:end].reshape(-1, bits[y].shape[2])
                cells[y].append(_both(above, last).reshape(len(above), end - first, codes).transpose(1, 0, 2).reshape(end - first, -1))
            before = prefix
            names += [",".join(map(str, (*prefix, j))) for j in range(first, end)]
            ranks += range(rank, rank + end - first)
            rank += end - first
        lists = []
        for x in cells:
            flat = np.concatenate(x) if x else np.zeros((0, codes**k), np.int64)
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * codes**k, pa.int32()), pa.array(flat.reshape(-1))))
        return pa.table([pa.array([node] * len(ranks), pa.int32()), pa.array(ranks, pa.int64()), pa.array(names, pa.string()), *lists], names=["node", "rank", "attributes", "ctl", "cas"])

    rows = dealt.select("part", "n0", "n1", "bits0", "bits1", "segment", ranges)
    rows = rows.select("part", "n0", "n1", "bits0", "bits1", "segment", "r.*")
    counts = rows.groupBy("node", "segment").applyInArrow(count, "node int, rank long, attributes string, ctl array<long>, cas array<long>")
    if segments > 1:
        plus = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0).cast("long"), codes**k), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(c)
        counts = counts.groupBy("node", "rank", "attributes").agg(plus("ctl"), plus("cas"))
    return counts


def _ranges(nodes: int, only: list[int] | None, total: int) -> Column:
    """A generator column r (node, start, stop): what ``rank_ranges`` says, made where it is needed."""
    numbers = f"sequence(0, {nodes - 1})" if only is None else f"CAST(array({', '.join(map(str, only))}) AS ARRAY<INT>)"
    each, rest = divmod(total, nodes)
    start = lambda i: f"(CAST({i} AS BIGINT) * {each} + CAST({i} AS BIGINT) * {rest} DIV {nodes})"
    some = f"filter({numbers}, i -> {start('i')} < {start('i + 1')})"
    return F.explode(F.expr(f"transform({some}, i -> named_struct('node', i, 'start', {start('i')}, 'stop', {start('i + 1')}))")).alias("r")


def kway_bits(m: DataFrame, width: int, ways: list[int], nodes: int | None = None, only: list[int] | None = None) -> DataFrame:
    """(attributes, n_attributes, balanced_accuracy): what ``kway_models`` gives, from bitmaps.

    Codes other than 0, 1, 2 are one code. ``nodes`` and ``only``: the search is cut into so many
    ranges of ranks for each number of ways, of which these run (all, if none are named).
    """
    out = None
    for k in sorted({k for k in ways if 0 < k <= width}):
        counts = kway_counts(m, width, k, nodes, only)
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        rows = counts.withColumns({"n0": total("ctl"), "n1": total("cas")})
        high = lambda c, d: d * F.col("n0") > c * F.col("n1")
        zero = F.lit(0).cast("long")
        rows = rows.withColumns({"tp": total(F.zip_with("ctl", "cas", lambda c, d: F.when(high(c, d), d).otherwise(zero))), "tn": total(F.zip_with("ctl", "cas", lambda c, d: F.when(high(c, d), zero).otherwise(c)))})
        half = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) / 2
        part = rows.select("attributes", F.lit(k).alias("n_attributes"), (half("tp", "n1") + half("tn", "n0")).alias("balanced_accuracy"))
        out = part if out is None else out.unionByName(part)
    return out
