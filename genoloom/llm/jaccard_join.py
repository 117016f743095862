"""N-gram Jaccard join with a count-vector R-tree.

Every text's distinct shingles are hashed into ``GROUPS`` groups; the counts per group are the
text's point. For two sets, the sum of the smaller counts over all groups is at least the size of
their intersection, and the same sum against the upper corner of a box bounds every point in the
box. So a tree of boxes prunes whole branches of texts, and only pairs that survive are verified on
their full shingle sets. The result is exact: no bound drops a pair that links.

Boxes over many unrelated texts bound nothing, so points first go to the buckets of a routing
level: the shingles of a set are put in one global order (rare ones first, by a fixed-size count
sketch over all texts) and a set goes to the buckets of its first shingles, so many (``prefix_size``)
that two sets with similarity t share about n / SPARE of these. Sets that share fewer are never
compared. Inside, every pair that is verified comes out of a tree. Nothing emits the pairs of a
bucket: its sets of neighbouring size classes form a family, named after its smallest set, so the
many buckets that near-copies share collapse into one family, and

1. the first set of the family in which a set shares most buckets is searched in the tree of these
   sets (one pair a set; a large family has many trees); verified links give components;
2. families that still hold several components are joined tree with tree. A family of more than
   ``BLOCK`` sets is cut into blocks, each written once to the shared folder; pairs of blocks whose
   boxes allow a link are read by the task that joins them. A task verifies what the bounds leave
   between different components and emits only links that merge components.

Equal sets are one class from the start (map-side and by 128 bits of hash), so copies cost nothing.
Shingles are told apart by 64 bits when a set is counted and by 48 when two are compared: between
two sets of 1,000 a false match has a chance of 4e-9.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts
from genoloom.operators.hot import join_groups
from genoloom.llm.warc import store_of
from genoloom.operators.graph import connected_components
from genoloom.scratch import drop, new_path, scoped, stage

#: Groups of the count vectors; counters of the rarity sketch; points of a leaf; children of a box.
GROUPS, SKETCH, LEAF, FAN = 256, 1 << 20, 16, 8
SKETCH_PARTS = 64
#: Sets of a star's tree and of a block; rows of a bucket that one task counts, about.
STAR, BLOCK, BUCKET = 256, 512, 100_000
#: Pairs of blocks that a task joins.
PAIRS_A_TASK = 64
#: Bits of the filter that keeps sets which no candidate pair names out of the shuffle (1 MB).
FILTER_BITS = 1 << 23
#: Sets of n shingles go to n // SPARE buckets more than one common bucket would need.
SPARE = 20
U = np.uint64

SETS = "doc_id long, n_shingles long, node long, other long, shingles binary"


def needed(n_a, n_b, percent: int):
    """The least intersection at which sets of these sizes have 100 * both >= percent * union."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def prefix_size(n, percent: int):
    """How many first shingles of a set of n go to buckets.

    n - ceil(t * n) + 1 would make sure that partners share one; n // SPARE more make sure that they
    share 1 + min(n_a // SPARE, n_b // SPARE): if fewer lay in both prefixes, at most that many and
    the ceil(t * n) - 1 - n // SPARE shingles after the prefix that ends first could be common.
    """
    return n - -(-percent * n // 100) + 1 + n // SPARE


def count_vectors(of: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Points: for each text, how many of its distinct shingles fall into each group."""
    group = (hashes & U(GROUPS - 1)).astype(np.int64)
    return np.bincount(of * GROUPS + group, minlength=n_texts * GROUPS).reshape(n_texts, GROUPS)


class CountRTree:
    """A packed R-tree of count vectors: leaves of LEAF points that lie near each other on a fixed
    projection, boxes of FAN nodes up to one root. ``levels`` go from the leaves up; each has the
    upper corner of its nodes, and the least and the largest size of a set below them."""

    def __init__(self, points: np.ndarray):
        line = points @ np.random.default_rng(11).standard_normal(points.shape[1])
        self.order = np.argsort(line, kind="stable")
        self.points = points[self.order].astype(np.int32)
        self.sizes = self.points.sum(axis=1)
        self.levels, fan, level = [], LEAF, (self.points, self.sizes, self.sizes)
        while not self.levels or len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(level[0]), fan)
            if not len(at):
                break
            level = np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at)
            self.levels.append(level)
            fan = FAN

    def below(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of a level, or (-1) the points."""
        return self.levels[depth] if depth >= 0 else (self.points, self.sizes, self.sizes)

    def join(self, other: CountRTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (in the two inputs) of all pairs of points whose bound allows a link."""
        none = np.zeros(0, np.int64)
        if not (self.levels and other.levels):
            return none, none
        d, e = len(self.levels) - 1, len(other.levels) - 1
        a = b = np.zeros(1, np.int64)
        while d >= 0 or e >= 0:
            # The higher side goes down a level, both do if they are level.
            down_a, down_b = d >= e, e >= d
            if down_a:
                a, b = _children(a, b, LEAF if d == 0 else FAN, len(self.below(d - 1)[0]))
                d -= 1
            if down_b:
                b, a = _children(b, a, LEAF if e == 0 else FAN, len(other.below(e - 1)[0]))
                e -= 1
            kept = [_possible(self.below(d), other.below(e), a[i : i + 4096], b[i : i + 4096], percent) for i in range(0, len(a), 4096)]
            a, b = (np.concatenate(x) for x in zip((none, none), *kept, strict=True))
        return self.order[a], other.order[b]


def _children(nodes: np.ndarray, partners: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The children (of n in all) of each of ``nodes``, with the node's partner."""
    first = nodes * fan
    count = np.minimum(first + fan, n) - first
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + step, np.repeat(partners, count)


def _possible(left: tuple, right: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of nodes a, b below which the summed smaller counts allow a link."""
    (high, least, most), (high2, least2, most2) = left, right
    near = (100 * most2[b] >= percent * least[a]) & (100 * most[a] >= percent * least2[b])
    a, b = a[near], b[near]
    ok = np.minimum(high[a], high2[b]).sum(axis=1) >= needed(least[a].astype(np.int64), least2[b].astype(np.int64), percent)
    return a[ok], b[ok]


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64) if values.dtype != U else values.view(np.int64))


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """SETS rows: the distinct shingles of each text (48 bits of each); node, other: hashes of the whole set."""

    def whole(h: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
        sums = np.concatenate(([U(0)], np.cumsum(ts.mix(h ^ U(salt)))))
        return ts.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.pieces(batch, "text"):
                words = ts.Words(part.column(1))
                of, h = ts.shingle_sets(words, size)
                counts = np.bincount(of, minlength=words.n_texts)
                first = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), _int64(counts), _int64(whole(h, first, 0x5851F42D4C957F2D)), _int64(whole(h, first, 0x14057B7EF767814F)), ts.binary_rows(ts.pack48(h >> U(16)), counts)],
                    names=["doc_id", "n_shingles", "node", "other", "shingles"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(scan, SETS)


def told_apart(sets: DataFrame) -> DataFrame:
    """``sets`` with other nodes for sets that share theirs with a different set.

    Among n sets about n * n / 4e19 are expected to: few enough for a list up to any n.
    """
    seen = sets.where("n_shingles > 0").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    bad = [r["node"] for r in seen.where("lo <> hi").collect()]
    if not bad:
        return sets
    return sets.withColumn("node", F.when(F.col("node").isin(bad), F.xxhash64("node", "other")).otherwise(F.col("node")))


def rarity_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all shingles of all texts by hash modulo SKETCH: of fixed size, summed on executors.

    A task packs its counters into SKETCH_PARTS parts, which as many tasks add up.
    """

    def packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1) for x in total.reshape(SKETCH_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts)], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in ts.pieces(batch, "shingles"):
                h = ts.unpack48(b"".join(part.column(0).to_pylist()))
                total += np.bincount((h & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        yield from packed(total)

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in groups:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(data.as_buffer()), np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()])], names=["part", "counts"])

    shape = "part long, counts binary"
    with scoped(sets.sparkSession):
        found = sets.select("shingles").where("n_shingles > 0").mapInArrow(count, shape).repartition(SKETCH_PARTS, "part").mapInArrow(add, shape).collect()
    out = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int32)
    for part, data in found:
        out[part] = np.frombuffer(data, np.int32)
    return out.reshape(-1)


def routed(sets: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """(bucket, salt, salts, node, n): a row for each bucket of each set; once for each class of a task.

    salts: into how many parts the bucket is cut, by what its shingle's counter has over two times the
    mean (a counter holds the counts of many shingles).
    """
    held = sets.sparkSession.sparkContext.broadcast(sketch)
    mean, bucket = 2 * int(sketch.mean()), BUCKET

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = held.value, set()
        for batch in batches:
            new = [i for i, x in enumerate(batch.column(1).to_pylist()) if not (x in seen or seen.add(x))]
            for part in ts.pieces(batch.take(pa.array(new, pa.int64())), "shingles"):
                h = ts.unpack48(b"".join(part.column(2).to_pylist()))
                n = part.column(0).to_numpy()
                of = np.repeat(np.arange(len(n)), n)
                often = counts[(h & U(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((h, often, of))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = order[rank < np.repeat(prefix_size(n, percent), n)]
                keep_of = of[keep]
                node = part.column(1).to_numpy()[keep_of]
                salts = 1 + np.maximum(often[keep].astype(np.int64) - mean, 0) // bucket
                salt = (ts.mix(node.view(U)) % salts.astype(U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_int64(h[keep]), pa.array(salt), pa.array(salts.astype(np.int32)), pa.array(node), pa.array(n[keep_of].astype(np.int32))], names=["bucket", "salt", "salts", "node", "n"])

    return sets.where("n_shingles > 0").select("n_shingles", "node", "shingles").mapInArrow(emit, "bucket long, salt int, salts int, node long, n int")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node, n) of the buckets that several sets may be in: one shuffle, a hot bucket in parts."""
    part = ["bucket", "salt"]
    rows = rows.repartition(*part).dropDuplicates([*part, "node"]).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    return rows.where("m > 1 OR salts > 1").select("bucket", "node", "n")


def with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (node and others) with the shingles of their node, by one shuffle of those sets only.

    A filter of fixed size keeps sets that no row names where they are; what it lets through by
    chance falls out of the join.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[(ts.mix(batch.column(0).to_numpy().view(U)) & U(FILTER_BITS - 1)).astype(np.int64)] = True
        for k, part in enumerate(np.packbits(bits).reshape(16, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()])], names=["part", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out[k] = out.get(k, np.uint8(0)) | np.frombuffer(data.as_py(), np.uint8)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([x.tobytes() for x in out.values()])], names=["part", "bits"])

    shape = "part long, bits binary"
    bits = np.zeros((16, FILTER_BITS // 8 // 16), np.uint8)
    with scoped(sets.sparkSession):
        found = rows.select("node").mapInArrow(mark, shape).repartition(4, "part").mapInArrow(either, shape).collect()
    for k, data in found:
        bits[k] = np.frombuffer(data, np.uint8)
    held = sets.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = held.value, set()
        for batch in batches:
            at = (ts.mix(batch.column(0).to_numpy().view(U)) & U(FILTER_BITS - 1)).astype(np.int64)
            hit = np.flatnonzero(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            node = batch.column(0).to_numpy()
            new = [i for i in hit.tolist() if not (node[i] in seen or seen.add(node[i]))]
            if new:
                yield batch.take(pa.array(new))

    full = sets.where("n_shingles > 0").select("node", "shingles").mapInArrow(named, "node long, shingles binary")
    return rows.join(full.repartition("node").dropDuplicates(["node"]), "node")


def families(shared: DataFrame, percent: int) -> DataFrame:
    """(hub, band, node, f, own): sets that share buckets and a size class, under the first of them.

    Classes are powers of 4/3. A set is in its own class and the one below, so two sets whose sizes
    allow a link meet in the lower one's class. f counts the buckets of the class that a set has
    under a hub. Partners of a set share at least ``least`` buckets with it: a set with fewer is
    left out, and so are its hubs of the smallest f that make up less than half of ``least``, for
    the partner leaves out less than half too, and a common bucket under a kept hub remains.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    rows = shared.select("bucket", F.explode(F.array(band, band - 1)).alias("band"), band.alias("at"), "node", F.col("n").alias("size"))
    hub = rows.groupBy("bucket", "band").agg(F.min(F.struct("size", "node")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "band", F.col("hub.node").alias("hub"), "n")
    counted = join_groups(rows, hub, ["bucket", "band"]).groupBy("hub", "band", "node", "size", "at").agg(F.count(F.lit(1)).alias("f"))
    least = 1 + F.floor(F.ceil(percent * F.col("size") / 100) / SPARE)
    mine = Window.partitionBy("node", "band")
    counted = counted.withColumns({"least": least, "total": F.sum("f").over(mine), "tail": F.sum("f").over(mine.orderBy("f", "hub"))})
    return counted.where("total >= least AND 2 * tail >= least").select("hub", "band", "node", "f", (F.col("at") == F.col("band")).alias("own"))


def overlaps(one: np.ndarray, flat: np.ndarray, first: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others of a list (flat and first: all sets)."""
    n = first[others + 1] - first[others]
    at = np.repeat(first[others], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x = flat[at]
    same = one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x
    sums = np.concatenate(([0], np.cumsum(same)))
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a column in one array, and where each begins."""
    data = column.to_pylist()
    return ts.unpack48(b"".join(data)), np.concatenate(([0], np.cumsum([len(x) // 6 for x in data])))


def star_links(family: DataFrame, sets: DataFrame, percent: int, candidates=None) -> DataFrame:
    """(a, b): links of each set with the first set of its largest family.

    That set is searched in trees of at most about STAR others; what is found is verified on full
    sets. candidates: an accumulator that counts what the trees give.
    """
    best = family.where("own").groupBy("node").agg(F.max(F.struct("f", "hub")).alias("best"))
    pairs = stage(best.select(F.col("best.hub").alias("hub"), "node").where("hub <> node"), "stars")
    trees = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / STAR).cast("int"))
    rows = join_groups(pairs, trees, ["hub"]).select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), "node")
    hubs = trees.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("hub").alias("node"))
    rows = stage(rows.unionByName(hubs).select("node", "hub", "salt", "member"), "stars-of-families")
    dealt = with_sets(rows, sets).select("hub", "salt", "member", "node", "shingles").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), part in _groups(batches, 2):
            flat, first = _flat(part.column(4))
            n = np.diff(first)
            points = count_vectors(np.repeat(np.arange(len(n)), n), flat, len(n))
            found = np.sort(CountRTree(points[1:]).join(CountRTree(points[:1]), percent)[0]) + 1
            if candidates is not None:
                candidates.add(len(found))
            both = overlaps(flat[: n[0]], flat, first, found)
            node = part.column(3).to_numpy()[found[100 * both >= percent * (n[found] + n[0] - both)]]
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), hub)), pa.array(node)], names=["a", "b"])

    out = stage(dealt.mapInArrow(verify, "a long, b long"), "links")
    drop(rows, pairs)
    return out


def merging_links(comp: np.ndarray, flat: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among candidate pairs that merge components, verified on full sets.

    comp: a component number of each set. Pairs of one component (as merged so far) are not tested.
    """
    parent = {c: c for c in np.unique(comp).tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    size = np.diff(first)
    found: list[tuple[int, int]] = []
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    cuts = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1], [True]))) if len(left) else [0]
    for s, t in zip(cuts[:-1], cuts[1:], strict=True):
        a = int(left[s])
        mine = root(int(comp[a]))
        other = np.array([b for b in right[s:t].tolist() if root(int(comp[b])) != mine], np.int64)
        for i in range(0, len(other), 256):
            b = other[i : i + 256]
            both = overlaps(flat[first[a] : first[a + 1]], flat, first, b)
            for x in b[100 * both >= percent * (size[a] + size[b] - both)].tolist():
                c, d = root(int(comp[a])), root(int(comp[x]))
                if c != d:
                    parent[max(c, d)] = min(c, d)
                    found.append((a, x))
    return found


class Block:
    """Sets of a family: nodes, components, shingles, and the tree of their points."""

    def __init__(self, node: np.ndarray, comp: np.ndarray, flat: np.ndarray, first: np.ndarray):
        self.node, self.comp, self.flat, self.first = node, comp, flat, first
        self.tree = CountRTree(count_vectors(np.repeat(np.arange(len(node)), np.diff(first)), flat, len(node)))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, node=self.node, comp=self.comp, flat=self.flat, first=self.first)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Block:
        with np.load(io.BytesIO(data)) as x:
            return Block(x["node"], x["comp"], x["flat"], x["first"])

    def links(self, other: Block, percent: int, candidates=None) -> pa.RecordBatch:
        """(a, b): the links with ``other`` (or inside) that merge components."""
        a, b = self.tree.join(other.tree, percent)
        node, comp, flat, first = self.node, self.comp, self.flat, self.first
        if other is self:
            a, b = a[a < b], b[a < b]
        else:
            b = b + len(node)
            first = np.concatenate((first, first[-1] + other.first[1:]))
            node, comp, flat = (np.concatenate(x) for x in ((node, other.node), (comp, other.comp), (flat, other.flat)))
        keep = comp[a] != comp[b]
        if candidates is not None:
            candidates.add(int(keep.sum()))
        found = np.array(merging_links(comp, flat, first, a[keep], b[keep], percent), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])


INSIDE = "a long, b long, hub long, band int, block int, path string, least long, most long, high binary"


def crossing_links(family: DataFrame, component: DataFrame, sets: DataFrame, percent: int, candidates=None) -> DataFrame:
    """(a, b): links that merge components of a family, by the R-trees of its blocks.

    Each block is joined with itself by the task that gathers it. The blocks of a larger family are
    written once; an index of their boxes gives the pairs of blocks that are read and joined.
    candidates: an accumulator that counts pairs of different components that the trees give.
    """
    spark = family.sparkSession
    keys = ["hub", "band"]
    rows = stage(family.join(component, "node", "left").select(*keys, "node", F.coalesce("component", "node").alias("component")), "family-components")
    mixed = rows.groupBy(*keys).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n")
    dealt = stage(join_groups(rows, mixed, keys).select("node", *keys, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "component"), "blocks")
    full = with_sets(dealt, sets).select(*keys, "block", "blocks", "node", "component", "shingles")
    full = full.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "node")
    folder = new_path(spark, "block-files")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INSIDE.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for (hub, band, k, blocks), part in _groups(batches, 4):
            block = Block(part.column(4).to_numpy(), part.column(5).to_numpy(), *_flat(part.column(6)))
            links = block.links(block, percent, candidates)
            cells = [*links.columns, *[pa.nulls(len(links), t) for t in types[2:]]]
            yield pa.RecordBatch.from_arrays(cells, names=names)
            if blocks > 1:
                store, place = store_of(folder)
                store.create_dir(place, recursive=True)
                name = uuid.uuid4().hex
                with store.open_output_stream(f"{place}/_{name}") as out:
                    out.write(block.pack())
                store.move(f"{place}/_{name}", f"{place}/{name}")
                (high,), (least,), (most,) = block.tree.levels[-1]
                row = (None, None, hub, band, k, f"{folder}/{name}", int(least), int(most), high.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    found = stage(full.mapInArrow(inside, INSIDE), "inside-blocks")
    drop(dealt, rows)
    index = found.where("path IS NOT NULL")
    links = found.where("path IS NULL").select("a", "b")
    if index.isEmpty():
        return links
    pair = index.select(*keys, "block", "path", "least", "most", "high").join(index.select(*keys, F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in ("path", "least", "most", "high")]), keys)
    pair = pair.where("block < block2").select("path", "least", "most", "high", "path2", "least2", "most2", "high2")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, least, most, high, path2, least2, most2, high2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                box, box2 = ((np.frombuffer(h, np.int32)[None], np.array([x]), np.array([y])) for h, x, y in ((high, least, most), (high2, least2, most2)))
                if len(_possible(box, box2, np.zeros(1, np.int64), np.zeros(1, np.int64), percent)[0]):
                    blocks = []
                    for p in (path, path2):
                        store, place = store_of(p)
                        with store.open_input_file(place) as file:
                            blocks.append(Block.unpack(file.read()))
                    yield blocks[0].links(blocks[1], percent, candidates)

    # A row here stands for two files, which planners take for a few bytes: deal pairs out by number.
    pair = pair.repartition(max(1, -(-pair.count() // PAIRS_A_TASK)), "path", "path2")
    return links.unionByName(stage(pair.mapInArrow(across, "a long, b long"), "across-blocks"))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first columns, of batches sorted by them."""
    key, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(n_keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for at, to in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            this = tuple(int(c[at]) for c in cols)
            if this != key and kept:
                yield key, pa.Table.from_batches(kept).combine_chunks()
                kept = []
            key = this
            kept.append(batch.slice(at, to - at))
    if kept:
        yield key, pa.Table.from_batches(kept).combine_chunks()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, candidates=None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: near-copies share the smallest id.

    Two texts link when 100 * |both sets| >= percent * |either set|, sets of distinct ``size``-word
    shingles of lower-cased (A-Z) words between white space. A text of fewer words is one shingle; a
    null text, or one without words, has an empty set, links with nothing and is its own component.
    Copies and repeated rows form one class; rows of one id keep a row each. A null id takes no part
    in choosing a component's smallest id unless all of its component are null. An empty table
    gives no rows. Extra columns are ignored. candidates: an accumulator that counts the pairs that
    trees give to be verified.
    """
    sets = told_apart(stage(shingle_table(docs, id_col, text_col, size), "sets"))
    shared = stage(shared_buckets(routed(sets, rarity_sketch(sets), percent)), "shared")
    family = stage(families(shared, percent), "families")
    drop(shared)
    links = star_links(family, sets, percent, candidates)
    more = crossing_links(family, connected_components(links), sets, percent, candidates)
    drop(family)
    parts = connected_components(links.unionByName(more)).withColumnRenamed("component", "part")
    # Classes first: a row for each set, so that a set of very many copies costs one.
    ids = sets.where("n_shingles > 0").select("doc_id", "n_shingles", "node")
    classes = ids.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).join(parts, "node", "left")
    classes = stage(classes.withColumn("part", F.coalesce("part", "node")), "classes")
    least = classes.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("component_id"))
    known = join_groups(classes.withColumnRenamed("n", "rows"), least, ["part"]).select("node", F.col("rows").alias("n"), "component_id")
    found = join_groups(ids, known, ["node"]).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
