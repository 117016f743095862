"""Resharding by minimum-cost flow.

Old shard sizes and new capacities make a small transport problem: staying is free, each byte moved
costs one (or what a cost matrix says). Its solution, by successive shortest paths, names the block
transfers that move the fewest bytes. Rows of an old shard stand in one order (large ones first);
the flow cuts that order into a part that stays and blocks that go, so cuts fall among small rows
and new sizes are near equal. Only shards that a transfer touches are rewritten, beside the others; a
folder of whole shards is then renamed into its place, and a reader finishes what a lost driver left.

The order needs running sums over a whole shard. They come from sums of buckets (size classes times
hash values), which are a table, and a window inside a bucket; the driver sees shards and transfers.
A document's columns travel in one struct, so their names can't clash with those used here.
"""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from genoloom.operators.hot import few
from genoloom.scratch import drop, stage

#: Classes of row size; hash values of each, at least; rows of a class that one task orders, about.
SIZE_CLASSES, SPREAD, BUCKET = 40, 16, 1_000_000
#: Files of a layout, or parts of its shards, that are broadcast; those of more are joined by a shuffle.
FILES, PARTS = 100_000, 100_000
CUTS = "old int, from long, to long, new int"


def capacities(total: int, shards: int) -> list[int]:
    """Equal capacities, one apart at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[float]] | None = None) -> dict[tuple[int, int], int]:
    """{(from, to): bytes} of least cost that moves every supply into the demands (sums are equal).

    cost[i][j] is the price of a byte, by default 0 if i = j and else 1. Successive shortest paths
    with potentials on the residual graph of old and new shards; a flow of 0 is left out.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ")
    n, m = len(supply), len(demand)
    cost = cost or [[float(i != j) for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, need = list(supply), list(demand)
    high = [0.0] * (n + m)
    for source in range(n):
        while left[source]:
            dist, prev = [math.inf] * (n + m), [-1] * (n + m)
            dist[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                if u < n:
                    edges = ((n + j, cost[u][j]) for j in range(m))
                else:
                    edges = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
                for v, c in edges:
                    far = d + max(0.0, c + high[u] - high[v])
                    if far < dist[v] - 1e-12:
                        dist[v], prev[v] = far, u
                        heapq.heappush(heap, (far, v))
            sink = min((n + j for j in range(m) if need[j]), key=lambda v: dist[v] + high[v])
            high = [h + min(d, dist[sink]) for h, d in zip(high, dist, strict=True)]
            path, v = [], sink
            while prev[v] >= 0:
                path.append((prev[v], v))
                v = prev[v]
            amount = min([left[source], need[sink - n], *(flow[v][u - n] for u, v in path if u >= n)])
            for u, v in path:
                if u < n:
                    flow[u][v - n] += amount
                else:
                    flow[v][u - n] -= amount
            left[source] -= amount
            need[sink - n] -= amount
    return {(i, j): f for i, row in enumerate(flow) for j, f in enumerate(row) if f}


def row_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def old_layout(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A layout to start from: shards by a hash of id and text."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(shards)).cast("int")


def _spread(rows: DataFrame) -> int:
    """Hash values of a size class: as many as keep a bucket of the largest shard at about BUCKET rows."""
    return max(SPREAD, *(-(-r["count"] // BUCKET) for r in rows.groupBy("old").count().collect()), 0)  # a row a shard


def _bucketed(rows: DataFrame, spread: int) -> DataFrame:
    band = F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit(SIZE_CLASSES - 1))
    part = F.pmod("tie", F.lit(spread))
    return rows.withColumn("_bucket", ((SIZE_CLASSES - 1 - band) * spread + part).cast("int"))


def _buckets(rows: DataFrame) -> DataFrame:
    """(old, _bucket, _bytes, _offset) of bucketed rows: where a bucket begins in its shard's order."""
    sums = rows.groupBy("old", "_bucket").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("old").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return stage(sums.withColumn("_offset", F.coalesce(F.sum("_bytes").over(before), F.lit(0))), "buckets")


def _solve(buckets: DataFrame, new_shards: int, cost: list[list[float]] | None) -> tuple[dict[tuple[int, int], int], DataFrame]:
    """(transfers, CUTS) of the old shards' sums: a shard's order is cut at these byte positions.

    What stays comes first. The driver sees a row a shard and a cut a transfer.
    """
    sums = {r["old"]: r["bytes"] for r in buckets.groupBy("old").agg(F.sum("_bytes").alias("bytes")).collect()}
    supply = [sums.get(old, 0) for old in range(1 + max(sums, default=-1))]
    transfers = min_cost_flow(supply, capacities(sum(supply), new_shards), cost)
    cuts, at = [], [0] * len(supply)
    for old, new in sorted(transfers, key=lambda k: (k[0], k[1] != k[0], k[1])):
        cuts.append((old, at[old], at[old] + transfers[old, new], new))
        at[old] += transfers[old, new]
    return transfers, buckets.sparkSession.createDataFrame(cuts, CUTS)


def _ends(buckets: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, _cuts: each cut's first and last bucket), (old, _bucket, _offset: buckets that a cut divides).

    Buckets follow each other in a shard's order, so a cut is a range of them. Neither table has more
    rows than there are cuts.
    """
    met = buckets.join(F.broadcast(cuts), "old").where("_offset < `to` AND _offset + _bytes > `from`")
    spans = met.groupBy("old", "new").agg(F.min("_bucket").alias("first"), F.max("_bucket").alias("last"))
    spans = spans.groupBy("old").agg(F.collect_list(F.struct("first", "last", "new")).alias("_cuts"))
    divided = met.groupBy("old", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.first("_offset").alias("_offset")).where("n > 1").drop("n")
    return spans, divided


def _cut(rows: DataFrame, offsets: DataFrame, cuts: DataFrame, ties: list[str]) -> DataFrame:
    """Bucketed rows (of the buckets in ``offsets``) with shard: the cut that a row's middle byte lies in."""
    pieces = cuts.groupBy("old").agg(F.collect_list(F.struct("from", "to", "new")).alias("_pieces"))
    placed = rows.join(offsets, ["old", "_bucket"]).join(F.broadcast(pieces), "old")
    so_far = F.sum("size").over(Window.partitionBy("old", "_bucket").orderBy(F.desc("size"), "tie", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("_at", F.col("_offset") + so_far - F.col("size") + F.floor((F.col("size") - 1) / 2))
    inside = F.filter("_pieces", lambda c: (F.col("_at") >= c["from"]) & (F.col("_at") < c["to"]))
    return placed.withColumn("shard", inside[0]["new"]).drop("_pieces", "_at", "_offset")


def _slots(placed: DataFrame) -> DataFrame:
    """A written table of placed rows with slot: shards number their buckets' rows one bucket after another."""
    group = ["shard", "old", "_bucket"]
    before = Window.partitionBy("shard").orderBy("old", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(placed.groupBy(*group).count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "bases")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("size"), "tie"))
    return placed.withColumn("_rank", rank - 1).join(few(bases, PARTS), group).withColumn("slot", F.col("_base") + F.col("_rank")).drop("_bucket", "_rank", "_base")


def _packed(rows: DataFrame, own: list[str]) -> DataFrame:
    """``rows`` with the columns but ``own`` in one struct, _doc."""
    others = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in (*own, "shard", "slot")]
    return rows.select(*own, F.struct(*(others or [F.lit(0).alias("none")])).alias("_doc"))


def _fields(names: list[str]) -> list[Column]:
    return [F.col("_doc").getField(c).alias(c) for c in names if c.lower() not in ("shard", "slot")]


def reshard(rows: DataFrame, new_shards: int, cost: list[list[float]] | None = None) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(rows with shard int and slot long, the transfers {(old, new): bytes}).

    rows: old int (0 up), size long (at least 1), tie long (a hash that spreads rows) and others; it
    is read twice, so it should be a table. slot numbers a shard's rows from 0 without gaps. Sizes of
    new shards differ from their capacities by less than a row at each cut of the order. An empty
    table gives an empty one. Equal rows are placed one by one; which of them lies where is open.
    Columns named shard or slot are replaced, all others stay.
    """
    own = ["old", "size", "tie"]
    packed = _bucketed(_packed(rows, own), _spread(rows))
    buckets = _buckets(packed)
    transfers, cuts = _solve(buckets, new_shards, cost)
    out = _slots(stage(_cut(packed, few(buckets.drop("_bytes"), PARTS), cuts, []), "placed"))
    return out.select(*own, *_fields([c for c in rows.columns if c.lower() not in own]), "shard", "slot"), transfers


def _stored(name: str) -> str:
    """A document column's name in the files: those that a layout uses, or that begin so, get a mark."""
    return f"~{name}" if name.startswith("~") or name.lower() in ("shard", "slot") else name


def write_shards(docs: DataFrame, old: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet folders shard=N, by ``old``; its columns shard and slot as ~shard and ~slot."""
    spread = F.pmod(F.xxhash64(text_col, id_col), F.lit(max(SPREAD, docs.count() // BUCKET)))
    rows = docs.select(*[F.col(f"`{c}`").alias(_stored(c)) for c in docs.columns], old.alias("shard"), spread.alias("~"))
    rows.repartition("shard", "~").drop("~").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(_doc, shard, slot, _file, _row): documents in a struct, and their place in the files."""
    full = StructType([*[StructField(_stored(f.name), f.dataType) for f in schema], StructField("slot", LongType()), StructField("shard", IntegerType())])
    doc = F.struct(*[F.col(f"`{_stored(f.name)}`").alias(f.name) for f in schema])
    return spark.read.schema(full).parquet(path).select(doc.alias("_doc"), "shard", "slot", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of shard folders: columns of ``schema`` (but any named shard or slot), shard and slot.

    slot is what the file says (those of ``rewrite`` do), else the row's place in the shard's files in
    the order of their names. A change of the layout that lost its driver is finished first.
    """
    _finish(spark, path)
    rows = _rows(spark, path, schema)
    before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("shard", "_file").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = rows.join(few(files, FILES), ["shard", "_file"]).withColumn("slot", F.coalesce("slot", F.col("_before") + F.col("_row")))
    return rows.select(*_fields(schema.names), "shard", "slot")


def reshard_files(spark: SparkSession, path: str, schema: StructType, new_shards: int, cost: list[list[float]] | None = None, text_col: str = "text") -> dict[tuple[int, int], int]:
    """Reshard the folders shard=N of ``path`` in place; the transfers {(old, new): bytes}.

    Rows are told apart by file and place in it, so null and repeated ids are rows like others. Only
    rows of the buckets that a cut divides are put in order, in a narrow table; of all others the
    bucket tells the shard. Shards that no transfer touches keep their files. Of touched ones, rows
    that stay are copied where they are read; only rows that move are shuffled. One call at a time.
    """
    _finish(spark, path)
    fs, at = _files(spark, path)
    for half in fs.globStatus(at(f"{path}/_new-*")) or []:
        fs.delete(half.getPath(), True)
    docs = _rows(spark, path, schema).drop("slot").withColumnRenamed("shard", "old")
    docs = docs.withColumns({"size": row_size(F.col("_doc").getField(text_col)), "tie": F.xxhash64("_file", "_row")})
    place = ["_file", "_row"]
    narrow = stage(docs.select("old", "size", "tie", *place), "rows")
    spread = _spread(narrow)
    rows = _bucketed(narrow, spread)
    buckets = _buckets(rows)
    transfers, cuts = _solve(buckets, new_shards, cost)
    touched = {k for i, j in transfers if i != j for k in (i, j)}
    if touched:
        spans, divided = _ends(buckets, cuts)
        ordered = stage(_cut(rows, F.broadcast(divided), cuts, place).select("old", *place, F.col("shard").alias("_ordered")), "ordered")
        whole = F.filter("_cuts", lambda c: (F.col("_bucket") >= c["first"]) & (F.col("_bucket") <= c["last"]))
        told = _bucketed(docs.where(F.col("old").isin(*touched)), spread).join(F.broadcast(spans), "old").withColumn("shard", F.when(F.size(whole) == 1, whole[0]["new"]))
        moved = told.where("shard IS NULL OR shard <> old").join(ordered, ["old", *place], "left").withColumn("shard", F.coalesce("shard", "_ordered"))
        moved = moved.repartition("shard", F.pmod("tie", F.lit(spread)))
        stored = [F.col("_doc").getField(f.name).alias(_stored(f.name)) for f in schema]
        _publish(told.where("shard = old").select(*stored, "shard").unionByName(moved.select(*stored, "shard")), path, touched)
        drop(ordered)
    drop(narrow, buckets)
    return transfers


def _files(spark: SparkSession, path: str):
    """(the file system of ``path``, a function that makes its paths)."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _publish(rows: DataFrame, path: str, touched: set[int]) -> None:
    """Write the touched shards beside the others, rename that folder once it is whole, put it in place."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    new = f"{path}/_new-{name}"
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(new)
    fs, at = _files(spark, path)
    for k in sorted(touched):
        if not fs.exists(at(f"{new}/shard={k}")):
            fs.mkdirs(at(f"{new}/_empty/shard={k}"))
    if not fs.rename(at(new), at(f"{path}/_ready-{name}")):
        raise OSError(f"{new} can't be renamed")
    _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> None:
    """Put shards of a whole folder (_ready) in their places; repeated after a failure, it goes on.

    An old shard is deleted only while its new rows lie in that folder, so no row is lost.
    """
    fs, at = _files(spark, path)
    for ready in fs.globStatus(at(f"{path}/_ready-*")) or []:
        for shard in fs.globStatus(at(f"{ready.getPath()}/_empty/shard=*")) or []:
            fs.delete(at(f"{path}/{shard.getPath().getName()}"), True)
        for shard in fs.globStatus(at(f"{ready.getPath()}/shard=*")) or []:
            old = at(f"{path}/{shard.getPath().getName()}")
            fs.delete(old, True)
            if not fs.rename(shard.getPath(), old):
                raise OSError(f"{shard.getPath()} can't be renamed")
        fs.delete(ready.getPath(), True)


def rewrite(docs: DataFrame, placed: DataFrame, path: str, keys: list[str]) -> None:
    """Write the shards that transfers touch as Parquet folders shard=N; untouched ones are left.

    ``placed`` has all rows of ``docs`` with old, shard and slot. If it has all their columns too, its
    rows are written. Else rows meet null-safely on ``keys`` and all other columns that both have,
    equal ones one by one (numbered in one task each, so very many should not be equal); what both
    have must tell apart rows of different size or old shard.
    """
    touched = {r["shard"] for r in placed.where("old <> shard").select(F.explode(F.array("old", "shard")).alias("shard")).distinct().collect()}
    if not touched:
        return
    own = [c for c in docs.columns if c not in ("old", "shard", "slot")]
    right = placed.where(F.col("shard").isin(*touched))
    if set(own) <= set(placed.columns):
        rows = right
    else:
        both = [*keys, *[c for c in own if c in placed.columns and c not in keys]]
        # Grouping takes nulls as equal, so a number among equals needs no key of its own.
        nth = F.row_number().over(Window.partitionBy(*both).orderBy(F.lit(0)))
        left = docs.withColumn("_nth", nth)
        right = placed.withColumn("_nth", nth).where(F.col("shard").isin(*touched)).select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(both)], F.col("_nth").alias("_n"), "shard", "slot")
        same = F.col("_nth") == F.col("_n")
        for i, c in enumerate(both):
            same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
        rows = left.drop("old", "shard", "slot").join(right, same)
    _publish(rows.select(*own, "slot", "shard").repartition("shard", F.floor(F.col("slot") / BUCKET)).sortWithinPartitions("shard", "slot"), path, touched)
