"""All thresholds of a network from one maximum spanning forest.

Two nodes are connected by edges of at least some weight exactly if a maximum spanning forest connects
them by such edges. So the components at every threshold follow from at most n - 1 edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from genoloom.operators.graph import connected_components
from genoloom.scratch import drop, stage


def _relabelled(edges: DataFrame, end: str, labels: DataFrame) -> DataFrame:
    """``edges`` with the component of its node ``end``; a hot hub's edges can be split by the planner."""
    found = labels.select(F.struct("node").alias("_k"), F.col("component").alias("_c"))
    return edges.withColumn("_k", F.struct(F.col(end).alias("node"))).join(found, "_k").drop("_k", end).withColumnRenamed("_c", end)


#: Edges between components, at most, that one task joins.
LAST = 200_000


def _joined_by_one(edges: DataFrame) -> DataFrame:
    """(e): the forest's edges among at most LAST rows (u, v, e), the best first."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        table = pa.Table.from_batches(batches, schema=arrow)
        kept = []
        for k, (u, v) in enumerate(zip(table["u"].to_pylist(), table["v"].to_pylist(), strict=True)):
            u, v = root(u), root(v)
            if u != v:
                above[u] = v
                kept.append(k)
        yield from table.select(["e"]).take(pa.array(kept, pa.int64())).to_batches()

    rows = edges.repartition(1).sortWithinPartitions(F.desc("e")).select("u", "v", "e")
    shape = edges.select("e").schema
    arrow = to_arrow_schema(rows.schema)
    return rows.mapInArrow(join, shape)


def maximum_spanning_forest(edges: DataFrame, weight: str, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(a, b, weight): a maximum spanning forest of an undirected network, a < b.

    Borůvka's rounds: every component picks its best edge (by weight, then by the nodes' names, so picks
    close no circle), the picked edges join components, edges inside a component go, and of parallel
    ones the best stays. Components at least halve in a round; each round is a table in the shared
    folder. When at most LAST edges are left, one task takes them from the best down. Null ends or weights, NaN weights and self edges are left out.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("w")).where("a <> b AND w IS NOT NULL AND NOT isnan(w)")
    best = F.max(F.struct("w", "a", "b")).alias("e")
    now = stage(known.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w").groupBy("u", "v").agg(F.max("w").alias("w")).selectExpr("u", "v", "struct(w, u AS a, v AS b) AS e"), "edges")
    picked: DataFrame | None = None
    for _ in range(most_rounds):
        if now.count() <= LAST:
            last = _joined_by_one(now)
            picked = last if picked is None else picked.unionByName(last)
            break
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("other")), F.struct(F.col("v").alias("c"), F.col("u").alias("other")))).alias("p"), "e").select("p.*", "e")
        picks = stage(ends.groupBy("c").agg(F.max(F.struct("e", "other")).alias("x")).select("c", "x.other", "x.e"), "picks")
        chosen = picks.select("e").distinct()
        picked = chosen if picked is None else picked.unionByName(chosen)
        labels = stage(connected_components(picks, "c", "other"), "joined")
        merged = _relabelled(_relabelled(now, "u", labels), "v", labels).where("u <> v")
        merged = merged.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "e").groupBy("u", "v").agg(F.max("e").alias("e"))
        now, before = stage(merged, "edges"), now
        drop(before, labels)
    else:
        raise RuntimeError(f"the forest did not settle in {most_rounds} rounds")
    return picked.select(F.col("e.a").alias(a), F.col("e.b").alias(b), F.col("e.w").alias(weight))



def threshold_nodes(edges: DataFrame, weight: str, thresholds: list[float], a: str = "a", b: str = "b") -> DataFrame:
    """(th, node, degree, component): each node of the graph at each threshold that it has an edge at.

    component is the smallest node connected at that threshold. A node's edges are counted by the
    number of thresholds they reach, which gives its degrees at all of them; components come from the
    forest's edges only. Parallel edges count each; a self edge counts twice; null ends are left out.
    """
    ths = sorted(set(map(float, thresholds)))
    array = F.array(*[F.lit(t) for t in ths])
    rows = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("w"), F.size(F.filter(array, lambda t: F.col(weight) >= t)).alias("level")).where("level > 0 AND NOT isnan(w)")
    rows = stage(rows, "network")
    counts = rows.select(F.explode(F.array("a", "b")).alias("node"), "level").groupBy("node", "level").agg(F.count(F.lit(1)).alias("n"))
    by_node = counts.groupBy("node").agg(F.collect_list(F.struct("level", "n")).alias("x"))  # at most a row a threshold
    degree = lambda k: F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + F.when(x["level"] >= k, x["n"]).otherwise(0))
    each = F.transform(F.sequence(F.lit(1), F.array_max(F.transform("x", lambda x: x["level"]))), lambda k: F.struct(F.get(array, k - 1).alias("th"), degree(k).alias("degree")))
    degrees = by_node.select("node", F.explode(each).alias("d")).select("d.th", "node", "d.degree")
    forest = maximum_spanning_forest(rows, "w").select("a", "b", F.explode(F.filter(array, lambda t: F.col("w") >= t)).alias("th"))
    key = lambda c: F.struct("th", F.col(c).alias("node"))
    parts = connected_components(forest.select(key("a").alias("a"), key("b").alias("b")))
    parts = parts.select("node.th", "node.node", F.col("component.node").alias("component"))
    return degrees.join(parts, ["th", "node"], "left").withColumn("component", F.coalesce("component", "node"))


def threshold_statistics(nodes: DataFrame) -> DataFrame:
    """(th, nodes, edges, components, largest_hub, lc_nodes, lc_edges, lc_largest_hub) of ``threshold_nodes``.

    What ``sweep_statistics`` gives, by sums over components. Of equally large components the one of
    the smallest name is the largest.
    """
    parts = nodes.groupBy("th", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("ends"), F.max("degree").alias("hub"))
    largest = F.min(F.struct((-F.col("size")).alias("size"), "component", "ends", "hub")).alias("lc")
    out = parts.groupBy("th").agg(F.sum("size").alias("nodes"), F.sum("ends").alias("ends"), F.count(F.lit(1)).alias("components"), F.max("hub").alias("largest_hub"), largest)
    half = lambda c: F.shiftright(c, 1)
    return out.select("th", "nodes", half("ends").alias("edges"), "components", "largest_hub", (-F.col("lc.size")).alias("lc_nodes"), half(F.col("lc.ends")).alias("lc_edges"), F.col("lc.hub").alias("lc_largest_hub"))


def in_largest(nodes: DataFrame) -> DataFrame:
    """The rows of ``threshold_nodes`` that lie in the largest component of their threshold."""
    sizes = nodes.groupBy("th", "component").agg(F.count(F.lit(1)).alias("size"))
    lc = sizes.groupBy("th").agg(F.min(F.struct((-F.col("size")).alias("size"), "component")).alias("lc")).select("th", "lc.component")
    return nodes.join(F.broadcast(lc), ["th", "component"], "left_semi")  # a row a threshold


def degree_shares(nodes: DataFrame) -> DataFrame:
    """(th, degree, n, share): the degree histogram of each threshold."""
    counts = nodes.groupBy("th", "degree").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("th")))


def kept_components(nodes: DataFrame, sizes: list[int]) -> DataFrame:
    """(th, at_least, components, nodes, edges): what every threshold and smallest size of a component keep.

    A sweep over both parameters of a network, from ``threshold_nodes``; a pair that keeps nothing has
    no row.
    """
    parts = nodes.groupBy("th", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("ends"))
    each = parts.select("th", "size", "ends", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("size") >= s)).alias("at_least"))
    return each.groupBy("th", "at_least").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"), F.shiftright(F.sum("ends"), 1).alias("edges"))
