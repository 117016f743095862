"""Graph operators over edge tables: dedup, components, ranks, degrees, statistics, sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.order import sum_before
from genoloom.scratch import drop, stage


def _same(df: DataFrame) -> tuple:
    """A digest of an edge table: its row count and an order-free sum of row hashes."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.sum(h)).first())


def _joined(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(v, m) of each edge (u, v) and the row (u, m) of its node."""
    return edges.select(F.struct("u").alias("k"), "v").join(low.select(F.struct("u").alias("k"), "m"), "k").select("v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes are those of any edge.

    Alternating large-star and small-star rounds: every round re-hangs neighbours on the smallest
    node seen, so paths shorten geometrically and a hub costs one row per neighbour, never a pair.
    Minima are pre-aggregated before each shuffle. They are joined back on the node in a struct, so
    that both sides are dealt out anew and adaptive execution can split a hot hub. Each round is cut by a table in the shared folder. Null ends are dropped; a self edge
    keeps its node as a component of its own.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = stage(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = e.where("u = v").select("u", "v")
    now, before = e.where("u <> v"), None
    kept = e
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _joined(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = _joined(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        seen = _same(new)
        if kept is not e:
            drop(kept)
        now = kept = new
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).unionByName(loops.select(F.col("u").alias("node"))).distinct()
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = roots.join(leaves, "node", "left_anti").select("node", F.col("node").alias("component"))
    return leaves.unionByName(roots)


def canonical_edges(edges: DataFrame, a: str = "a", b: str = "b", place: str = "at") -> DataFrame:
    """One row per undirected edge (a <= b): of its copies the attributes with the largest ``place``."""
    rest = [c for c in edges.columns if c not in (a, b, place)]
    rows = edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), F.struct(place, *rest).alias("_last"))
    kept = rows.groupBy(a, b).agg(F.max("_last").alias("_last"))
    return kept.select(a, b, *[F.col(f"_last.{c}").alias(c) for c in rest])


def merge_networks(networks: list[DataFrame], weight: str, at_least: float, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, weight): one network of the edges of several, less those under ``at_least``.

    Weak edges go before anything is shuffled. An edge that several networks have, in either
    direction, keeps its largest weight.
    """
    kept = [n.where(F.col(weight) >= at_least).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), weight) for n in networks]
    return reduce(DataFrame.unionByName, kept).groupBy(a, b).agg(F.max(weight).alias(weight))


def ranked_components(nodes: DataFrame) -> DataFrame:
    """(component, rank, size): rank 0 is the largest; equal sizes are ordered by component name."""
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sum_before(sizes, [F.desc("size"), F.asc("component")], F.lit(1), "rank")


def large_components(edges: DataFrame, at_least: int = 1, a: str = "a", b: str = "b") -> DataFrame:
    """(rank, size, node) of components with at least so many nodes."""
    nodes = connected_components(edges, a, b)
    sizes = ranked_components(nodes).where(F.col("size") >= at_least)
    return nodes.join(sizes, "component").select("rank", "size", "node")


def component_edges(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges of the components in ``nodes``, with their rank (both ends share it)."""
    return edges.join(nodes.select(F.col("node").alias(a), "rank"), a)


def degrees(edges: DataFrame, keys: list[str] | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, degree); a self edge counts twice."""
    keys = keys or []
    return edges.select(*keys, F.explode(F.array(a, b)).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))


def degree_histogram(edges: DataFrame, keys: list[str] | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(keys, degree, n, share): how many nodes have a degree, and their share of all nodes."""
    keys = keys or []
    counts = degrees(edges, keys, a, b).groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def sweep_statistics(edges: DataFrame, weight: str, thresholds: list[float], a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """(statistics, tagged edges) of the graph at each threshold and of its largest component.

    All thresholds run in one component loop, keyed by (th, node). statistics: th, nodes, edges,
    components, largest_hub, lc_nodes, lc_edges, lc_largest_hub. tagged: th, a, b, in_lc.
    """
    ths = F.array(*[F.lit(float(t)) for t in thresholds])
    tagged = edges.select(a, b, F.explode(F.filter(ths, lambda t: F.col(weight) >= t)).alias("th"))
    key = lambda c: F.struct("th", F.col(c).alias("node"))
    nodes = connected_components(tagged.select(key(a).alias("a"), key(b).alias("b")))
    nodes = nodes.select("node.th", F.col("node.node").alias("node"), F.col("component.node").alias("component"))
    sizes = nodes.groupBy("th", "component").agg(F.count(F.lit(1)).alias("size"))
    top = F.row_number().over(Window.partitionBy("th").orderBy(F.desc("size"), "component"))
    lc = sizes.withColumn("k", top).where("k = 1").select("th", "component", F.col("size").alias("lc_nodes"))
    of = nodes.join(lc, ["th", "component"], "left_semi").select("th", F.col("node").alias(a), F.lit(True).alias("in_lc"))
    tagged = tagged.join(of, ["th", a], "left").withColumn("in_lc", F.coalesce("in_lc", F.lit(False)))
    deg = degrees(tagged.where(F.col(a).isNotNull()), ["th", "in_lc"], a, b)
    hubs = deg.groupBy("th").agg(F.max("degree").alias("largest_hub"), F.max(F.when(F.col("in_lc"), F.col("degree"))).alias("lc_largest_hub"), F.count(F.lit(1)).alias("nodes"))
    counts = tagged.groupBy("th").agg(F.count(F.lit(1)).alias("edges"), F.count_if("in_lc").alias("lc_edges"))
    comps = sizes.groupBy("th").agg(F.count(F.lit(1)).alias("components"))
    stats = hubs.join(counts, "th").join(comps, "th").join(lc.drop("component"), "th")
    return stats.select("th", "nodes", "edges", "components", "largest_hub", "lc_nodes", "lc_edges", "lc_largest_hub"), tagged


def power_law(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): least squares fit of share = a * degree ** -b, by damped Gauss-Newton from (1, 1).

    A histogram has at most a row per degree, so each group is small; fewer than two degrees give
    nulls.
    """
    import numpy as np
    import pandas as pd

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group["degree"].to_numpy(float), group["share"].to_numpy(float)
        p, damp = np.array([1.0, 1.0]), 1e-3
        gap = lambda q: y - q[0] * x ** -q[1]
        best = (gap(p) ** 2).sum()
        for _ in range(500 if len(x) > 1 else 0):
            j = np.stack((x ** -p[1], -p[0] * np.log(x) * x ** -p[1]), axis=1)
            h = j.T @ j
            step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ gap(p))
            new = (gap(p + step) ** 2).sum()
            if new <= best:
                done = best - new <= 1e-15 * max(best, 1e-300)
                p, best, damp = p + step, new, damp / 3
                if done and np.abs(step).max() < 1e-12:
                    break
            elif damp > 1e12:
                break
            else:
                damp *= 4
        a, b = p if len(x) > 1 else (None, None)
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, "a": a, "b": b}])

    kinds = dict(histogram.dtypes)
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return histogram.select(*keys, "degree", "share").groupBy(*keys).applyInPandas(fit, f"{shape}, a double, b double")
