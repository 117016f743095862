"""The jobs as registered queries: each runs its job twice into one new folder and reads the output back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.scratch import kept_path
from jobs import pair_counters, text_network


def _config(path: str) -> dict:
    with open(path) as file:
        return json.load(file)


COUNTERS, NETWORK = _config(pair_counters.CONFIG), _config(text_network.CONFIG)


def job1_pair_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job over orders; its second run finds nothing new."""
    at = kept_path(spark, "job1-pair-counters")
    for _ in range(2):
        found = pair_counters.run(spark, f"{sf_dir}/orders.parquet", f"{at}/output", f"{at}/checkpoint", COUNTERS)
    return found.withColumns({c: F.round(c, 9) for c in ("ig", "mi", "main_f1", "main_f2")})


def job2_text_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network and the encoded subjects of documents with labels, as rows of two sections."""
    at = kept_path(spark, "job2-text-network")
    for _ in range(2):
        network, subjects = text_network.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at, NETWORK)
    return subjects.withColumn("section", F.lit("subjects")).unionByName(network.withColumn("section", F.lit("network")), allowMissingColumns=True)


# ---------------------------------------------------------------- SQL twins

CELLS = [f"{n}{k}" for n in "cd" for k in range(9)]


def _bits(x: list[str], y: list[str]) -> str:
    """Bits of a bucket of counters x (controls, scaled by r) and y (cases), times its weight."""
    a, b = f"(({' + '.join(x)}) * r)", f"({' + '.join(y)})"
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN -({a} * log2({a} / ({a} + {b})) + {b} * log2({b} / ({a} + {b}))) ELSE 0 END"


def _gains_sql(rows: str, keys: str) -> str:
    """CTEs k (counters of ``rows`` with label, v1, v2 by keys) and gains (k with mi, main_f1, main_f2)."""
    counts = ", ".join(f"count(*) FILTER (label = {y} AND v1 = {k // 3} AND v2 = {k % 3}) AS {n}{k}" for y, n in enumerate("cd") for k in range(9))
    c, d = ([f"{n}{k}" for k in range(9)] for n in "cd")
    some = lambda ks: _bits([c[k] for k in ks], [d[k] for k in ks])
    value = lambda buckets: f"CASE WHEN all_d = 0 THEN 0 WHEN all_c = 0 THEN 'nan'::DOUBLE ELSE 1 - ({' + '.join(some(ks) for ks in buckets)}) / (2.0 * all_d) END"
    return f"""k AS (SELECT {keys}, {counts} FROM {rows} GROUP BY ALL),
s AS (SELECT *, {' + '.join(c)} AS all_c, {' + '.join(d)} AS all_d, ({' + '.join(d)})::DOUBLE / nullif({' + '.join(c)}, 0) AS r FROM k),
gains AS (SELECT *, {value([[i] for i in range(9)])} AS mi, {value([[3 * i, 3 * i + 1, 3 * i + 2] for i in range(3)])} AS main_f1, {value([[i, i + 3, i + 6] for i in range(3)])} AS main_f2 FROM s)"""


def _pairs_sql(names: list[str]) -> str:
    return f"n AS (SELECT {names!r} AS names), p(f1, f2) AS (SELECT a.i, b.i FROM range({len(names)}) a(i), range({len(names)}) b(i) WHERE a.i < b.i)"


JOB1_SQL = f"""
WITH m AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS cohort, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
    [CAST(o_orderkey % 3 AS INTEGER), CAST(o_custkey % 3 AS INTEGER), CAST(floor(o_totalprice) AS BIGINT) % 3, month(o_orderdate) % 3, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3] AS g FROM orders
), {_pairs_sql(list(COUNTERS["features"]))}, x AS (SELECT cohort, label, f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2 FROM m, p),
{_gains_sql("x", "cohort, f1, f2")}
SELECT cohort, names[f1 + 1] AS f1, names[f2 + 1] AS f2, {', '.join(CELLS)}, round(mi - main_f1 - main_f2, 9) AS ig, round(mi, 9) AS mi, round(main_f1, 9) AS main_f1, round(main_f2, 9) AS main_f2 FROM gains, n
"""

_RATIOS = ", ".join(f"CAST({' + '.join(f'CAST({f["of"]}::DOUBLE / greatest(({f["per"]})::DOUBLE, 1.0) >= {cut} AS INTEGER)' for cut in f['cuts'])} AS INTEGER)" for f in NETWORK["features"].values())
_WIDTH = len(NETWORK["features"])
JOB2_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
measured AS (
  SELECT doc_id, len(w) AS words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
    length(t) - length(regexp_replace(t, '[.!?]', '', 'g')) AS stops, length(t) - length(replace(t, chr(10), '')) AS lines, len(list_distinct(w)) AS distinct_words FROM t
), m AS (SELECT doc_id AS sid, CAST(1 - quality AS INTEGER) AS label, [{_RATIOS}] AS g FROM measured JOIN labels USING (doc_id) WHERE 1 - quality IN (0, 1)),
folds AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('{NETWORK["seed"]}:' || sid), sid) - 1) % {NETWORK["folds"]} AS fold FROM m),
train AS (SELECT * FROM folds WHERE fold <> 0),
{_pairs_sql(list(NETWORK["features"]))}, x AS (SELECT label, f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2 FROM train, p),
{_gains_sql("x", "f1, f2")},
e AS (SELECT f1, f2, round(mi - main_f1 - main_f2, 9) AS ig FROM gains WHERE round(mi - main_f1 - main_f2, 9) >= {NETWORK["threshold"]}),
both_ AS (SELECT f1 AS a, f2 AS b FROM e UNION SELECT f2, f1 FROM e),
reach AS (SELECT DISTINCT a AS node, a AS least FROM both_ UNION SELECT both_.b, least FROM reach JOIN both_ ON both_.a = node WHERE least < both_.b),
comp AS (SELECT node, min(least) AS component FROM reach GROUP BY node),
sizes AS (SELECT component, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS INTEGER) AS rank FROM comp GROUP BY component),
kept AS (SELECT rank AS component, f1, f2, ig FROM e JOIN comp ON node = f1 JOIN sizes USING (component) WHERE size >= {NETWORK["smallest_component"]}),
ratio AS (SELECT count(*) FILTER (label = 1)::DOUBLE / count(*) FILTER (label = 0) AS q FROM train),
signs AS (SELECT f1, f2, g[f1 + 1] AS v1, g[f2 + 1] AS v2, CASE WHEN count(*) FILTER (label = 0) * any_value(q) >= count(*) FILTER (label = 1) THEN 1 ELSE -1 END AS sign FROM train, kept, ratio GROUP BY ALL),
each AS (SELECT sid, kept.f1, kept.f2, coalesce(sign, 1) AS sign FROM folds CROSS JOIN kept LEFT JOIN signs ON signs.f1 = kept.f1 AND signs.f2 = kept.f2 AND v1 = g[kept.f1 + 1] AND v2 = g[kept.f2 + 1]),
ends AS (SELECT sid, f1 AS f, sign FROM each UNION ALL SELECT sid, f2, sign FROM each),
dd AS (SELECT sid, {', '.join(f'CAST(coalesce(sum(sign) FILTER (f = {i}), 0) AS INTEGER) AS d{i}' for i in range(_WIDTH))} FROM ends GROUP BY sid)
SELECT 'subjects' AS section, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS cohort, sid AS doc_id, label, {', '.join(f'coalesce(d{i}, 0) AS {n}' for i, n in enumerate(NETWORK["features"]))} FROM folds LEFT JOIN dd USING (sid)
UNION ALL BY NAME SELECT 'network' AS section, component, names[f1 + 1] AS f1, names[f2 + 1] AS f2, ig FROM kept, n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_pair_counters, job2_text_network)}
ORACLES = {"job1_pair_counters": JOB1_SQL, "job2_text_network": JOB2_SQL}
