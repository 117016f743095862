"""The ten corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoloom.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, line_dedup, packing, quality_rules, queries, reshard, warc
from genoloom.llm import textscan as ts

DOCS = "doc_id long, text string, lang string"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows, null ids, rows that share almost everything."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n\x0b", None), (4, "one two", "en"), (5, "one  TWO", "en"), (5, "one  TWO", "en"), (6, "12 34 !! ...", "de"), (None, "a null id has words too, six", "en"), (7, "x " * 30_000, "en"), (8, "é" * 70_000, "fr"), (9, "a\n\n\n\nb\n\n\n", "en"), (9, "other text of one id here", "en")]
    for i in range(20, 60):
        edited = list(base)
        for _ in range(rng.randrange(0, 9)):
            edited[rng.randrange(200)] = rng.choice(words) + "z"
        rows.append((i, " ".join(edited[: rng.choice([200, 200, 160, 150])]), "en"))
    rows += [(i, "\n".join(["shared line one", "shared line two", "shared line three", f"own line {i % 3}"]), "en") for i in range(60, 66)]
    return rows


CLASH = {"n_words": 1, "_runs": 2, "runs": 3, "dc_runs": 4, "kept": 5, "p_good": 6, "n_lines": 7, "_hash": 8, "_lines": 9, "node": 10, "n_hit": 11, "bucket": 12, "held_out": 13, "shingles": 14, "id": 15, "item_ids": 16, "_id": 17, "_own": 18, "_kept": 19, "_pattern": 20}


def frames(spark):
    plain = spark.createDataFrame(odd_documents(), DOCS)
    return plain, plain.withColumns({k: F.lit(v) for k, v in CLASH.items()}), spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \t\n\x00\x0b.é中😀", max_size=40)), max_size=8))
def test_words_match_a_regex(texts):
    for member, pattern in ((ts.SPACED, SPACES), (ts.ALNUM, ALNUM)):
        w = ts.Words(pa.array(texts, pa.string()), member)
        want = [pattern.findall(lower(t)) for t in texts]
        assert w.count.tolist() == list(map(len, want))
        flat = [x for ws in want for x in ws]
        by_hash = {}
        for word, h in zip(flat, w.hash.tolist(), strict=True):
            assert by_hash.setdefault(h, word) == word
        assert len(by_hash) == len(set(flat))


def test_sliced_batches_read_their_own_texts():
    batch = pa.record_batch({"text": ["aa bb", None, "cc", "dd ee ff"]})
    assert [ts.Words(p.column(0)).count.tolist() for p in ts.pieces(batch.slice(1), "text", 3)] == [[0, 1], [3]]


# ---------------------------------------------------------------- 1 chat formatting


def test_trees_are_enumerated_ranked_and_read_back(spark):
    rng = random.Random(1)
    rows, children = [], {}
    for t in (1, 2, None):
        for n in range(40):
            parent = None if n == 0 else (n - 1 if n < 20 else rng.randrange(n))
            rows.append((t, n, parent, rng.choice(["user", "assistant", "a\nb<|", None]), rng.choice(["", None, "\\s<|im_end|>\n", "hi\n<", "\\a\\"]), rng.choice([None, 1.0, 2.0])))
            children.setdefault((t, parent), []).append(n)
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    by = {(r[0], r[1]): r for r in rows}
    out = chat_format.format_trees(df)
    out = out.withColumns({"turns": chat_format.turns_of(F.col("formatted")), "learned": chat_format.learned_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    leaves = {(t, n) for t, n in by if (t, n) not in children}
    assert {(r.tree, r.leaf) for r in out} == leaves and len(out) == len(leaves)
    for r in out:
        path, n = [], r.leaf
        while n is not None:
            path.append(by[r.tree, n])
            n = by[r.tree, n][2]
        path.reverse()
        assert [tuple(x) for x in r.turns] == [(x[3] or "", x[4] or "") for x in path]
        assert r.learned == "".join(x[4] or "" for x in path if x[3] == "assistant")
        assert r.branch_score == pytest.approx(sum(x[5] or 0 for x in path) / len(path))
    best = chat_format.format_trees(df, best=1).collect()
    for r in best:
        own = [x for x in out if x.tree == r.tree]
        assert r.leaf == min(own, key=lambda x: (-x.branch_score, x.leaf)).leaf
    assert chat_format.format_trees(df.limit(0)).count() == 0


def test_circles_are_refused_or_set_aside(spark):
    """One tree with a circle, one message below it and a path of its own; another tree without."""
    rows = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 3), (1, 10, None), (1, 11, 10), *[(2, i, i - 1 if i else None) for i in range(20)], (None, 5, 5)]
    df = spark.createDataFrame([(t, n, p, "user", "x", 1.0) for t, n, p in rows], "tree long, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="5 messages"):
        chat_format.branch_nodes(df)
    assert Counter(tuple(r) for r in chat_format.circular_messages(df).collect()) == Counter([(1, 1), (1, 2), (1, 3), (1, 4), (None, 5)])
    got = chat_format.format_trees(df, circles="skip").collect()
    assert {(r.tree, r.leaf, r.n_messages) for r in got} == {(1, 11, 2), (2, 19, 20)}


def test_linear_threads_take_nulls_and_ties(spark):
    rows = [(None, 1, "user", "b"), (None, None, "user", "first"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 0, None, None)]
    out = {r.tree: r.turns for r in chat_format.format_trees(chat_format.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("turns", chat_format.turns_of(F.col("formatted"))).collect()}
    assert [t.text for t in out[None]] == ["first", "b"] and [t.text for t in out[3]] == ["", "x", "x"]


# ---------------------------------------------------------------- 2 resharding


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=3), st.randoms())
def test_flow_is_cheapest(supply, rng):
    m = rng.randrange(1, 4)
    demand = [0] * m
    for _ in range(sum(supply)):
        demand[rng.randrange(m)] += 1
    cost = [[rng.randrange(5) for _ in range(m)] for _ in supply]
    flow = reshard.min_cost_flow(supply, demand, cost)
    assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(len(supply))] == supply
    assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(m)] == demand
    units, sinks = [i for i, s in enumerate(supply) for _ in range(s)], [j for j, d in enumerate(demand) for _ in range(d)]
    if len(units) <= 6:
        best = min((sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in itertools.permutations(sinks)), default=0)
        assert sum(cost[i][j] * f for (i, j), f in flow.items()) == best


def test_unit_costs_move_only_surplus():
    flow = reshard.min_cost_flow([10, 2, 6], [6, 6, 6])
    assert sum(f for (i, j), f in flow.items() if i != j) == 4


def _placed(spark, docs, shards):
    rows = docs.select("doc_id", "text", reshard.row_size(F.col("text")).alias("size"), reshard.old_layout(docs, 3).alias("old"), F.xxhash64("text", "doc_id").alias("tie"))
    return reshard.reshard(rows, shards)


def test_shards_are_even_and_gapless(spark, sf_dir, documents):
    got = queries.op2_resharding(spark, sf_dir).collect()
    texts = {d: (t or "").encode() for d, t, _ in documents}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in got)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 2 * max(r["size"] for r in got)


def test_reshard_odd_rows_and_rewrite(spark, tmp_path):
    plain, _, none = frames(spark)
    out, transfers = _placed(spark, plain, 4)
    rows = out.collect()
    assert len(rows) == plain.count() and {r.shard for r in rows} <= set(range(4))
    assert sum(f for f in transfers.values()) == sum(r["size"] for r in rows)
    assert _placed(spark, none, 4)[0].count() == 0
    unique = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(200)], "doc_id long, text string")
    placed, _ = _placed(spark, unique, 4)
    reshard.rewrite(unique, placed, str(tmp_path / "out"), ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_touched_shards_are_rewritten_in_place(spark, tmp_path):
    """Shard 1 has its capacity already: its files stay; null and repeated ids stay rows of their own."""
    nine = lambda x: x * 9
    texts = [(0, None, nine("a")), (0, None, nine("a")), (0, None, nine("a")), (0, 7, nine("b")), (0, 7, nine("b")), (0, 7, nine("c")), (1, 8, nine("d")), (1, None, nine("d")), *[(1, 9, None)] * 10, (1, 9, nine("d")), (2, 3, nine("e")), (2, None, nine("e"))]
    rows = spark.createDataFrame(texts, "old int, doc_id long, text string")
    schema = rows.drop("old").schema
    path = str(tmp_path / "shards")
    rows.withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(path)
    files = lambda k: sorted(p.name for p in (tmp_path / "shards" / f"shard={k}").glob("*.parquet"))
    before = {k: files(k) for k in range(3)}
    transfers = reshard.reshard_files(spark, path, schema, 3)
    assert {k for k in transfers if k[0] != k[1]} == {(0, 2)}
    assert files(1) == before[1] and not set(files(0)) & set(before[0]) and not set(files(2)) & set(before[2])
    assert {p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()} == {"shard=0", "shard=1", "shard=2"}
    got = reshard.read_shards(spark, path, schema).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in rows.collect())
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        assert abs(sum(len(r.text or "") + 1 for r in got if r.shard == k) - 40) < 10


def test_resharding_keeps_clashing_columns(spark, tmp_path):
    names = ["_base", "_offset", "_cuts", "_rank", "_spread", "_bucket", "_at", "_file", "_row", "_doc", "~", "shard", "slot", "old", "size", "tie"]
    rows = spark.createDataFrame([(i % 3, i // 2, "t" * (i % 40)) for i in range(120)], "k int, doc_id long, text string")
    more = rows.drop("k").withColumns({c: F.lit(f"user {c}") for c in names})
    path = str(tmp_path / "shards")
    reshard.write_shards(more, F.pmod("doc_id", F.lit(2)).cast("int"), path)
    reshard.reshard_files(spark, path, more.schema, 3)
    got = reshard.read_shards(spark, path, more.schema).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in rows.collect())
    assert {r.shard for r in got} == {0, 1, 2} and all(r[c] == f"user {c}" for r in got for c in names if c not in ("shard", "slot"))
    stored = spark.read.parquet(path).first()
    assert stored["~shard"] == "user shard" and stored["~slot"] == "user slot"
    given = rows.withColumnRenamed("k", "old").withColumns({"size": F.length("text") + 1, "tie": F.xxhash64("text")}).withColumns({c: F.lit(f"user {c}") for c in names if c not in ("old", "size", "tie")})
    out = reshard.reshard(given, 2)[0].collect()
    assert len(out) == 120 and {r.shard for r in out} == {0, 1} and all(r[c] == f"user {c}" for r in out for c in names[:11])


def test_spread_of_buckets_changes_no_law(spark, monkeypatch):
    monkeypatch.setattr(reshard, "BUCKET", 3)
    rows = spark.createDataFrame([(i % 2, 1 + i % 7, i * 7919) for i in range(300)], "old int, size long, tie long")
    got = reshard.reshard(rows, 4)[0].collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(got) == 300 and max(sizes.values()) - min(sizes.values()) < 14


def test_rewrite_leaves_other_shards_and_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(0, None, "x"), (0, None, "x"), (0, 1, "y"), (1, 1, "z")], "old int, doc_id long, text string")
    path = str(tmp_path / "out")
    spark.createDataFrame([(2, 50, "kept", 0)], "shard int, doc_id long, text string, slot long").write.partitionBy("shard").parquet(path)
    placed = spark.createDataFrame([(0, None, "x", 0, 0), (0, None, "x", 1, 0), (0, 1, "y", 0, 1), (1, 1, "z", 1, 1)], "old int, doc_id long, text string, shard int, slot long")
    reshard.rewrite(docs.drop("old"), placed, path, ["doc_id"])
    got = sorted((r.shard, r.slot, r.doc_id or 0, r.text) for r in spark.read.parquet(path).collect())
    assert got == [(0, 0, 0, "x"), (0, 1, 1, "y"), (1, 0, 0, "x"), (1, 1, 1, "z"), (2, 0, 50, "kept")]
    # Columns that the placement lacks come from the documents.
    reshard.rewrite(docs.drop("old"), placed.drop("text").where("doc_id IS NOT NULL"), path, ["doc_id"])
    got = sorted((r.shard, r.slot, r.doc_id or 0, r.text) for r in spark.read.parquet(path).collect())
    assert (1, 1, 1, "z") in got and (2, 0, 50, "kept") in got


def layout(spark, path, seed=0, shards=4, rows=400):
    """Uneven shards of rows of many sizes, some of them equal; (schema, rows)."""
    pick = random.Random(seed)
    given = [(pick.choice((0, 0, 0, *range(shards))), pick.choice((None, i)), pick.choice((None, "same", "t" * pick.randrange(300)))) for i in range(rows)]
    df = spark.createDataFrame(given, "shard int, doc_id long, text string")
    df.repartition(3).write.partitionBy("shard").parquet(path)
    return df.drop("shard").schema, given


def moved_bytes(given, got):
    """The least bytes that can leave their shard, by the sizes before and after."""
    before, after = Counter(), Counter()
    for k, _, t in given:
        before[k] += len(t or "") + 1
    for r in got:
        after[r.shard] += len(r.text or "") + 1
    return sum(max(0, before[k] - after[k]) for k in before | after), after


@pytest.mark.parametrize(("new", "bucket"), [(4, 1_000_000), (6, 20), (2, 3)])
def test_layouts_move_the_fewest_bytes(spark, tmp_path, monkeypatch, new, bucket):
    monkeypatch.setattr(reshard, "BUCKET", bucket)
    path = str(tmp_path / "shards")
    schema, given = layout(spark, path, seed=new)
    transfers = reshard.reshard_files(spark, path, schema, new)
    got = reshard.read_shards(spark, path, schema).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for _, d, t in given)
    sizes = Counter()
    for k, _, t in given:
        sizes[k] += len(t or "") + 1
    want = reshard.capacities(sum(sizes.values()), new)
    assert sum(f for (i, j), f in transfers.items() if i != j) == sum(max(0, sizes[i] - (want[i] if i < new else 0)) for i in sizes)
    _, after = moved_bytes(given, got)
    assert set(after) == set(range(new)) and all(abs(after[j] - want[j]) < 300 * 4 for j in after)
    for k in range(new):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    # Rows move only where the flow says: a shard that gains nothing has rows of its own alone.
    mine = Counter((k, d, t) for k, d, t in given)
    for k in {i for i, j in transfers if i != j} - {j for i, j in transfers if i != j}:
        assert not Counter((r.shard, r.doc_id, r.text) for r in got if r.shard == k) - mine
    again = reshard.reshard_files(spark, path, schema, new)
    assert sum(f for (i, j), f in again.items() if i != j) <= 300 * 4 * new


def test_lost_driver_between_renames(spark, tmp_path, monkeypatch):
    """A reader finishes a change whose driver was lost after some renames; half-written folders are ignored."""
    path = tmp_path / "shards"
    schema, given = layout(spark, str(path), seed=9)
    with monkeypatch.context() as m:
        m.setattr(reshard, "_finish", lambda *_: None)
        reshard.reshard_files(spark, str(path), schema, 2)
    ready = next(path.glob("_ready-*"))
    assert {p.name for p in (ready / "_empty").iterdir()} == {"shard=2", "shard=3"}
    shutil.rmtree(path / "shard=0")
    (ready / "shard=0").rename(path / "shard=0")
    shutil.rmtree(path / "shard=1")
    shutil.copytree(path / "shard=0", path / "_new-half" / "shard=0")
    got = reshard.read_shards(spark, str(path), schema).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for _, d, t in given)
    assert {r.shard for r in got} == {0, 1} and not list(path.glob("_ready-*"))
    reshard.reshard_files(spark, str(path), schema, 3)
    assert not list(path.glob("_new-*"))
    assert Counter((r.doc_id, r.text) for r in reshard.read_shards(spark, str(path), schema).collect()) == Counter((d, t) for _, d, t in given)


# ---------------------------------------------------------------- 3 Jaccard join


def shingle_set(text):
    w = SPACES.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def components(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, len(sets[i]), ids.get(root(i))) for i, (d, *_) in enumerate(rows)), key=repr)


def test_jaccard_matches_all_pairs(spark, documents):
    plain, clash, none = frames(spark)
    rows = odd_documents() + documents
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components(rows)
    assert sorted((tuple(r) for r in jaccard_join.jaccard_components(clash).collect()), key=repr) == components(odd_documents())
    assert jaccard_join.jaccard_components(none).count() == 0


def test_blocks_and_salts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "STAR", 3)
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    got = jaccard_join.jaccard_components(frames(spark)[0])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components(odd_documents())


def chained_documents(n=60):
    """Each text is near the next ones only, so one star can't link them: trees of blocks have to."""
    words = [f"c{i}" for i in range(200 + 6 * n)]
    return [(i, " ".join(words[6 * i : 6 * i + 200]), "en") for i in range(n)]


@pytest.mark.parametrize("block", [512, 7])
def test_links_come_out_of_trees(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = chained_documents() + odd_documents()
    df = spark.createDataFrame(rows, DOCS)
    trees = spark.sparkContext.accumulator(0)
    got = jaccard_join.jaccard_components(df, candidates=trees)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components(rows) and trees.value >= 60
    # The trees of blocks add links that stars don't have.
    sets = jaccard_join.stage(jaccard_join.shingle_table(df), "sets")
    family = jaccard_join.stage(jaccard_join.families(jaccard_join.shared_buckets(jaccard_join.routed(sets, jaccard_join.rarity_sketch(sets), 75)), 75), "family")
    stars = jaccard_join.connected_components(jaccard_join.star_links(family, sets, 75))
    crossing = spark.sparkContext.accumulator(0)
    pairs = jaccard_join.crossing_links(family, stars, sets, 75, crossing)
    assert pairs.count() > 0 and crossing.value >= pairs.count()


def test_sets_with_one_hash_are_told_apart(spark):
    rows = [(1, 3, 77, 1), (2, 3, 77, 2), (3, 3, 77, 1), (4, 3, 78, 5), (5, 0, 9, 9), (6, 0, 9, 8)]
    got = {r.doc_id: r.node for r in jaccard_join.told_apart(spark.createDataFrame(rows, "doc_id long, n_shingles long, node long, other long")).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 78


def test_trees_have_levels_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.poisson(2.0, (8, jaccard_join.GROUPS))
    points = np.repeat(centres, 60, axis=0) + (rng.random((480, jaccard_join.GROUPS)) < 0.01)
    tree = jaccard_join.CountRTree(points)
    assert [len(x[0]) for x in tree.levels] == [30, 4, 1]
    a, b = tree.join(tree, 75)
    size = points.sum(axis=1)
    both = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(both >= jaccard_join.needed(size[:, None], size[None], 75)), strict=True)}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(want) < 480 * 480 / 4
    assert [len(x) for x in jaccard_join.CountRTree(points[:0]).join(tree, 75)] == [0, 0]


def test_tree_join_drops_no_pair():
    rng = np.random.default_rng(0)
    points = rng.poisson(1.0, (120, 32))
    points[60:] = np.maximum(points[:60] + rng.integers(-1, 2, (60, 32)) * (rng.random((60, 32)) < 0.1), 0)
    size = points.sum(axis=1)
    a, b = jaccard_join.CountRTree(points[:70]).join(jaccard_join.CountRTree(points[70:]), 75)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(70):
        for j in range(50):
            bound = np.minimum(points[i], points[70 + j]).sum() >= jaccard_join.needed(int(size[i]), int(size[70 + j]), 75)
            assert not bound or (i, j) in got
            near = 100 * min(size[i], size[70 + j]) >= 75 * max(size[i], size[70 + j])
            assert (i, j) not in got or bound or not near


# ---------------------------------------------------------------- 4 quality rules


def base_counts(text):
    text = text or ""
    w = SPACES.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, again = set(), 0
    for x in text.split("\n"):
        if SPACES.search(x):
            again += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_quality_counts_and_verdicts(spark, documents, sf_dir):
    rows = odd_documents() + documents
    got = quality_rules.quality(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    assert len(got) == len(rows)
    for r, (_, text, _) in zip(sorted(((r.doc_id, r.text, r) for r in got), key=key), sorted(rows, key=key), strict=True):
        r, want = r[2], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    alone = quality_rules.quality(spark.createDataFrame(documents, DOCS)).collect()
    judged = {r.doc_id: r for r in alone if r.doc_id in labels and not r.base_failed}
    assert np.mean([r.kept == bool(labels[d]) for d, r in judged.items()]) > 0.95


def test_quality_takes_clashing_columns_and_no_rows(spark):
    _, clash, none = frames(spark)
    got = quality_rules.quality(clash)
    assert got.count() == len(odd_documents())
    # A user's columns stay, but for those that the operator gives.
    assert {k: v for k, v in got.first().asDict().items() if k in CLASH and k not in (*quality_rules.COUNTS, "kept", "p_good")} == {k: v for k, v in CLASH.items() if k not in (*quality_rules.COUNTS, "kept", "p_good")}
    assert quality_rules.quality(none).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, 0, np.where(rng.random(len(y)) < np.where(y, g, b), np.where(y, 1, -1), np.where(y, -1, 1))) for g, b in ((0.95, 0.7), (0.9, 0.8), (0.97, 0.6), (0.9, 0.7))], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.LabelModel(patterns, counts.astype(float))
    assert m.prior == pytest.approx(0.8, abs=0.03) and m.right_good == pytest.approx([0.95, 0.9, 0.97, 0.9], abs=0.03)
    assert m.right_bad == pytest.approx([0.7, 0.8, 0.6, 0.7], abs=0.06)


# ---------------------------------------------------------------- 5 line dedup


def left_lines(rows):
    """[(text, n_lines, n_removed)] of (id, text) rows in their order, by a set of windows seen."""
    seen, out = set(), []
    for _, t, *_ in rows:
        if t is None:
            out.append((None, None, None))
            continue
        x, gone = t.split("\n"), set()
        for i in range(max(len(x) - 2, 1) if t else 0):
            w = tuple(x[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2} & set(range(len(x)))
            seen.add(w)
        out.append(("\n".join(v for i, v in enumerate(x) if i not in gone), len(x), len(gone)))
    return out


def test_lines_match_brute_force(spark, monkeypatch):
    from genoloom.operators import hot

    rows = [(i, t, "en") for i, t in enumerate(["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", "", None, "l\nl\nl\nl\nl", "a\nb\nc\nd", "b\nc\nd\ne\n", "p\na\nb\nc\nd\nq", "a\nb", "one line", "", "one line", "a", "a\n", "a\n", "one line\na\nb"])]
    want = {d: x for (d, *_), x in zip(rows, left_lines(rows), strict=True)}
    for top in (50_000, 2):
        monkeypatch.setattr(hot, "HOT", top)
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == want


def test_lines_of_odd_rows(spark):
    plain, clash, none = frames(spark)
    a = sorted((tuple(r) for r in line_dedup.dedup_lines(plain).select("doc_id", "text", "n_removed").collect()), key=repr)
    b = sorted((tuple(r) for r in line_dedup.dedup_lines(clash).select("doc_id", "text", "n_removed").collect()), key=repr)
    assert a == b and len(a) == len(odd_documents())
    assert sum(r[2] or 0 for r in a) >= 15
    assert line_dedup.dedup_lines(none).count() == 0


# ---------------------------------------------------------------- 6 packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plans_place_every_length_once(histogram):
    packed = packing.plan(histogram, 64)
    placed = Counter()
    for lengths, n in packed:
        assert sum(lengths) <= 64
        placed.update({k: n * c for k, c in Counter(lengths).items()})
    assert placed == Counter(histogram)
    tokens = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in packed) <= max(2 * tokens / 64 + 1, 1)


def test_nnls_solves_a_system():
    lengths = np.array([10, 22, 32, 54])
    combos = np.array([[54, 10, 0], [32, 32, 0], [22, 22, 10]])
    counts = np.array([8.0, 6.0, 10.0, 5.0])  # 5, 5 and 3 repeats
    assert packing.solve_nnls(combos, lengths, counts, 3000) == pytest.approx([5, 5, 3], abs=1e-3)


@pytest.mark.parametrize("numbers", [300_000, 3])
def test_pieces_round_trip(spark, documents, monkeypatch, numbers):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "NUMBERS", numbers)
    full = Tokenizer.from_file(queries.vocabulary(queries.VOCABULARY))
    rows = odd_documents() + documents[:120] + [(900, "<|endoftext|> 中文 Ωμέγα ́x 𝒳 ʼn\u00a0\u2003 don't  \n\n 12ⅷ", None), (901, "x <|endoftext|> y", None), (902, "<|endoftext|><|endoftext", None)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), queries.vocabulary(queries.VOCABULARY), queries.vocabulary(queries.RANKS)).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[d, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and set(ends) == set(range(len(ends)))
    assert sum(ends.values()) / (2048 * len(ends)) > 0.95


def test_packing_without_rows(spark):
    assert packing.pack(frames(spark)[2], queries.vocabulary(queries.VOCABULARY)).count() == 0


def test_sequences_hold_the_ids_and_their_padding(spark, documents):
    names = [queries.vocabulary(queries.VOCABULARY), queries.vocabulary(queries.RANKS)]
    rows = [(1, None, "en"), (None, "a b", "en"), (2, "x y", "en"), (2, "x y", "en"), *documents[:60]]
    packed = packing.pack(spark.createDataFrame(rows, DOCS), *names, with_ids=True)
    found = packing.sequences(packed)
    encoder, want, got = packing.Encoder(*names), Counter(), Counter()
    for d, t, _ in rows:
        ids = [*encoder.encode(t or ""), 1]
        want.update((d, at, tuple(ids[at : at + 2048])) for at in range(0, len(ids), 2048))
    for r in found.collect():
        end = 0
        for p in r.pieces:
            assert p.offset == end
            end += p.length
            got[p.doc_id, p.start, tuple(np.frombuffer(r.ids, packing.ID_TYPE)[p.offset : end].tolist())] += 1
        assert len(r.ids) == 2048 * packing.ID_BYTES and not any(r.ids[end * packing.ID_BYTES :])
    assert got == want
    crcs = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.digests(found).collect())
    assert crcs == Counter({}) + sum((Counter({(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())): n}) for (d, s, i), n in want.items()), Counter())


# ---------------------------------------------------------------- 7 WARC


def odd_pages(spark):
    rows = [(1, "http://a/é?x=\r\n%41", "x" * 200), (2, None, "x" * 200), (None, "http://b/", "x" * 200), (3, "", None), (4, "u", ""), (5, "u", "y" * 99), (6, "u", "y" * 99), (7, "u", "é" * 60), (8, "u", "é" * 60), (7, "u", "é" * 60), (9, "u", "WARC/1.1\r\n\r\n" * 30)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    rows, df = odd_pages(spark)
    path = warc.new_path(spark, "test")
    index = warc.write_bundles(df.withColumn("payload", F.lit(1)), path)
    got = warc.read_bundles(index, with_html=True).collect()
    want = Counter()
    for i, u, h in rows:
        b = (h or "").encode()
        least = min((j for j, _, x in rows if x == h and j is not None), default=None)
        again = len(b) >= 100 and i != least
        want[i, u, None if again else h or "", len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least if again else None] += 1
    assert Counter(tuple(r) for r in got) == want
    ids = [r.record_id for r in index.collect()]
    assert len(ids) == len(set(ids)) == len(rows)
    both = warc.fetch(index, ["<urn:page:7>"])
    assert len(both) == 2 and all(x["page_id"] == 7 and x["payload"] == ("é" * 60).encode() for x in both.values())
    found = warc.fetch(index, ["<urn:page:9>", "<urn:page:2>"])
    assert found["<urn:page:9>"]["payload"] == rows[-1][2].encode() and found["<urn:page:2>"]["refers_to"] == 1
    assert warc.archive(df.limit(0)).count() == 0


def test_bundles_seek_to_frames(tmp_path):
    w = warc.BundleWriter(pa.OSFile(str(tmp_path / "b"), "wb"), frame=300)
    places = [w.add(warc.record(i, "u", b"z" * i, i, "d", None)) for i in range(9)]
    w.close()
    r = warc.BundleReader(pa.OSFile(str(tmp_path / "b")))
    for i, (frame, offset) in enumerate(places):
        assert warc.fields(*warc.parse(r.read(frame), offset)[:2])["size"] == i
    import zstandard

    with open(tmp_path / "b", "rb") as f:  # any reader of the format gets all records
        data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert data.count(b"WARC/1.1") == 9


# ---------------------------------------------------------------- 8 language identification


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.ByteCNN(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["embed"][0] = 0
    x, y = rng.integers(1, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = net.step(x, y)
    for k in ("dense", "conv2", "conv6", "bias4"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-6
        up = net.step(x, y)[0]
        net.p[k][at] -= 2e-6
        down = net.step(x, y)[0]
        net.p[k][at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[k][at], rel=1e-3)


def test_folded_tables_are_the_network():
    rng = np.random.default_rng(1)
    net = language_id.ByteCNN(4)
    x = rng.integers(0, 256, (7, language_id.WINDOW)).astype(np.uint8)
    q = language_id.probabilities(net.p, language_id.folded(net.p), x, chunk=3)
    losses = [net.step(x, np.full(7, c))[0] for c in range(4)]
    assert [-np.log(q[:, c]).mean() for c in range(4)] == pytest.approx(losses, rel=1e-4)


def test_languages_are_told_apart(spark, documents):
    rows = documents + [(d if d is None else d + 100_000, t, None) for d, t, _ in odd_documents()]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    langs = {d: lang for d, _, lang in documents}
    held = [r for r in got if r.held_out and langs.get(r.doc_id)]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    letters = spark.createDataFrame([(1, None, "en"), (2, "12 34 !!", "en"), (3, "hello there", "en"), (5, "hallo", "de")], DOCS)
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(letters).collect()}
    assert odd[1] == odd[2] == "und" and odd[3] in ("en", "de")
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame([(3, "hello", None)], DOCS)).collect()} == {"und"}
    assert language_id.identify(frames(spark)[2]).count() == 0
    assert language_id.identify(frames(spark)[1]).count() == len(odd_documents())


def test_samples_are_of_every_language_and_bounded(spark):
    """Rare languages are learnt, copies count once, the driver gets windows and no texts."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "to", "in"]) for _ in range(20_000 if i == 5 else 30)), "en") for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(["der", "und", "von", "zu"]) for _ in range(30)), "de") for i in range(6)] + [(2000 + i, rows[0][1], "en") for i in range(300)]
    rows += [(3000, "x", None), (3001, None, "fr"), (3002, "...", "und2")]
    found = language_id.sample(spark.createDataFrame(rows, DOCS), 100)
    langs = Counter(lang for lang, _ in found)
    assert langs["de"] >= 5 and 25 <= langs["en"] <= 33 and sum(langs.values()) <= 100 and "fr" not in langs
    assert max(len(w) for _, w in found) <= (language_id.WINDOWS_EACH + 1) * language_id.WINDOW
    known, net = language_id.train(found, steps=20)
    assert known == ["de", "en"] and net is not None


# ---------------------------------------------------------------- 9 HTML extraction


def test_articles_are_whole(spark, sf_dir):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op9_html_extract(spark, sf_dir).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_structure():
    page = """<!doctype html><html><head><title>T</title><meta x><script>if (a<b) "</p>"</script><body><header>top</header><div class="cookie-notice">ok?</div>
    <div id=main-content><article><header><h1>Title &amp; &eacute;</h1></header><p>One<br>two <i>three</i><p>four &lt;p&gt;<!-- no --><nav>menu</nav><aside>side</aside><form>f</form>
    <ul><li>item<li>next</ul><div class="user comments"><p>reader</div><pre>a
    b</pre></article></div><div class='sidebar'>x</div><footer>&copy;</footer>"""
    assert [t for inside, t in html_extract.blocks(page) if inside] == ["Title & é", "One two three", "four <p>", "item", "next", "a b"]
    assert html_extract.blocks("") == [] and html_extract.blocks("plain") == [(False, "plain")]
    assert html_extract.blocks("<p>a<p class='x") == [(False, "a")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=5), st.integers(1, 6), st.integers(1, 3))
def test_suffix_array_sorts_and_groups(streams, depth, least):
    tokens = []
    for s in streams:
        tokens += [*s, -1 - len(tokens)]
    tokens = np.array(tokens)
    starts, family = html_extract.suffix_array(tokens, depth, least)
    fits = [i for i in range(len(tokens)) if i + depth <= len(tokens) and min(tokens[i : i + depth]) >= 0]
    count = Counter(tuple(tokens[i : i + depth].tolist()) for i in fits)
    keys = [tuple(tokens[i : i + depth].tolist()) for i in starts]
    assert sorted(starts.tolist()) == [i for i in fits if count[tuple(tokens[i : i + depth].tolist())] >= least]
    assert keys == sorted(keys)
    assert family.tolist() == [sorted(set(keys)).index(k) for k in keys]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 3))
def test_runs_count_pages(texts, least):
    texts = [" ".join(t.split()) for t in texts]
    words = ts.Words(pa.array(texts), lower=False)
    runs = html_extract.Runs(words, least)
    where = {}
    for k, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - html_extract.RUN + 1):
            where.setdefault(tuple(w[j : j + html_extract.RUN]), set()).add((k, j))
    flat = [w for t in texts for w in t.split()]
    got = {}
    for at, f in zip(runs.starts.tolist(), runs.family.tolist(), strict=True):
        got.setdefault(f, set()).add(at)
    want = {tuple(sorted(int(words.first[k]) + j for k, j in v)): len({k for k, _ in v}) for v in where.values() if len({k for k, _ in v}) >= least}
    assert {tuple(sorted(v)): int(runs.pages[f]) for f, v in got.items()} == want and len(flat) == len(words.hash)


def test_repeated_blocks_of_a_host_go(spark, monkeypatch):
    boiler = "this text stands on every page of the host"
    rows = [(i, f"http://h/{i}", f"<div>{boiler}</div><div>own words of page {i} are number {i * 7} and stay</div>") for i in range(6)]
    rows += [(10, "http://other/1", f"<div>{boiler}</div>"), (11, None, None), (12, "", ""), (0, "http://h/0", rows[0][2])]
    for group in (500, 1):
        monkeypatch.setattr(html_extract, "GROUP", group)
        got = Counter((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("blocks", F.lit(1))).collect())
        want = Counter((i, f"own words of page {i} are number {i * 7} and stay") for i in [*range(6), 0])
        assert got == want + Counter({(10, boiler): 1, (11, ""): 1, (12, ""): 1})
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PAGES = "page_id long, url string, html string"


def plain_page(*blocks):
    return "".join(f"<div>{b}</div>" for b in blocks)


def test_menus_of_short_items_go(spark, monkeypatch, tmp_path):
    menu = "<ul>" + "".join(f"<li>{x}</li>" for x in ("Home", "News", "Our team", "Sport", "Contact us", "Read more")) + "</ul>"
    own = [f"page {i} tells of number {i * 7} and has words {i}a {i}b {i}c of its own" for i in range(6)]
    rows = [(i, f"http://h/{i}", menu + plain_page(own[i])) for i in range(6)] + [(9, "http://other/1", menu)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    for group in (500, 1):
        monkeypatch.setattr(html_extract, "GROUP", group)
        got = {r.page_id: r.text for r in queries.op9_html_extract(spark, str(tmp_path)).collect()}
        assert got == dict(enumerate(own)) | {9: "Home\nNews\nOur team\nSport\nContact us\nRead more"}


def test_copies_under_two_urls_and_quoting_blocks_keep_their_words(spark, tmp_path):
    quote, text = "these are ten words that two pages of it quote", "a whole text that stands under two addresses of the host"
    rows = [(1, "http://h/1", plain_page(text)), (2, "http://h/1?page=2", plain_page(text)), (3, "http://h/3", plain_page(f"first says {quote}")), (4, "http://h/4", plain_page(f"{quote} so it goes on"))]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.text for r in queries.op9_html_extract(spark, str(tmp_path)).collect()}
    assert got == {1: text, 2: text, 3: "first says", 4: "so it goes on"}


def left_of_pages(rows):
    """page_id -> text, by the rules of html_extract on sets of runs, without arrays or groups."""
    n, parsed, hosts = html_extract.RUN, [], {}
    for i, url, page in rows:
        found = html_extract.blocks(page or "")
        marked = any(x for x, _ in found)
        text = "\n".join(t for x, t in found if x or not marked)
        host = re.sub(r"^\w+://([^/]*).*", r"\1", url or "")
        parsed.append((i, host, marked, text))
        if text:
            hosts.setdefault(host, set()).add((marked, text))
    where = {}
    for host, pages in hosts.items():
        for page in pages:
            w = page[1].split()
            for j in range(len(w) - n + 1):
                where.setdefault((host, *w[j : j + n]), set()).add(page)
    want = Counter()
    for i, host, marked, text in parsed:
        w = [(k, x) for k, line in enumerate(text.split("\n")) for x in line.split()]
        hits = {}
        for rule in (html_extract.LOOSE, html_extract.STRICT):
            hit, inside = set(), set()
            for j in range(len(w) - n + 1):
                if len(where[(host, *[x for _, x in w[j : j + n]])]) >= max(rule[0], rule[1] * len(hosts[host])):
                    hit.update(range(j, j + n))
                    inside.update(range(j, j + n) if w[j][0] == w[j + n - 1][0] else ())
            hits[rule] = hit, inside
        copy = len(w) >= html_extract.COPY_TOKENS and len(hits[html_extract.LOOSE][0]) >= html_extract.COPY * len(w)
        hit, inside = hits[html_extract.STRICT if marked or copy else html_extract.LOOSE]
        if marked and len(hit) > html_extract.ARTICLE_COPY * len(w):
            hit, inside = set(), set()
        kept = []
        for k in range(text.count("\n") + 1):
            at = [j for j, (x, _) in enumerate(w) if x == k]
            kept += [] if hit.issuperset(at) else [" ".join(w[j][1] for j in at if j not in inside)]
        want[i, "\n".join(kept)] += 1
    return want


def random_pages(seed, n):
    """Pages of two hosts: random words, shared sentences, marked articles or none, copies, odd rows."""
    rng = random.Random(seed)
    shared = [" ".join(f"s{k}w{j}" for j in range(rng.randint(5, 14))) for k in range(5)]
    rows = []
    for i in range(n):
        own = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        for k, x in enumerate(shared):
            if rng.random() < (0.8, 0.55, 0.4, 0.1, 0.05)[k]:
                own.insert(rng.randint(0, len(own)), x if rng.random() < 0.7 else f"{own[0]} {x} {own[-1]}")
        page = plain_page(*own)
        rows.append((i, f"http://h{i % 2}/{i}", f"<article>{page}</article>" if i % 4 < 3 and i % 2 else page))
    rows += [(1000 + i, f"http://h1/copy{i}", rows[3][2]) for i in range(5)]
    long = " ".join(f"t{j}" for j in range(90))
    rows += [(2000 + i, f"http://h{j}/near{i}", f"{'<article>' if j == 3 else ''}<p>{long} edit{i}</p>") for j in (2, 3) for i in range(6)]
    return rows + [(3000, None, None), (3001, "", ""), (None, "odd", "<p>one"), (None, "http://h0/", "<p>" + shared[0])]


def test_unique_runs_match_brute_force(spark, monkeypatch):
    for seed, n in ((1, 24), (2, 90)):
        rows = random_pages(seed, n)
        want = left_of_pages(rows)
        for group, chars in ((500, 8 << 20), (7, 8 << 20), (500, 900)):
            monkeypatch.setattr(html_extract, "GROUP", group)
            monkeypatch.setattr(html_extract, "GROUP_CHARS", chars)
            got = html_extract.extract(spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit(1), "page": F.lit(2), "gram": F.lit(3), "new_text": F.lit(4), "host": F.lit(5)}))
            assert Counter((r.page_id, r.text) for r in got.collect()) == want


def test_changes_without_a_broadcast_are_the_same(spark, monkeypatch):
    rows = random_pages(3, 30)
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(html_extract, "GROUP", 5)
    assert Counter((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()) == left_of_pages(rows)


def test_every_page_goes_through_the_array(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scanned = spark.sparkContext.accumulator(0)
    html_extract.extract(pages, scanned=scanned).collect()
    texts = {(re.sub(r"^\w+://([^/]*).*", r"\1", r.url or "").lower(), tuple(html_extract.blocks(r.html or ""))) for r in pages.collect()}
    assert scanned.value == len({x for x in texts if x[1]})


def test_boilerplate_inside_articles_goes(spark):
    """A call to subscribe in every article of a host goes; what two articles quote, and copies, stay."""
    call, quote = "subscribe now and never miss a story of ours", "these are ten words that two articles of it quote"
    own = [f"<p>article {i} tells of number {i * 7} and has words {i}a {i}b {i}c of its own</p>" + (f"<p>{quote}</p>" if i < 2 else "") for i in range(6)]
    rows = [(i, f"http://h/{i}", f"<main>{own[i]}<div>{call}</div></main>") for i in range(6)]
    rows += [(10 + i, f"http://copies/{i}", f"<main>{own[0]} <p>version {i}</p></main>") for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    lines = lambda x: "\n".join(re.findall(r"<p>(.*?)</p>", x))
    assert got == {i: lines(own[i]) for i in range(6)} | {10 + i: f"{lines(own[0])}\nversion {i}" for i in range(5)}


def test_markup_of_the_contract():
    text = lambda page: [t for _, t in html_extract.blocks(page)]
    inside = lambda page: [t for x, t in html_extract.blocks(page) if x]
    assert inside("<article>own</article><article class='comment'>reader</article><article class='related'>r</article><article class=ad>a</article>") == ["own"]
    assert inside("<article><p>own</p><article class='user-comment'>reader</article></article>") == ["own"]
    assert text('<p title="x>Hello</p><p class="y">there</p>') == ["Hello", "there"]
    assert text('<p title="a > b">one</p><p title="<b>">two</p><p don\'t>three</p>') == ["one", "two", "three"]
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["if x=2 holds"]
    assert text("<section class='related work'>earlier studies</section><div id='share-price'>12 points</div>") == ["earlier studies", "12 points"]
    assert text("<div class=adslot>a</div><div id=comments2>c</div><div class='site-notice'>n</div><div class='related-posts'>r</div><div id=site-header>h</div><ul class='share-buttons'><li>s</ul>ok") == ["ok"]
    assert inside("<h1>Title</h1><p>teaser</p><article><p>body</p></article>") == ["Title", "body"]
    assert inside("<h1>Site</h1><article><h1>Title</h1><p>body</p></article>") == ["Title", "body"]
    assert text("<div class='content has-sidebar'>article</div>") == ["article"]


# ---------------------------------------------------------------- 10 decontamination


def contaminated(rows, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    out = Counter()
    for d, t, *_ in rows:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found |= windows[tuple(w[j : j + n])]
                    hit.update(range(j, j + n))
        out[d, len(w), len(hit), len(found), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("block", [16 << 20, 600])
def test_contamination_matches_brute_force(spark, sf_dir, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", block)
    items = [(1, "shared line one shared line two shared line three own line 1"), (2, "Two"), (3, None), (None, "own LINE"), (5, "..."), (5, "null id has words"), (6, "w1 w2 w3 x x x x x x x x x x x x")]
    if block > 600:
        items += [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = odd_documents() + documents[: 200 if block > 600 else 20]
    df = spark.createDataFrame(rows, DOCS)
    for docs in (df, df.withColumns({k: F.lit(v) for k, v in CLASH.items()})):
        got = decontaminate.hits(decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids)) for r in got.collect()) == contaminated(rows, items)


def test_equal_words_cost_no_more_than_others(spark):
    """Windows are kept by content: an item and a text of thousands of equal words meet once a place."""
    import tracemalloc

    items = [(1, "la " * 2000), (2, "la " * 1000 + "end"), (3, "la la la"), (4, "no " * 40)]
    rows = [(1, "la " * 5000, "en"), (2, "x " + "la " * 12 + "end y", "en"), (3, "la la", "en"), (4, "la " * 3, "en")]
    got = decontaminate.hits(decontaminate.find_contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids)) for r in got) == contaminated(rows, items)
    index = decontaminate.WindowIndex([str(i) for i, _ in items], [t for _, t in items], 10)
    index.choose({s: np.ones(len(k), np.int64) for s, k in index.known().items()})
    assert len(index.start) == 4  # ten la, nine with the end, three la, ten no
    batch = pa.record_batch({"text": ["la " * 300_000]})
    tracemalloc.start()
    out = decontaminate._marked(batch, ts.Words(batch.column(0), ts.ALNUM), [vars(index)])
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert out.column("dc_runs").to_pylist() == [[0, 300_000]] and out.column("dc_items").to_pylist() == [["1", "2", "3"]]


def test_contamination_of_nothing(spark):
    plain, _, none = frames(spark)
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.hits(decontaminate.find_contamination(none, items)).count() == 0
    assert decontaminate.hits(decontaminate.find_contamination(plain, items.limit(0))).where("contaminated").count() == 0


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(name, spark, sf_dir, duck):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])
