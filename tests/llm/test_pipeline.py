"""The pipeline against brute force, stage by stage, each on what its predecessor really kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import base_counts, components, contaminated, left_lines
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from genoloom.llm import packing, queries


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """The tables that the stages read and write."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, step) in enumerate(pipeline.STAGES):
        tables.append(docs)
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*tables, docs]


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(kept):
    for df in kept[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [df.count() for df in kept[:-1]] == sorted((df.count() for df in kept[:-1]), reverse=True)


def test_quality_stage(kept, spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = dict(rows(kept[0])), dict(rows(kept[1]))
    assert all(before[d] == t for d, t in after.items())
    fails = {d for d, t in before.items() if (c := base_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not fails & set(after)
    judged = [d for d in before if d in labels and d not in fails]
    assert sum((d in after) == bool(labels[d]) for d in judged) >= 0.95 * len(judged)


def test_line_stage(kept):
    before = sorted(rows(kept[1]))
    want = {d: left for (d, _), (left, _, gone) in zip(before, left_lines(before), strict=True) if left or not gone}
    assert dict(rows(kept[2])) == want


def test_near_copy_stage(kept):
    before = rows(kept[2])
    want = {d for d, _, c in components(before) if d == c}
    assert sorted(rows(kept[3])) == sorted(r for r in before if r[0] in want)


def test_benchmark_stage(kept, spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for (d, _, n, _, _), _ in contaminated(rows(kept[3]), items).items() if n}
    assert sorted(rows(kept[4])) == sorted(r for r in rows(kept[3]) if r[0] not in hit)
    assert hit


def test_packing_stage_and_run(kept, spark, sf_dir):
    pieces = kept[5].collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in rows(kept[4])}
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    by_doc = Counter()
    for r in pieces:
        by_doc[r.doc_id, r.doc_tokens] += r.length
    assert all(n == tokens for (_, tokens), n in by_doc.items())
    assert sorted(pipeline.run(spark, sf_dir).collect()) == sorted(pieces)


def test_pieces_carry_their_sequences(kept):
    """The rows of the last stage are whole sequences: their ids decode to the texts they were made of."""
    vocabulary = Tokenizer.from_file(queries.vocabulary(queries.VOCABULARY))
    by_sequence, by_doc = {}, {}
    for r in kept[5].collect():
        ids = np.frombuffer(r.ids, packing.ID_TYPE)
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, {})[r.start] = ids.tolist()
    for places in by_sequence.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:], strict=False)) and min(places)[0] == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    texts = dict(rows(kept[4]))
    for doc, parts in by_doc.items():
        assert [x for at in sorted(parts) for x in parts[at]] == [*vocabulary.encode(texts[doc], add_special_tokens=False).ids, 1]
    made = packing.sequences(kept[5]).select("sequence_id", "ids").collect()
    assert {r.sequence_id for r in made} == set(by_sequence) and all(len(r.ids) == 2048 * packing.ID_BYTES for r in made)


def test_stages_of_empty_tables_and_clashing_columns(spark, sf_dir):
    """No rows in, none out, with the same columns; columns that operators use inside are left out."""
    none = spark.createDataFrame([], ROW)
    names = ["_tag", "_other", "_id", "_many", "n_words", "kept", "n_removed", "component_id", "dc_runs", "contaminated", "sequence_id", "offset", "ids"]
    more = none.withColumns({c: F.lit("user") for c in names})
    for _, step in pipeline.STAGES:
        columns = step(spark, none, sf_dir).columns
        for docs in (none, more):
            got = step(spark, docs, sf_dir)
            assert got.columns == columns and got.count() == 0
        if step is not pipeline.packed:
            assert columns == pipeline.COLUMNS


def test_stages_leave_out_clashing_columns_of_rows(kept, spark, sf_dir):
    names = ["_tag", "_other", "n_words", "kept", "n_removed", "component_id", "dc_runs", "contaminated", "sequence_id", "offset", "ids"]
    for k, (_, step) in enumerate(pipeline.STAGES[:-1]):
        more = kept[k].withColumns({c: F.lit("user") for c in names})
        assert Counter(rows(step(spark, more, sf_dir))) == Counter(rows(kept[k + 1]))


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by(step, spark, pairs, sf_dir):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in pairs], ROW)
    return Counter(rows(step(spark, docs, sf_dir)))


def test_quality_judges_rows_not_ids(kept, spark, sf_dir):
    pairs = rows(kept[0])
    good = rows(kept[1])[0]
    odd = [(None, good[1]), (None, good[1]), good, (good[0], "too short"), (good[0], None)]
    assert kept_by(pipeline.quality, spark, pairs + odd, sf_dir) == Counter(rows(kept[1])) + Counter(odd[:3])


def test_lines_keep_null_texts_and_odd_ids(spark, sf_dir):
    pairs = [(1, None), (None, None), (None, "a\nb\nc"), (2, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, ""), (4, "x"), (4, "x"), (4, "y"), (5, "x"), (6, "")]
    want = Counter(pairs) - Counter([(2, "a\nb\nc"), (2, "a\nb\nc\nd"), (5, "x")]) + Counter([(2, "d")])
    assert kept_by(pipeline.lines, spark, pairs, sf_dir) == want


def test_near_copies_keep_one_row_a_component(spark, sf_dir):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    pairs = [(5, text("a")), (5, text("a")), (6, text("a")), (None, text("a")), (5, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (7, None), (7, None), (None, ""), (8, text("e")), (8, text("e") + " end")]
    got = kept_by(pipeline.near_copies, spark, pairs, sf_dir)
    last = [k for k in got if k[0] == 8]
    assert len(last) == 1
    assert got == Counter([(5, text("a")), (5, text("b")), (None, text("c")), (None, text("d")), (7, None), (7, None), (None, ""), last[0]])


def test_benchmark_stage_judges_rows_not_ids(kept, spark, sf_dir):
    hit = next(r for r in rows(kept[3]) if r not in set(rows(kept[4])))
    pairs = [hit, (None, hit[1]), (None, "a clean text"), (None, "a clean text"), (hit[0], "a clean text"), (1, None)]
    assert kept_by(pipeline.clean_of_benchmarks, spark, pairs, sf_dir) == Counter(pairs[2:])


def test_packing_keeps_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (1, None, "en", "s", 0), (1, "c", "en", "s", 1)], ROW)
    assert Counter(r.doc_id for r in pipeline.packed(spark, docs, sf_dir).collect()) == {None: 2, 1: 2}
