"""Bounded-space best fit: whole ids, the rules of cutting, a plain twin of the bins, odd tables."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoloom.llm import best_fit, packing, queries

VOCABULARY, RANKS = queries.vocabulary(queries.VOCABULARY), queries.vocabulary(queries.RANKS)


class PlainBins:
    """The same rule over a plain list of (free space, age) bins."""

    def __init__(self, window, most):
        self.window, self.most, self.open = window, most, []

    def put(self, length, item):
        fits = [b for b in self.open if b[0] >= length]
        closed = []
        if fits:
            bin_ = min(reversed(fits), key=lambda b: b[0])
        else:
            if len(self.open) == self.most and length < self.window:
                full = min(reversed(self.open), key=lambda b: b[0])
                self.open.remove(full)
                closed.append(full[1])
            bin_ = [self.window, []]
            self.open.append(bin_)
        bin_[1].append(item)
        bin_[0] -= length
        self.open.remove(bin_)
        if bin_[0]:
            self.open.append(bin_)
        else:
            closed.append(bin_[1])
        return closed


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_bins_follow_the_rule(lengths, most):
    fast, plain = best_fit.OpenBins(40, most), PlainBins(40, most)
    for i, n in enumerate(lengths):
        assert fast.put(n, (i, n)) == plain.put(n, (i, n))
        assert fast.used == len(plain.open) <= most
        assert fast.bits == sum(1 << room for room in {b[0] for b in plain.open})
    assert sorted(fast.rest()) == sorted(b[1] for b in plain.open)


@given(st.integers(1, 10_000))
def test_cuts(n):
    starts = best_fit.piece_starts(n, 2048)
    lengths = np.diff([*starts, n])
    assert len(starts) == -(-n // 2048) and (lengths[1:] == 2048).all() and 1 <= lengths[0] <= 2048


def texts():
    rng = random.Random(8)
    words = "the quick brown fox was élan 1234 under_score".split()
    rows = [(1, None), (2, ""), (3, " "), (None, "a null id"), (5, "twice"), (5, "twice"), (6, "word " * 9000), (7, "x" * 300_000), (8, "end of text <|endoftext|> inside")]
    return rows + [(i, " ".join(rng.choices(words, k=rng.randrange(1, 900)))) for i in range(10, 400)]


def by_hand(rows, window=2048):
    encoder, out = packing.Encoder(VOCABULARY), []
    for doc, text in rows:
        ids = np.array([*encoder.encode(text or ""), 0], "<u4")
        starts = [0, *range((len(ids) - 1) % window + 1, len(ids), window)]
        out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    return sorted(out, key=str)


def held_by(found, window=2048):
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return by


@pytest.mark.parametrize("parts,bins", [(1, 1024), (30, 1024), (30, 4)])
def test_pieces_are_whole(spark, parts, bins):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "piece": F.lit("p"), "task": F.lit(2)}).repartition(parts)
    found = best_fit.digests(best_fit.pack_online(docs, VOCABULARY, RANKS, bins=bins)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == by_hand(rows)
    by, total = held_by(found), sum(r["length"] for r in found)
    assert len(by) <= (-(-total // 2048) + 1 if bins > 4 else 1.5 * total / 2048)


def test_empty_table(spark):
    assert best_fit.pack_online(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, RANKS).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op12_best_fit_packing"](spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == by_hand(rows)
    assert len(held_by(found)) <= 1.02 * sum(r["length"] for r in found) / 2048 + 1
