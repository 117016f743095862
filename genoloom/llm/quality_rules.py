"""Quality rules as weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each text. A two-class model with conditionally
independent votes is fitted by expectation-maximisation to the counts of all vote patterns of all
documents (at most 3 ** rules of them, counted on executors): it estimates how accurate each rule
is on good and on bad texts. The posterior probability of good replaces "all rules must pass".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts
from genoloom.scratch import stage

U = np.uint64
#: What the scan counts in each text. The first five are the base columns.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bang", "n_spelt", "n_closed"]
#: Symbols; characters that close a line of prose.
SYMBOLS, CLOSERS = "#*$%&|<>", ".!?:;\"')"


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offs[1:]] - sums[offs[:-1]]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


LETTERS = ts.byte_class(letters=True)
LETTERS[48:58] = False
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def _classes(of: np.ndarray, h: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first item of each item's class: equal ``of``, ``h``, and by ``same`` (of two index arrays).

    Items of one hash that are not the same are told apart by taking those that differ from the first
    again and again, so hashes decide nothing.
    """
    out, live = np.arange(len(h)), np.arange(len(h))
    while len(live):
        order = live[np.lexsort((live, h[live], of[live]))]
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])))
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = order != first
        order, first = order[later], first[later]
        equal = same(order, first)
        out[order[equal]] = first[equal]
        live = order[~equal]
    return out


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; a null is empty."""
    w = ts.Words(texts, ts.SPACED, lower=False)
    buf, offs = w.buf, w.offs
    out = {"n_words": w.count, "word_chars": _per_text(ts.SPACED[buf] & ((buf & 0xC0) != 0x80), offs), "n_symbols": _per_text(_table(SYMBOLS)[buf], offs)}
    # lines that hold a word
    cut = buf == 10
    starts = np.unique(np.concatenate((offs[:-1], np.flatnonzero(cut) + 1)))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    last = np.concatenate(([0], np.cumsum(ts.SPACED[buf], dtype=np.int64)))
    full = last[ends] > last[starts]
    starts, ends = starts[full], ends[full]
    ends = ends - (cut[ends - 1] if len(ends) else 0)
    of = np.searchsorted(offs, starts, "right") - 1
    line = _classes(of, w.spans(starts, ends), lambda a, b: (ends[a] - starts[a] == ends[b] - starts[b]) & ts.same_spans(buf, starts[a], buf, starts[b], np.minimum(ends[a] - starts[a], ends[b] - starts[b])))
    out["n_dup_lines"] = np.bincount(of[line != np.arange(len(line))], minlength=w.n_texts)
    out["n_lines"] = np.bincount(of, minlength=w.n_texts)
    closing = np.searchsorted(w.start, ends) - 1  # the line's last word
    out["n_closed"] = np.bincount(of, weights=_table(CLOSERS)[buf[w.end[closing] - 1]] if len(of) else None, minlength=w.n_texts).astype(np.int64)
    # words in five-word windows that the text has twice or more
    at, h = w.windows(5)
    same = _classes(w.of[at], h, lambda a, b: np.logical_and.reduce([w.same_words(at[a] + j, w, at[b] + j) for j in range(5)]))
    twice = np.bincount(same, minlength=len(at))[same] > 1
    edge = np.zeros(len(w.hash) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + 5] -= 1
    out["n_repeat_words"] = _per_text(np.cumsum(edge[:-1]) > 0, w.first)
    out["n_upper"], out["n_letters"], out["n_bang"] = (_per_text(t, offs) for t in (UPPER[buf], LETTERS[buf] & ((buf & 0xC0) != 0x80), _table("!")[buf]))
    letters = np.concatenate(([0], np.cumsum(LETTERS[buf], dtype=np.int64)))
    out["n_spelt"] = _per_text(letters[w.end] > letters[w.start], w.first)
    return out


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns but clashing ones) with COUNTS; a null text counts as empty."""
    keep = [c for c in docs.columns if c.lower() not in COUNTS]
    shape = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(0).cast("long").alias(c) for c in COUNTS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.pieces(batch, text_col):
                n = text_counts(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(n[c], pa.int64()) for c in COUNTS]], names=[*part.schema.names, *COUNTS])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(scan, shape.schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(value: Column, bad_from: float, good_to: float) -> Column:
    """Bad at or over one bound, good at or under the other, else no vote."""
    return F.when(value >= bad_from, -1).when(value <= good_to, 1).otherwise(0)


def rules() -> list[tuple[str, Column]]:
    """(name, vote) of each rule. Ratios are per word, line or letter; without words all abstain."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    length = F.col("word_chars") / words
    found = [
        ("word_length", F.when((length < 2.5) | (length > 14), -1).when((length >= 3) & (length <= 11), 1).otherwise(0)),
        ("symbols", _vote(F.col("n_symbols") / words, 0.25, 0.03)),
        ("repeated_lines", _vote(F.col("n_dup_lines") / lines, 0.3, 0.1)),
        ("repeated_words", _vote(F.col("n_repeat_words") / words, 0.15, 0.05)),
        ("capitals", _vote(F.col("n_upper") / letters, 0.4, 0.1)),
        ("exclamations", _vote(F.col("n_bang") / words, 0.3, 0.05)),
        ("letter_share", _vote(1 - F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1)), 0.25, 0.12)),
        ("spelt_words", _vote(1 - F.col("n_spelt") / words, 0.25, 0.1)),
        ("closed_lines", _vote(1 - F.col("n_closed") / lines, 0.8, 0.4)),
    ]
    return [(name, F.when(F.col("n_words") == 0, 0).otherwise(vote).cast("int")) for name, vote in found]


class LabelModel:
    """P(good) of a vote pattern; accuracies per rule and class, fitted by EM to pattern counts."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 200):
        """votes: patterns by rules, in -1, 0, 1. Smoothing keeps every estimate inside (0, 1)."""
        self.prior, n = 0.9, counts.sum()
        good, bad, cast = votes == 1, votes == -1, votes != 0
        # The start: a bad vote is twice as likely on a bad text as a good vote is on it.
        self.right_good = np.full(votes.shape[1], 0.95)
        self.right_bad = np.full(votes.shape[1], 0.4)
        for self.rounds in range(1, rounds + 1):
            p = self._posterior(good, bad)
            a, b = counts * p, counts * (1 - p)
            prior = (a.sum() + 9) / (n + 10)
            right_good = ((a[:, None] * good).sum(axis=0) + 9.5) / ((a[:, None] * cast).sum(axis=0) + 10)
            right_bad = ((b[:, None] * bad).sum(axis=0) + 4) / ((b[:, None] * cast).sum(axis=0) + 10)
            change = max(abs(prior - self.prior), np.abs(right_good - self.right_good).max(initial=0), np.abs(right_bad - self.right_bad).max(initial=0))
            self.prior, self.right_good, self.right_bad = prior, right_good, right_bad
            if change < 1e-9:
                break

    def _posterior(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        up = np.log(self.prior) + good @ np.log(self.right_good) + bad @ np.log(1 - self.right_good)
        down = np.log(1 - self.prior) + bad @ np.log(self.right_bad) + good @ np.log(1 - self.right_bad)
        return 1 / (1 + np.exp(np.clip(down - up, -700, 700)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior(votes == 1, votes == -1)


def judge(counted: DataFrame, keep_from: float = 0.5) -> tuple[DataFrame, LabelModel]:
    """(``counted`` with base_failed, p_good, kept; the model).

    ``counted`` has COUNTS and is read twice, so it should be a table. The model is fitted to all
    rows whose base check passes. kept: the base check passed and p_good >= ``keep_from``. An empty
    table leaves the model at its start.
    """
    named = rules()
    k = len(named)
    digits = sum(((vote + 1) * 3**i for i, (_, vote) in enumerate(named)), F.lit(0))
    pattern = "_pattern"  # a name that no column has
    while pattern in [c.lower() for c in counted.columns]:
        pattern += "_"
    coded = counted.drop("base_failed", "p_good", "kept").withColumns({"base_failed": base_failed(), pattern: digits})
    seen = coded.where(~F.col("base_failed")).groupBy(pattern).count().collect()  # at most 3 ** k rows
    codes = np.array([r[pattern] for r in seen], np.int64)
    decode = lambda c: c[:, None] // 3 ** np.arange(k) % 3 - 1
    model = LabelModel(decode(codes), np.array([r["count"] for r in seen], float))
    p = dict(zip(codes.tolist(), model.posterior(decode(codes)).tolist(), strict=True))
    table = counted.sparkSession.createDataFrame(sorted(p.items()) or [(-1, 0.0)], f"{pattern} int, p_good double")
    out = coded.join(F.broadcast(table), pattern, "left").drop(pattern)
    out = out.withColumn("p_good", F.when(F.col("base_failed"), 0.0).otherwise(F.col("p_good")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from)), model


def quality(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or only ``columns`` of it) with COUNTS, base_failed, p_good and kept for every row.

    Words lie between white space; a null or empty text has no words and fails the base check;
    repeated rows are judged alike and each kept or rejected; clashing columns are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "p_good", "kept")])
    counted = with_counts(docs, text_col)
    keep = columns if columns is not None else [c for c in docs.columns if c.lower() not in COUNTS]
    return judge(stage(counted.select(*[F.col(f"`{c}`") for c in keep], *COUNTS), "counted"))[0]
