"""Benchmark decontamination by a prefix-filtered set join on rare shingles.

A window is ``size`` consecutive words of an item (a shorter item is one window); equal windows are one,
with a list of its items. A text contains a window only if it has all the window's shingles, so one
shingle is a sufficient prefix: the rarest by its count over all documents. Documents meet the index
of these prefix shingles; each match gives a candidate start (the match less the shingle's place in
its window), which must lie inside the text with the whole window (positional and length bound); the
window's words are then compared one by one, first by hash, then byte by byte.

The index is broadcast, so its size is bounded: items are dealt into blocks whose arrays take about
``INDEX_BYTES``. A task cuts each text into words once and runs it against one block after another,
holding one at a time, in one narrow plan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts
from genoloom.scratch import stage

#: Words of a shingle; most bytes of one broadcast index; its bytes a word; candidates looked at at once.
SHINGLE, INDEX_BYTES, WORD_BYTES, CHUNK = 3, 64 << 20, 64, 1 << 18
U = np.uint64


def _same_windows(a: ts.Words, at: np.ndarray, n: np.ndarray, b: ts.Words, to: np.ndarray, m: np.ndarray) -> np.ndarray:
    """True where the ``n`` words of ``a`` from ``at`` are the ``m`` words of ``b`` from ``to``, byte by byte."""
    out = n == m
    for j in range(int(n.max(initial=0))):
        k = np.flatnonzero(out & (j < n))
        out[k] = a.same_words(at[k] + j, b, to[k] + j)
    return out


class WindowIndex:
    """Distinct windows of a block of items, found by their rarest shingle."""

    def __init__(self, ids: list[str], texts: list[str | None], size: int):
        words = ts.Words(pa.array(texts, pa.large_string()), ts.ALNUM)
        whole = np.minimum(words.count, size)
        per = np.where(words.count > 0, words.count - whole + 1, 0)
        item = np.repeat(np.arange(len(ids)), per)
        start = words.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        length = whole[item]
        # Equal windows are one: by their length and a hash of their words.
        content = np.zeros(len(item), U)
        for j in range(int(length.max(initial=0))):
            inside = j < length
            content[inside] = ts.mix(content[inside] + words.hash[start[inside] + j])
        content = ts.mix(content ^ length.astype(U))
        while True:
            _, first, window = np.unique(content, return_index=True, return_inverse=True)
            window = window.reshape(-1)
            other = np.flatnonzero(~_same_windows(words, start, length, words, start[first[window]], length[first[window]]))
            if not len(other):
                break
            content[other] = ts.mix(content[other] + U(1))  # another window of the same hash
        self.ids, self.words = ids, words.hash
        self.bytes, self.begin, self.size = words.bytes, words.start, (words.end - words.start)
        self.start, self.length = start[first], length[first].astype(np.int16)
        pairs = np.unique(window * max(len(ids), 1) + item)
        self.item, bounds = pairs % max(len(ids), 1), np.arange(len(first) + 1)
        self.items = np.searchsorted(pairs // max(len(ids), 1), bounds)
        self.kinds = sorted(set(np.minimum(self.length, SHINGLE).tolist()))
        self.shingles = {}
        for s in self.kinds:
            at, h = words.windows(s)
            place = np.full(len(words.hash) + 1, -1)
            place[at] = np.arange(len(at))
            self.shingles[s] = (place, h, np.unique(h))

    def known(self) -> dict[int, np.ndarray]:
        """The block's shingles of each size, sorted."""
        return {s: known for s, (_, _, known) in self.shingles.items()}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Order each window's shingles by rarity and index the first (ties: the leftmost)."""
        self.key, self.windows, self.bounds, self.offset = {}, {}, {}, np.zeros(len(self.start), np.int16)
        for s in self.kinds:
            place, h, known = self.shingles[s]
            mine = np.flatnonzero(np.minimum(self.length, SHINGLE) == s)
            best, rare = np.zeros(len(mine), U), np.full(len(mine), np.iinfo(np.int64).max)
            for j in range(int((self.length[mine] - s).max()) + 1):
                ok = j <= self.length[mine] - s
                x = h[place[np.where(ok, self.start[mine] + j, self.start[mine])]]
                n = np.where(ok, counts[s][np.searchsorted(known, x)], np.iinfo(np.int64).max)
                less = n < rare
                best[less], rare[less], self.offset[mine[less]] = x[less], n[less], j
            order = np.argsort(best, kind="stable")
            self.key[s], first = np.unique(best[order], return_index=True)
            self.windows[s], self.bounds[s] = mine[order], np.append(first, len(order))
        del self.shingles

    def occurrences(self, words: ts.Words, shingles: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in the batch, verified word by word.

        A place has at most one window of each length, so there are no more than words times lengths.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in self.kinds:
            at, h = shingles[s]
            k = np.minimum(np.searchsorted(self.key[s], h), len(self.key[s]) - 1)
            hit = np.flatnonzero(self.key[s][k] == h)
            at, k = at[hit], k[hit]
            n = self.bounds[s][k + 1] - self.bounds[s][k]
            sums = np.concatenate(([0], np.cumsum(n)))
            cut = 0
            while cut < len(n):
                to = max(cut + 1, int(np.searchsorted(sums, sums[cut] + CHUNK, "right")) - 1)
                found.append(self._verified(s, words, at[cut:to], k[cut:to], n[cut:to]))
                cut = to
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _verified(self, s: int, words: ts.Words, at: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.windows[s][np.repeat(self.bounds[s][k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        of = np.repeat(words.of[at], n)
        start = np.repeat(at, n) - self.offset[w]
        ok = (start >= words.first[of]) & (start + self.length[w] <= words.first[of + 1])
        start, w = start[ok], w[ok]
        for j in range(int(self.length.max()) if len(w) else 0):
            inside = j < self.length[w]
            same = words.hash[np.where(inside, start + j, 0)] == self.words[np.where(inside, self.start[w] + j, 0)]
            ok = same | ~inside
            start, w = start[ok], w[ok]
        # What has the same hashes is compared byte by byte.
        for j in range(int(self.length.max()) if len(w) else 0):
            inside = np.flatnonzero(j < self.length[w])
            a, b = start[inside] + j, self.start[w[inside]] + j
            size = self.size[b]
            same = words.end[a] - words.start[a] == size
            same[same] = ts.same_spans(words.bytes, words.start[a[same]], self.bytes, self.begin[b[same]], size[same])
            ok = np.ones(len(w), bool)
            ok[inside] = same
            start, w = start[ok], w[ok]
        return start, w


class Held:
    """A broadcast object of which a worker holds at most one at a time, if there are several."""

    def __init__(self, spark, values: list):
        self.parts = [spark.sparkContext.broadcast(x) for x in values]

    def __iter__(self):
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                vars(part).pop("_value", None)  # it is loaded from its file again


def _counts(docs: DataFrame, held: Held, kinds: list[int]) -> DataFrame:
    """(block, size, at, n): how often each shingle of each block occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [{s: words.windows(s)[1] for s in kinds} for words in (ts.Words(p.column(0), ts.ALNUM) for p in ts.pieces(batch, "text"))]
            for block, known in enumerate(held):
                for s, mine in known.items():
                    n = np.zeros(len(mine), np.int64)
                    for part in parts:
                        k = np.minimum(np.searchsorted(mine, part[s]), len(mine) - 1)
                        n += np.bincount(k[mine[k] == part[s]], minlength=len(mine))
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(np.full(len(at), s)), pa.array(at), pa.array(n[at])], names=["block", "size", "at", "n"])

    return docs.mapInArrow(count, "block long, size long, at long, n long").groupBy("block", "size", "at").agg(F.sum("n").alias("n"))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str, str]]]:
    """Items (id, text) in blocks whose index takes about INDEX_BYTES."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
    total = rows.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    n = -(-total * WORD_BYTES // INDEX_BYTES) or 1
    return [sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()) for i in range(n)]


def indexes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, size: int) -> list[WindowIndex]:
    """The index of each block that has a window, its prefixes chosen by counts over ``docs`` (text)."""
    found = [WindowIndex([i for i, _ in block], [t for _, t in block], size) for block in item_blocks(items, item_id, item_text)]
    found = [x for x in found if x.kinds]
    if found:
        counted = _counts(docs, Held(docs.sparkSession, [x.known() for x in found]), sorted({s for x in found for s in x.kinds}))
        counted = stage(counted, "shingle-counts") if len(found) > 1 else counted
        for k, index in enumerate(found):
            counts = {s: np.zeros(len(known), np.int64) for s, known in index.known().items()}
            for r in counted.where(F.col("block") == k).collect():  # a row for each shingle of the block at most
                counts[r["size"]][r["at"]] = r["n"]
            index.choose(counts)
    return found


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """``docs`` with dc_words long, dc_runs array<long>, dc_items array<string>.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. dc_runs holds pairs
    of first and past-the-end word numbers that occurrences of windows cover (merged, in order);
    dc_items the distinct ids (as text) of items with an occurring window. A null text has no words;
    items without words have no window; a null id is the empty text. Repeated rows keep a row each;
    without items nothing is hit. Columns of ``docs`` of these three names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("dc_words", "dc_runs", "dc_items")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    shape = rows.select("*", F.lit(0).cast("long").alias("dc_words"), F.array().cast("array<long>").alias("dc_runs"), F.array().cast("array<string>").alias("dc_items")).schema
    held = Held(docs.sparkSession, [vars(x) for x in indexes(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), items, item_id, item_text, size)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.pieces(batch, text_col):
                yield _marked(part, ts.Words(part.column(text_col), ts.ALNUM), held)

    return rows.mapInArrow(scan, shape)


def _marked(part: pa.RecordBatch, words: ts.Words, held: Held) -> pa.RecordBatch:
    """The batch with words, covered runs and items of each text."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    items: list[list[str]] = [[] for _ in range(words.n_texts)]
    shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for values in held:
        index = object.__new__(WindowIndex)
        vars(index).update(values)
        shingles |= {s: words.windows(s) for s in index.kinds if s not in shingles}
        start, w = index.occurrences(words, shingles)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + index.length[w], -1)
        pairs = np.unique(words.of[start] * len(index.start) + w)
        text, w = pairs // len(index.start), pairs % len(index.start)
        n = index.items[w + 1] - index.items[w]
        item = index.item[np.repeat(index.items[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        pairs = np.unique(np.repeat(text, n) * len(index.ids) + item)
        for t, i in zip((pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist(), strict=True):
            items[t].append(index.ids[i])
    # A border of a run is where coverage changes; texts begin and end uncovered.
    hit = np.zeros(len(words.hash) + words.n_texts + 1, bool)
    hit[np.arange(len(words.hash)) + words.of + 1] = np.cumsum(edge[:-1]) > 0
    border = np.flatnonzero(hit[1:] != hit[:-1])
    shift = words.first[:-1] + np.arange(words.n_texts)
    of = np.searchsorted(shift, border, "right") - 1
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(words.n_texts + 1)).astype(np.int32)), pa.array(border - shift[of]))
    items = [sorted(set(x)) for x in items]
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(words.count, pa.int64()), runs, pa.array(items, pa.list_(pa.string()))], names=[*part.schema.names, "dc_words", "dc_runs", "dc_items"])


def hits(found: DataFrame) -> DataFrame:
    """Adds n_words, n_hit, n_items, item_ids, contaminated to what find_contamination returned."""
    odd = F.aggregate(F.col("dc_runs"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")), lambda s: s["sum"])
    kept = found.drop("dc_words", "dc_runs", "dc_items").columns
    return found.select(*[F.col(f"`{c}`") for c in kept if c.lower() not in ("n_words", "n_hit", "n_items", "item_ids", "contaminated")], F.col("dc_words").alias("n_words"), odd.alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"), F.sort_array("dc_items").alias("item_ids"), (F.size("dc_runs") > 0).alias("contaminated"))
