"""Values in the order of md5(seed:name:sid) under many names at once, by bytes and not by rows.

A task hashes its rows for all names in numpy, sorts them and sends, for each name and range of hashes,
one compressed block of differences and codes: some 6.5 bytes a value. A range is sorted by one task
and holds BUCKET values about; its ranks follow from the counts of the ranges before it. Then all
sequences are cut at the same ranks and meet in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.hot import even, few
from genoloom.operators.pairs import _codes
from genoloom.scratch import drop, stage

#: Rows that a task hashes together; values of a sequence that a task sorts; ranks and bytes of a chunk.
ROWS, BUCKET, CHUNK, CHUNK_BYTES = 1 << 18, 1 << 20, 1 << 16, 64 << 20
#: Leading bytes of the hash that are sent first; all of it is sent if values of other codes tie.
LEADING, WHOLE = 8, 16
#: Code of what is not 0, 1 or 2.
OTHER = 9

_SHIFTS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4)
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Rows whose words are mixed together, few enough to stay in a cache.
_STEP = 1 << 15


def _md5_words(words: list[np.ndarray]) -> np.ndarray:
    """(n, 2) uint64, the digests of one-block messages given as 16 arrays of little-endian words."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(words[0]), x) for x in start)
    for i in range(64):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f += a
        f += words[_WORDS[i]]
        f += np.uint32(_SINES[i])
        f = (f << np.uint32(_SHIFTS[i])) | (f >> np.uint32(32 - _SHIFTS[i]))
        f += b
        a, d, c, b = d, c, b, f
    out = np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=1).astype("<u4")
    return out.view(">u8").astype(np.uint64)


class Hashes:
    """md5(prefix + text) of the same texts under many prefixes."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.laid = texts, {}
        self.sizes = np.array([len(t) for t in texts], np.int64)

    def _words(self, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Which texts fit one block behind so many bytes, and their blocks as words, (16, n)."""
        if before not in self.laid:
            fits = np.flatnonzero(self.sizes + before <= 55)
            sizes = self.sizes[fits]
            block = np.zeros((len(fits), 64), np.uint8)
            joined = np.frombuffer(b"".join([self.texts[i] for i in fits]), np.uint8)
            row = np.repeat(np.arange(len(fits)), sizes)
            block[row, before + np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = joined
            block[np.arange(len(fits)), before + sizes] = 0x80
            block[:, 56:58] = ((before + sizes) * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
            self.laid = {before: (fits, np.ascontiguousarray(block.view("<u4").T))}
        return self.laid[before]

    def of(self, prefix: bytes) -> np.ndarray:
        """(n, 2) uint64: digests whose order is that of their hexadecimal text."""
        out = np.empty((len(self.texts), 2), np.uint64)
        fits, words = self._words(len(prefix)) if len(prefix) <= 55 else (np.zeros(0, np.int64), np.zeros((16, 0), np.uint32))
        first = np.frombuffer(prefix[:55].ljust(64, b"\0"), "<u4")
        for at in range(0, len(fits), _STEP):
            out[fits[at : at + _STEP]] = _md5_words([w[at : at + _STEP] | np.uint32(p) for w, p in zip(words, first, strict=True)])
        if len(fits) < len(self.texts):
            for i in np.setdiff1d(np.arange(len(self.texts)), fits):
                out[i] = np.frombuffer(md5(prefix + self.texts[i]).digest(), ">u8")
        return out


def _packed(planes: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, planes: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * planes, codec="zstd", asbytes=True), np.uint8).reshape(planes, n)


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, classes, codes) of ROWS rows about; codes are 0, 1, 2 and OTHER."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _gathered(held, width)
            held, n = [], 0
    if n:
        yield _gathered(held, width)


def _gathered(held: list[pa.RecordBatch], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    codes = np.concatenate([_codes(b.column(2), width) for b in held])
    texts = [x or b"" for b in held for x in b.column(0).to_pylist()]
    return texts, np.concatenate([b.column(1).to_numpy() for b in held]), np.where((codes >= 0) & (codes <= 2), codes, OTHER).astype(np.uint8)


def _runs(rows: DataFrame, width: int, seed: int, names: list[str], taken: list[list[int]], bits: int, sent: int) -> DataFrame:
    """(k, c, b, n, tied, codes): the codes of sequence k, class c and range of hashes b, in order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, classes, codes in _rows(batches, width):
            hashes = Hashes(texts)
            each = [(int(c), np.flatnonzero(classes == c)) for c in np.unique(classes)]
            for k, name in enumerate(names):
                h, out = hashes.of(f"{seed}:{name}:".encode()), []
                for c, own in each:
                    mine = own[np.argsort(h[own, 0], kind="stable")]
                    lead = h[mine, 0]
                    bucket = (lead >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mine), np.int64)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    for at, to in zip(cuts, [*cuts[1:], len(mine)], strict=True):
                        steps = np.diff(lead[at:to], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
                        planes = [steps, codes[mine[at:to]][:, taken[k]].T]
                        if sent == WHOLE:
                            planes.append(h[mine[at:to], 1].astype("<u8").view(np.uint8).reshape(-1, 8).T)
                        out.append((k, c, int(bucket[at]), int(to - at), _packed(np.concatenate(planes))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["k", "c", "b", "n", "block"])

    def put(blocks: pa.Table) -> pa.Table:
        k, c, b = (blocks.column(i)[0].as_py() for i in range(3))
        wide, parts = len(taken[k]), []
        for n, data in zip(blocks.column("n").to_pylist(), blocks.column("block").to_pylist(), strict=True):
            planes = _unpacked(data, n, 8 + wide + (8 if sent == WHOLE else 0))
            words = [np.ascontiguousarray(planes[i : i + 8].T).view("<u8").reshape(-1).astype(np.uint64) for i in (0, *([8 + wide] if sent == WHOLE else []))]
            parts.append((np.cumsum(words[0], dtype=np.uint64), planes[8 : 8 + wide], *words[1:]))
        lead, codes, *rest = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        if sent < 8:  # of the leading bytes only so many count
            lead = lead >> np.uint64(64 - 8 * sent)
        order = np.lexsort((rest[0], lead)) if rest else np.argsort(lead, kind="stable")
        lead, codes = lead[order], codes[:, order]
        tied = not rest and bool(((lead[1:] == lead[:-1]) & (codes[:, 1:] != codes[:, :-1]).any(axis=0)).any())
        return pa.table({"k": pa.array([k], pa.int32()), "c": pa.array([c], pa.int32()), "b": pa.array([b], pa.int32()), "n": pa.array([len(order)], pa.int64()), "tied": [tied], "codes": pa.array([_packed(codes)], pa.binary())})

    blocks = rows.mapInArrow(deal, "k int, c int, b int, n long, block binary")
    return blocks.groupBy("k", "c", "b").applyInArrow(put, "k int, c int, b int, n long, tied boolean, codes binary")


def dealt(m: DataFrame, width: int, codes: Column, class_: Column, seed: int, names: list[str], taken: list[list[int]]) -> DataFrame:
    """(k, c, b, n, at, codes), a table: rows of ``m`` in the order of md5(seed:names[k]:sid), by class.

    ``codes`` is an array<int> of ``width``, of which sequence k carries the places ``taken[k]``; a row of the
    result holds n neighbours of one sequence and class, the first of rank ``at`` (from 0), their codes
    packed by place. Leading bytes of the hash decide; if rows of other codes have the same, the work
    is done again with the whole hash.
    """
    m, n = even(m.select("sid", "label", "g"), "sid")
    rows = m.select(F.col("sid").cast("string").cast("binary").alias("sid"), class_.cast("int").alias("c"), codes.cast("array<int>").alias("codes"))
    bits = max(0, (max(1, -(-n // BUCKET)) - 1).bit_length())
    found = stage(_runs(rows, width, seed, names, taken, bits, LEADING), "runs")
    if not found.where("tied").isEmpty():
        drop(found)
        found = stage(_runs(rows, width, seed, names, taken, bits, WHOLE), "runs")
    before = Window.partitionBy("k", "c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select("k", "c", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    return found.drop("tied").join(few(starts, 1_000_000), ["k", "c", "b"])


def chunked(runs: DataFrame, taken: list[list[int]]) -> DataFrame:
    """(c, chunk, k, at, n, codes) of ``dealt`` rows: cut at the same ranks, all of a chunk in one task, in order."""
    chunk = max(1, min(CHUNK, CHUNK_BYTES // max(1, sum(map(len, taken)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                planes, out, at = _unpacked(r["codes"], r["n"], len(taken[r["k"]])), [], 0
                while at < r["n"]:
                    rank = r["at"] + at
                    to = min(r["n"], at + chunk - rank % chunk)
                    out.append((r["c"], rank // chunk, r["k"], rank % chunk, to - at, _packed(planes[:, at:to])))
                    at = to
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["c", "chunk", "k", "at", "n", "codes"])

    pieces = runs.mapInArrow(cut, "c int, chunk long, k int, at int, n int, codes binary")
    return pieces.repartition("c", "chunk").sortWithinPartitions("c", "chunk", "k", "at")


def chunks(batches: Iterator[pa.RecordBatch], taken: list[list[int]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(class, codes of each sequence, (places, ranks)) of every chunk in a task's ``chunked`` rows."""
    key, held = None, []

    def whole() -> tuple[int, list[np.ndarray]]:
        out = [[] for _ in taken]
        for k, n, data in held:
            out[k].append(_unpacked(data, n, len(taken[k])))
        return key[0], [np.concatenate(x, axis=1) for x in out]

    for batch in batches:
        for c, chunk, k, n, data in zip(*(batch.column(x).to_pylist() for x in ("c", "chunk", "k", "n", "codes")), strict=True):
            if held and key != (c, chunk):
                yield whole()
                held = []
            key = c, chunk
            held.append((k, n, data))
    if held:
        yield whole()
