"""Vectorised word scanning of Arrow string arrays: words and their hashes without a Python loop.

All texts of a batch lie in one byte buffer. Word borders come from a 256-entry class table. A word is
hashed eight bytes at a time, all words side by side, with a bit mixer after every step; words of more
than LONG bytes are hashed by xxh3. Equal words have equal hashes. Different words of up to eight bytes
and one length never share one; others do with a chance of about 2**-64, so ``same_spans`` is there for
callers whose results must be exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

U = np.uint64
#: Spans of more bytes are hashed and compared one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Slices of a batch whose texts hold about ``most_bytes`` each (a longer text stands alone)."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
    ends, total = np.cumsum(sizes), 0
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, total + most_bytes, "right")))
        yield batch.slice(at, to - at)
        total, at = int(ends[to - 1]), to


def byte_class(letters: bool = False) -> np.ndarray:
    """True for bytes of words: all but white space, or (letters) 0-9, a-z, A-Z and non-ASCII."""
    out = np.ones(256, bool)
    if letters:
        out[:128] = False
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            out[lo:hi] = True
    else:
        out[[0x20, *range(0x09, 0x0E)]] = False
    return out


SPACED = byte_class()
ALNUM = byte_class(letters=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The number that eight bytes from each place of ``buf`` make (behind its end stand zeros)."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True where the ``size`` bytes of ``a`` from ``at`` are those of ``b`` from ``to``."""
    out = np.ones(len(at), bool)
    long = size > LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = a[at[k] : at[k] + size[k]].tobytes() == b[to[k] : to[k] + size[k]].tobytes()
    live, x, y, step = np.flatnonzero(~long & (size > 0)), _eights(a), _eights(b), 0
    while len(live):
        differ = (x[at[live] + step] ^ y[to[live] + step]) & _FIRST[np.minimum(size[live] - step, 8)]
        out[live[differ != 0]] = False
        step += 8
        live = live[(differ == 0) & (size[live] > step)]
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offs):
        return buf[:0], np.zeros(1, np.int64)
    return buf[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a batch: start, end (bytes), of (text number), hash, per text: first, count."""

    def __init__(self, texts: pa.Array, member: np.ndarray = SPACED, lower: bool = True):
        self.buf, self.offs = buffers(texts)
        self.n_texts = len(self.offs) - 1
        n = len(self.buf)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[self.buf]
        border = np.zeros(n + 1, bool)
        border[self.offs] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
        self.of = np.searchsorted(self.offs, self.start, "right") - 1
        self.count = np.bincount(self.of, minlength=self.n_texts)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.bytes = LOWER[self.buf] if lower else self.buf
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans [start, end), A-Z lower-cased if the words are."""
        size = end - start
        h = mix(size.astype(U) * U(0xA0761D6478BD642F))
        long = size > LONG
        for k in np.flatnonzero(long).tolist():
            h[k] = xxhash.xxh3_64_intdigest(self.bytes[start[k] : end[k]].tobytes())
        live, x, step = np.flatnonzero(~long & (size > 0)), _eights(self.bytes), 0
        while len(live):
            part = x[start[live] + step] & _FIRST[np.minimum(size[live] - step, 8)]
            h[live] = mix(h[live] * U(0x9FB21C651E98DF25) + part)
            step += 8
            live = live[size[live] > step]
        return h

    def same_words(self, at: np.ndarray, other: "Words", to: np.ndarray) -> np.ndarray:
        """True where word ``at`` is word ``to`` of ``other``, byte by byte."""
        size = self.end[at] - self.start[at]
        out = size == other.end[to] - other.start[to]
        out[out] = same_spans(self.bytes, self.start[at[out]], other.bytes, other.start[to[out]], size[out])
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of ``size`` words that lies in one text."""
        w = self.hash
        m = len(w) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.of[: m] == self.of[size - 1 :])
        h = np.zeros(len(at), U)
        for j in range(size):
            h = h * U(0x9FB21C651E98DF25) + w[at + j]
        return at, mix(h ^ U(size))

    def whole(self, texts: np.ndarray) -> np.ndarray:
        """One hash for the whole word sequence of each of ``texts`` (those with few words)."""
        out = np.zeros(len(texts), U)
        for k, t in enumerate(texts):
            h = 0
            for x in self.hash[self.first[t] : self.first[t + 1]].tolist():
                h = (h * 0x9FB21C651E98DF25 + x) & 0xFFFFFFFFFFFFFFFF
            out[k] = h ^ int(self.count[t])
        return mix(out)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, sorted by both. Up to 65,536 texts.

    A text of fewer words than ``size`` has its whole sequence as its one shingle; one without
    words has none.
    """
    at, h = words.windows(size)
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    of = np.concatenate((words.of[at], few)).astype(U)
    h = np.concatenate((h, words.whole(few)))
    keys = (of << U(48)) | (h >> U(16))
    order = np.argsort(keys)
    keys, of, h = keys[order], of[order], h[order]
    again = keys[1:] == keys[:-1]
    if (again & (h[1:] != h[:-1])).any():  # the last 16 bits tell some apart
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        again = (of[1:] == of[:-1]) & (h[1:] == h[:-1])
    new = np.concatenate(([True], ~again))[: len(h)]
    return of[new].astype(np.int64), h[new]


def pack48(values: np.ndarray) -> np.ndarray:
    """48-bit values as a byte matrix of six columns."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6]


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(U)


def binary_rows(matrix: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array: row i holds the next counts[i] rows of ``matrix``."""
    width = matrix.shape[1]
    offs = np.concatenate(([0], np.cumsum(counts * width))).astype(np.int32)
    data = np.ascontiguousarray(matrix).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])
