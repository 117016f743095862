"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over windows of WINDOW bytes, each filter keeps
its largest response, and a softmax layer gives the languages. A text is cut into windows from its
first byte to its last; window probabilities are averaged by the letters they hold.

For application, embedding and filters fold into one table per pair of bytes: a filter of width 4 is
the sum of two looked-up rows, so a batch of windows costs a few gathers and a maximum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts

#: Bytes of a window; widths and number of filters of each; size of an embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 4, 6), 12, 8
#: The training sample: at most so many documents, the same number of each language, and windows of
#: each document (and a short beginning).
DOCUMENTS, WINDOWS_EACH = 2400, 6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

LETTER_BYTE = ts.byte_class(letters=True)
LETTER_BYTE[48:58] = False


def held_out(id_col: str) -> Column:
    """The rows never learnt from: crc32 of the id as text leaves 2 modulo 4 (a null id: as empty)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 4 == 2


def text_windows(text: bytes) -> np.ndarray:
    """All windows of a text, A-Z lower-cased, the last one padded with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = ts.LOWER[np.frombuffer(text, np.uint8)]
    return out.reshape(n, WINDOW)


class ByteCNN:
    """The network: ``embed`` 256 x EMBED, ``conv`` by width, ``bias``, ``dense``, ``dense_bias``."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "dense": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), "dense_bias": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients) of a batch: windows x, class numbers y."""
        p, n = self.p, len(x)
        e = p["embed"][x]
        tops, at = [], {}
        for w in WIDTHS:
            view = np.lib.stride_tricks.as_strided(e, (n, WINDOW - w + 1, w * EMBED), e.strides[:2] + (e.itemsize,), writeable=False)
            r = view.reshape(-1, w * EMBED) @ p[f"conv{w}"]
            r = r.reshape(n, WINDOW - w + 1, FILTERS)
            at[w] = r.argmax(axis=1)
            tops.append(np.take_along_axis(r, at[w][:, None, :], 1)[:, 0] + p[f"bias{w}"])
        h = np.maximum(np.concatenate(tops, axis=1), 0)
        s = h @ p["dense"] + p["dense_bias"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(s[np.arange(n), y], 1e-12)).mean()
        d = s.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"dense": h.T @ d, "dense_bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        dh = (d @ p["dense"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            dw = dh[:, k * FILTERS : (k + 1) * FILTERS]
            bytes_ = x[np.arange(n)[:, None, None], at[w][:, :, None] + np.arange(w)]  # n, FILTERS, w
            patch = p["embed"][bytes_].reshape(n, FILTERS, w * EMBED)
            g[f"conv{w}"] = np.einsum("nf,nfk->kf", dw, patch)
            g[f"bias{w}"] = dw.sum(axis=0)
            back = dw[:, :, None] * p[f"conv{w}"].T[None]
            np.add.at(g["embed"], bytes_.reshape(-1), back.reshape(-1, EMBED))
        g["embed"][0] = 0  # padding stays neutral
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, steps: int = 800, batch: int = 128, rate: float = 3e-3, seed: int = 7) -> ByteCNN:
        """Adam over ``epochs`` of the windows, or as many more as make ``steps`` of them."""
        rng = np.random.default_rng(seed)
        self.p["embed"][0] = 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t = 0
        for _ in range(max(epochs, -(-steps // -(-len(x) // batch)))):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                _, g = self.step(x[order[i : i + batch]], y[order[i : i + batch]])
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def folded(p: dict[str, np.ndarray]) -> dict[int, list[np.ndarray]]:
    """By width: for each pair of filter places, a table of 65,536 byte pairs by FILTERS."""
    out = {}
    for w in WIDTHS:
        each = [(p["embed"] @ p[f"conv{w}"][j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(w)]
        out[w] = [(each[j][:, None] + each[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w, 2)]
    return out


def probabilities(p: dict[str, np.ndarray], tables: dict[int, list[np.ndarray]], x: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Class probabilities of windows x."""
    out = []
    for i in range(0, len(x), chunk):
        b = x[i : i + chunk].astype(np.int32)
        pair = b[:, :-1] * 256 + b[:, 1:]
        tops = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            r = tables[w][0].take(pair[:, :n], axis=0)
            for j, table in enumerate(tables[w][1:], 1):
                r += table.take(pair[:, 2 * j : 2 * j + n], axis=0)
            tops.append(r.max(axis=1) + p[f"bias{w}"])
        s = np.maximum(np.concatenate(tops, axis=1), 0) @ p["dense"] + p["dense_bias"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        out.append(s / s.sum(axis=1, keepdims=True))
    return np.concatenate(out)


def training_windows(text: bytes, each: int = WINDOWS_EACH) -> np.ndarray:
    """Up to ``each`` windows with letters, spread over the text, and a short beginning."""
    w = text_windows(text)
    letters = LETTER_BYTE[w].sum(axis=1)
    w = w[letters >= max(1, min(WINDOW // 4, letters.max()))]
    if not len(w):
        return w
    short = w[0].copy()  # so that short texts are known too
    short[24 + zlib.crc32(text) % (WINDOW - 48) :] = 0
    return np.concatenate((w[sorted({int(k) for k in np.linspace(0, len(w) - 1, each)})], short[None]))


def sample(labelled: DataFrame, most: int = DOCUMENTS) -> list[tuple[str, bytes]]:
    """(lang, windows) of at most ``most`` different texts, about the same number of each language.

    Each language's texts are dealt by a hash into most // languages buckets, and the smallest hash of
    each bucket is taken; so a language of few texts keeps nearly all, and copies count once. Of more
    than ``most`` languages the most frequent are taken. Windows are cut on executors.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64("text").alias("key"), "text")
    langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    if not langs:
        return []
    bucket = F.pmod("key", F.lit(most // len(langs)))
    least = rows.where(F.col("lang").isin(langs)).groupBy("lang", bucket).agg(F.min("key").alias("key")).collect()  # at most ``most`` rows
    chosen = {(r["lang"], r["key"]) for r in least}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            found: list[tuple[str, int, bytes]] = []
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, key) in chosen and (lang, key) not in seen:
                    seen.add((lang, key))
                    found.append((lang, key, training_windows(text.encode()).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "key", "windows"])

    picked = rows.where(F.col("key").isin([k for _, k in chosen])).mapInArrow(cut, "lang string, key long, windows binary")
    return [(r["lang"], bytes(r["windows"])) for r in picked.dropDuplicates(["lang", "key"]).orderBy("lang", "key").collect()]


def train(rows: list[tuple[str, bytes]], **options) -> tuple[list[str], ByteCNN | None]:
    """(languages, network) from (lang, windows) rows."""
    langs = sorted({lang for lang, w in rows if w})
    x = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in rows]
    if not langs:
        return langs, None
    y = np.repeat([langs.index(lang) if w else 0 for lang, w in rows], [len(a) for a in x])
    return langs, ByteCNN(len(langs)).fit(np.concatenate(x), y, **options)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learns from a sample (DOCUMENTS, WINDOWS_EACH) of rows with text and lang outside the held-out
    part; predicts from whole texts alone. A text that is null or has no letter is ``und`` with score
    0, and so is every text if nothing could be learnt. score is the mean probability of lang_pred.
    Repeated rows get the same; a null id stays null; extra columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    langs, net = train(sample(rows.where("NOT held_out")))
    held = docs.sparkSession.sparkContext.broadcast(net.p if net else None)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        tables = folded(p) if p else {}
        for batch in batches:
            for part in ts.pieces(batch, "text", 2 << 20):
                texts = part.column(2).to_pylist()
                known = [i for i, x in enumerate(texts) if p and x and _LETTER.search(x)]
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                windows = [text_windows(texts[i].encode()) for i in known]
                if windows:
                    x = np.concatenate(windows)
                    first = np.cumsum([0, *(len(w) for w in windows[:-1])])
                    letters = LETTER_BYTE[x].sum(axis=1)
                    q = probabilities(p, tables, x) * letters[:, None]
                    q = np.add.reduceat(q, first) / np.add.reduceat(letters, first)[:, None]
                    for i, best, s in zip(known, q.argmax(axis=1).tolist(), q.max(axis=1).tolist(), strict=True):
                        pred[i], score[i] = langs[best], min(1.0, s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("id", "held_out", "text").mapInArrow(predict, PREDICTED)
