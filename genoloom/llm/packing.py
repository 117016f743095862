"""Packing token sequences by non-negative least squares.

Each document's tokens are cut at whole windows; what is left over is one piece shorter than a
window. The histogram of piece lengths (at most window - 1 numbers, counted on executors) is the
whole input of the planner: it enumerates shallow combinations of lengths that fill a window, solves
for non-negative repeat counts whose lengths add up to the histogram, rounds them down, and packs
the remaining counts greedily (best fit, largest first, by counts of equal bins, so the work
depends on the window and not on the rows). The plan says for each length where its 1st, 2nd, ...
piece goes. The task that cuts a text numbers its pieces of each length; counts of (task, length) put
these numbers one behind the other, and each piece looks its place up where it is.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts
from genoloom.scratch import stage

#: Triples are enumerated with one of so many most frequent lengths; combinations may waste SLACK ids.
COMMON, SLACK = 48, 8
#: Counts of (task, length) that are broadcast; those of more tasks are joined by a shuffle.
NUMBERS = 300_000
#: Bytes of an id in binary columns, and their numpy type.
ID_BYTES, ID_TYPE = 2, "<u2"
#: Texts up to this code point are encoded by the rank file of the same vocabulary (see Encoder).
PLAIN = "ɏ"


class Encoder:
    """Token ids of a byte-level BPE vocabulary: those of ``tokenizers``, encode(add_special_tokens=False).

    Texts of Latin letters are encoded by ``tiktoken`` from the same vocabulary as ranks, which is
    three times as fast and gives the same ids there (tested); any other text goes to ``tokenizers``,
    whose Unicode tables decide, and so does a text with a string of an added token, which has its id.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        added = [re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or max(text) <= PLAIN) and not self.added.search(text):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


PIECES = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str | None, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """PIECES rows (and ids binary if asked): each document's ids and end_id, cut at windows.

    part is the task's number, nth counts its pieces of a length; both hold once the rows are written.
    ids are unsigned little-endian numbers of ID_BYTES each, which take half of what integers take.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, seen, task = Encoder(vocabulary, ranks), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for part in ts.pieces(batch, "text"):
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encoder.encode(text or ""), end_id], "<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        for column, x in zip(out, (doc, len(ids), at, len(piece), zlib.crc32(piece.tobytes()), seen[len(piece)], piece), strict=True):
                            column.append(x)
                        seen[len(piece)] += 1
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64()), pa.array([task] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())]
                if with_ids:
                    if any(len(x) and x.max() >= 1 << 8 * ID_BYTES for x in out[6]):
                        raise ValueError("an id does not fit ID_BYTES")
                    columns.append(pa.array([x.astype(ID_TYPE).tobytes() for x in out[6]], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "part", "nth", "ids"][: len(columns)])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none): single, double and triple fillings within SLACK of a window.

    The third length is the largest present that fits; where nothing comes within SLACK of the
    window, each length's best filling is kept, whatever it wastes.
    """
    fit = lambda room: np.where(room < lengths[0], 0, lengths[np.maximum(np.searchsorted(lengths, room, "right") - 1, 0)])
    pairs = np.stack((lengths, fit(window - lengths), np.zeros_like(lengths)), axis=1)
    common = lengths[np.argsort(-counts, kind="stable")[:COMMON]]
    a, b = (x.reshape(-1) for x in np.meshgrid(lengths, common, indexing="ij"))
    ok = a + b < window
    a, b = a[ok], b[ok]
    triples = np.stack((a, b, fit(window - a - b)), axis=1)
    triples = triples[triples.sum(axis=1) >= window - SLACK]
    return np.unique(-np.sort(-np.concatenate((pairs, triples)), axis=1), axis=0)


def solve_nnls(combos: np.ndarray, lengths: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with least squared gap between A x and the histogram (projected gradient
    with momentum; A has at most three entries a column and is never built)."""
    place = np.searchsorted(lengths, combos)
    used = combos > 0
    place = np.where(used, place, 0)
    m, scale = len(lengths), max(counts.max(), 1)
    target = counts / scale
    ahead = lambda x: np.bincount(place[used], weights=np.broadcast_to(x[:, None], combos.shape)[used], minlength=m)
    back = lambda r: np.where(used, r[place], 0.0).sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(12):  # the largest eigenvalue of A'A sets the step
        v = back(ahead(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(ahead(y) - target) / (1.05 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def greedy(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, bins): best fit, largest first. Equal bins are one entry, whatever their number."""
    open_bins: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            insort(rooms, room)
        open_bins[room][lengths] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = min(left, window // length)
                put(window - each * length, (length,) * each, left // each)
                left %= each
                continue
            room = rooms[i]
            lengths, n = open_bins[room].popitem()
            each = min(room // length, left)
            k = min(n, left // each)
            if n > k:
                open_bins[room][lengths] = n - k
            elif not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            put(room - each * length, lengths + (length,) * each, k)
            left -= each * k
    return [(lengths, n) for room in rooms for lengths, n in sorted(open_bins[room].items())]


def plan(histogram: dict[int, int], window: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, bins) that place every length as often as the histogram says."""
    left = Counter({k: v for k, v in histogram.items() if v and k < window})
    out: Counter = Counter()
    if histogram.get(window):
        out[window,] = histogram[window]
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[k] for k in lengths.tolist()], float)
        combos = combinations(lengths, counts, window)
        x = solve_nnls(combos, lengths, counts)
        full = combos.sum(axis=1) >= window - SLACK
        for i in np.argsort(-x, kind="stable").tolist():
            need = Counter([k for k in combos[i].tolist() if k])
            n = min([int(x[i]), *(left[k] // c for k, c in need.items())]) if full[i] else 0
            if n > 0:
                out[tuple(sorted(need.elements(), reverse=True))] += n
                left.subtract({k: n * c for k, c in need.items()})
        for lengths_, n in greedy({k: v for k, v in left.items() if v}, window):
            out[lengths_] += n
    return sorted(out.items(), reverse=True)


def places(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, sequence of it, copies in a sequence, offset of the first copy)]."""
    out: dict[int, list] = {}
    seen: Counter = Counter()
    sequence = 0
    for lengths, n in packed:
        offset = 0
        for length, copies in Counter(lengths).items():  # equal lengths lie side by side
            out.setdefault(length, []).append((seen[length], sequence, copies, offset))
            seen[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def assign(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """A written table of PIECES (and ids), less part and nth, with sequence_id and offset long.

    Only counts of (task, length) are shuffled; a piece's rank among those of its length is its number
    plus the counts of earlier tasks. Equal rows take different places.
    """
    spark = pieces.sparkSession
    counts = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    packed = places(plan(sizes, window))
    where = spark.createDataFrame([(k, [tuple(map(int, p)) for p in packed[k]]) for k in sorted(sizes)], "length int, _places array<struct<first: long, sequence: long, copies: long, offset: long>>")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    after = lambda i: F.get("_places", i + 1)["first"]
    near = F.filter("_places", lambda p, i: (p["first"] < F.col("_before") + F.col("n")) & (F.coalesce(after(i), F.lit(2**62)) > F.col("_before")))
    per = stage(per.join(F.broadcast(where), "length").select("part", "length", "_before", near.alias("_near")), "numbers")
    rows = pieces.join(F.broadcast(per) if per.count() <= NUMBERS else per, ["part", "length"]).withColumn("_rank", F.col("nth") + F.col("_before"))
    rows = rows.withColumn("_p", F.array_max(F.filter("_near", lambda p: p["first"] <= F.col("_rank"))))
    step = F.col("_rank") - F.col("_p.first")
    rows = rows.withColumns({"sequence_id": F.col("_p.sequence") + F.floor(step / F.col("_p.copies")), "offset": F.col("_p.offset") + F.pmod(step, F.col("_p.copies")) * F.col("length")})
    return rows.select(*[c for c in pieces.columns if c not in ("part", "nth")], "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, doc_tokens, start, length, ids_crc32, (ids if asked,) sequence_id, offset.

    A null or empty text is its end id alone. Pieces of a sequence lie side by side from offset 0 and
    fill at most ``window`` ids; each id of a document lies in one piece. Null ids and repeated rows
    are packed like others; an empty table gives no rows; extra columns are ignored.
    """
    return assign(stage(token_pieces(docs, vocabulary, ranks, window, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces"), window)


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids binary of ``window`` ids, pieces): the packed sequences, padded at the end.

    ``packed`` comes from pack() with ids. pieces are structs of offset, length, doc_id, doc_tokens and
    start in order of offset; what lies behind the last one is padding.
    """
    piece = F.struct("offset", F.col("length").cast("long").alias("length"), "doc_id", "doc_tokens", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("_p"))
    ids = F.aggregate("_p", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    padding = F.lit(pad_id.to_bytes(ID_BYTES, "little") * window)
    padded = F.concat(ids, F.substring(padding, F.lit(1), F.lit(window * ID_BYTES) - F.octet_length(ids)))
    return rows.select("sequence_id", padded.alias("ids"), F.transform("_p", lambda p: p.dropFields("ids")).alias("pieces"))


DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def digests(packed: DataFrame, with_ids: bool = False) -> DataFrame:
    """DIGESTS of each piece (and its ids if asked), read back from the sequences that ``sequences`` gave."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, ids, pieces = batch.columns
            length = np.diff(pieces.offsets.to_numpy())
            flat = pieces.flatten()
            offset, size, doc, tokens, start = (flat.field(c) for c in ("offset", "length", "doc_id", "doc_tokens", "start"))
            # All ids of the batch in one array of four bytes each; a piece is a slice of it.
            whole = b"".join(ids.to_pylist())
            data = memoryview(np.frombuffer(whole, ID_TYPE).astype("<u4")).cast("B")
            first = np.cumsum([0, *(len(x) // ID_BYTES for x in ids.to_pylist())])[:-1]
            at = 4 * (np.repeat(first, length) + offset.to_numpy())
            to = at + 4 * size.to_numpy()
            crc = [zlib.crc32(data[i:j]) for i, j in zip(at.tolist(), to.tolist(), strict=True)]
            columns = {"doc_id": doc, "start": start, "length": size, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": tokens, "sequence_id": pa.array(np.repeat(sequence.to_numpy(), length)), "offset": offset}
            if with_ids:
                columns["ids"] = pa.array([whole[i:j] for i, j in zip((at // 4 * ID_BYTES).tolist(), (to // 4 * ID_BYTES).tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return packed.mapInArrow(scan, DIGESTS + ", ids binary" * with_ids)
