"""Packing by bounded-space online best fit.

Each task packs the pieces of its own texts as they come, those of one batch of about LOOKAHEAD bytes
the longest first. It keeps at most ``bins`` sequences open; a bitset over their free space finds the
fullest one that still takes a piece. Where none does and all are in use, the fullest is closed and a
new one opened. Closed sequences leave the task at once, so no id is shuffled and memory depends on
``bins``, the window and the batch alone.

What a task has open at its end is packed again, the pieces of FAN tasks in one group, until one group
is left: each round moves only what the round before left open, at most ``bins`` sequences a task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm import textscan as ts
from genoloom.llm.packing import ID_BYTES, ID_TYPE, Encoder
from genoloom.scratch import stage

#: Tasks whose open sequences meet in a group of the next round; bits of a sequence's number in its task.
FAN, NUMBER_BITS = 8, 34
#: Bytes of text of which a task knows the pieces before it places them: they fill about half the bins.
LOOKAHEAD = 4 << 20
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
SCHEMA = pa.schema([("sequence_id", pa.int64()), ("task", pa.int32()), ("open", pa.bool_()), ("ids", pa.binary()), ("pieces", pa.list_(PIECE))])
SHAPE = "sequence_id long, task int, open boolean, ids binary, pieces array<struct<doc_id: long, piece: long, start: long, length: long, offset: long>>"


class OpenBins:
    """At most ``most`` open bins of ``window`` places; a bit for each free space that an open bin has."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.used, self.bits = window, most, 0, 0
        self.by_room: list[list[list]] = [[] for _ in range(window + 1)]

    def _take(self, at_least: int) -> tuple[list, int] | None:
        """The open bin with the least free space of ``at_least``, and that space."""
        fits = self.bits >> at_least
        if not fits:
            return None
        room = at_least + (fits & -fits).bit_length() - 1
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            self.bits ^= 1 << room
        self.used -= 1
        return found, room

    def put(self, length: int, item: tuple) -> list[list]:
        """Places an item; the bins that close."""
        closed = []
        held = self._take(length)
        if held is None:
            if self.used == self.most and length < self.window:
                closed.append(self._take(0)[0])
            held = [], self.window
        items, room = held
        items.append(item)
        room -= length
        if room:
            self.by_room[room].append(items)
            self.bits |= 1 << room
            self.used += 1
        else:
            closed.append(items)
        return closed

    def put_all(self, pieces: list[tuple]) -> list[list]:
        """Places pieces (doc, piece, start, ids), the longest first; the bins that close."""
        return [bin_ for p in sorted(pieces, key=lambda p: -len(p[3])) for bin_ in self.put(len(p[3]) // ID_BYTES, p)]

    def rest(self) -> list[list]:
        """All open bins, the fullest first."""
        return [items for bins in self.by_room for items in bins]


def piece_starts(n: int, window: int) -> list[int]:
    """Where the pieces of ``n`` ids begin: the first may be shorter, all others fill a window."""
    return [0, *range((n - 1) % window + 1, n, window)]


class _Numbered:
    """Bins as rows of SCHEMA, numbered from 0 within a task (or group) of a round."""

    def __init__(self, round_: int, task: int):
        self.task, self.next = task, (round_ << 58) | (task << NUMBER_BITS)

    def rows(self, bins: list[list[tuple]], open_: bool) -> pa.RecordBatch:
        pieces = []
        for items in bins:
            at, row = 0, []
            for doc, k, start, ids in items:
                row.append((doc, k, start, len(ids) // ID_BYTES, at))
                at += len(ids) // ID_BYTES
            pieces.append([dict(zip(("doc_id", "piece", "start", "length", "offset"), p, strict=True)) for p in row])
        first, self.next = self.next, self.next + len(bins)
        columns = [pa.array(range(first, self.next), pa.int64()), pa.array([self.task] * len(bins), pa.int32()), pa.array([open_] * len(bins), pa.bool_()), pa.array([b"".join(i[3] for i in items) for items in bins], pa.binary()), pa.array(pieces, pa.list_(PIECE))]
        return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def _packed_by_task(docs: DataFrame, vocabulary: str, ranks: str | None, window: int, bins: int, end_id: int) -> DataFrame:
    """SHAPE rows of documents (doc_id, text): closed sequences, then those open at a task's end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, held, out = Encoder(vocabulary, ranks), OpenBins(window, bins), _Numbered(0, TaskContext.get().partitionId())
        for batch in batches:
            for part in ts.pieces(batch, "text", LOOKAHEAD):
                found = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encoder.encode(text or ""), end_id], "<u4")
                    if ids.max() >= 1 << 8 * ID_BYTES:
                        raise ValueError("an id does not fit ID_BYTES")
                    data, starts = ids.astype(ID_TYPE).tobytes(), piece_starts(len(ids), window)
                    for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        found.append((doc, k, start, data[start * ID_BYTES : end * ID_BYTES]))
                yield out.rows(held.put_all(found), False)
        yield out.rows(held.rest(), True)

    return docs.mapInArrow(scan, SHAPE)


def _packed_again(rest: DataFrame, round_: int, window: int, bins: int, last: bool) -> DataFrame:
    """SHAPE rows of the pieces of open sequences, packed by groups of FAN tasks (at most FAN * bins rows)."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence_id")
        held, out, closed = OpenBins(window, bins), _Numbered(round_, table["task"][0].as_py()), []
        for at in range(0, len(table), max(1, bins // 2)):
            rows = table.slice(at, max(1, bins // 2)).to_pylist()
            of = lambda ids, p: ids[p["offset"] * ID_BYTES : (p["offset"] + p["length"]) * ID_BYTES]
            closed += held.put_all([(p["doc_id"], p["piece"], p["start"], of(r["ids"], p)) for r in rows for p in r["pieces"]])
        return pa.Table.from_batches([out.rows(closed, False), out.rows(held.rest(), not last)])

    return rest.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task").applyInArrow(group, SHAPE)


def pack_online(docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = 2048, bins: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id long, ids binary, pieces array<struct<doc_id, piece, start, length, offset>>).

    ids are the sequence's ids, ID_BYTES each, at most ``window`` of them. A document's ids are those
    of its text and ``end_id``; a longer one than the window is cut into windows, of which the first
    may be shorter. Pieces of a sequence lie side by side from offset 0. A null or empty text is its
    end id alone. Null ids and repeated rows are packed like others; an empty table gives no rows;
    columns beside the two named are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    now, done = stage(_packed_by_task(rows, vocabulary, ranks, window, bins, end_id), "bins"), []
    tasks, round_ = (now.agg(F.max("task")).first()[0] or 0) + 1, 0
    while tasks > 1:
        done.append(now.where("NOT open"))
        tasks, round_ = -(-tasks // FAN), round_ + 1
        now = stage(_packed_again(now.where("open"), round_, window, bins, tasks == 1), "bins")
    return reduce(DataFrame.unionByName, [*done, now]).select("sequence_id", "ids", "pieces")


def digests(packed: DataFrame) -> DataFrame:
    """(doc_id, piece int, start, length, ids_crc32, sequence_id, offset): a row per piece, read back from its
    sequence's ids (as unsigned little-endian 32-bit numbers in the checksum)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, ids, pieces = batch.columns
            wide = [memoryview(np.frombuffer(x, ID_TYPE).astype("<u4")).cast("B") for x in ids.to_pylist()]
            flat = pieces.flatten()
            of = np.repeat(np.arange(len(batch)), np.diff(pieces.offsets.to_numpy()))
            doc, piece, start, length, offset = (flat.field(f.name) for f in PIECE)
            at = 4 * offset.to_numpy()
            to = at + 4 * length.to_numpy()
            crc = [zlib.crc32(wide[k][i:j]) for k, i, j in zip(of.tolist(), at.tolist(), to.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc, piece.cast(pa.int32()), start, length, pa.array(crc, pa.int64()), sequence.take(pa.array(of)), offset], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return packed.mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
