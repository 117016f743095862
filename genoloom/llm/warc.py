"""WARC bundles of independent Zstandard frames with a footer seek table.

A bundle is a ``.warc.zst`` file. Its records are grouped into frames of about FRAME bytes, each
compressed on its own; the last frame is a skippable one in the public seekable format: for each
frame its compressed and its plain size, then the number of frames and a magic number. A reader
gets any record with the footer, one seek and one frame. The index maps record identifiers to
bundle, frame and place in the frame. An identifier is ``<urn:page:ID>``, or, if the page's id is
null or not the only one of its kind, ``<urn:page:ID:TASK-NUMBER>``, so no two records share one.

Tasks write a bundle under a name of their own and rename it when whole, so a task that is lost and
run again leaves at most an unnamed file, and only bundles that tasks report are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.hot import join_groups
from genoloom.scratch import new_path, stage

#: Plain bytes of a frame; payloads of fewer bytes are never deduplicated.
FRAME, LEAST = 1 << 20, 100
#: Frames that a reading task gets.
FRAMES_A_TASK = 16
#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

INDEX = "record_id string, bundle string, frame int, offset int, length int"


def urn(page: int | None, nth: str = "") -> str:
    """The identifier of a page's record; nth tells records of one page id apart."""
    return f"<urn:page:{'null' if page is None else page}{':' * bool(nth)}{nth}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None, nth: str = "") -> bytes:
    """A WARC/1.1 response, or (refers given) a revisit, whose HTTP header keeps the full length."""
    name = urn(page, nth)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%")))
    if refers is not None:
        lines += [f"WARC-Refers-To: {urn(refers)}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + head + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, the next record's place) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut")
    return headers, data[stop + 4 : end], end + 4


def fields(headers: dict[str, str], block: bytes) -> dict:
    """What a record says: id, url, payload (None for revisits), full size, digest, type, reference."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    number = lambda x: None if x is None or x.startswith("<urn:page:null") else int(x[10:-1].split(":")[0])
    kind, url = headers["WARC-Type"], headers.get("WARC-Target-URI")
    return {"page_id": number(headers["WARC-Record-ID"]), "url": None if url is None else unquote(url), "payload": payload if kind == "response" else None, "size": size, "digest": headers["WARC-Payload-Digest"].removeprefix("sha256:"), "type": kind, "refers_to": number(headers.get("WARC-Refers-To"))}


class BundleWriter:
    """Frames of records into an open file, then the seek table."""

    def __init__(self, out, frame: int = FRAME, level: int = 3):
        import zstandard

        self.out, self.frame, self.zip = out, frame, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.open, self.length = [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.length and self.length + len(data) > self.frame:
            self.flush()
        place = len(self.sizes), self.length
        self.open.append(data)
        self.length += len(data)
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.out.write(packed)
            self.sizes.append((len(packed), self.length))
            self.open, self.length = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle: any frame by the footer's sums."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", file.read(8 * n))
        self.packed, self.plain, self.start = sizes[::2], sizes[1::2], [0]
        for x in self.packed:
            self.start.append(self.start[-1] + x)

    def read(self, frame: int) -> bytes:
        self.file.seek(self.start[frame])
        return self.unzip.decompress(self.file.read(self.packed[frame]), max_output_size=self.plain[frame])


def store_of(path: str):
    """(file system, place in it) of a path in the shared folder, for tasks that read and write files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to, repeated) of every row.

    Among equal payloads of at least LEAST bytes that with the smallest id (null last) is kept; rows
    with that same id are kept too; the others refer to it. repeated: other rows have the same id.
    Only ids and digests are grouped; a digest that very many rows have is joined by broadcast.
    """
    text = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    ids = stage(rows.select("page_id", "payload_digest", "payload_bytes"), "digests")
    long = ids.where(F.col("payload_bytes") >= LEAST).select("page_id", "payload_digest")
    first = long.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to")).where("n > 1 AND refers_to IS NOT NULL")
    again = join_groups(long, first, ["payload_digest"]).where("page_id IS NULL OR page_id <> refers_to").select("page_id", "payload_digest", "refers_to", F.lit(False).alias("repeated"))
    many = join_groups(ids.select("page_id", "payload_digest"), ids.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["page_id"])
    many = many.select("page_id", "payload_digest", F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("repeated"))
    told = again.unionByName(many).groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("refers_to").alias("refers_to"), F.max("repeated").alias("repeated"))
    out = rows.join(told, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")
    return out.withColumn("repeated", F.coalesce("repeated", F.lit(False)) | F.col("page_id").isNull())


def write_bundles(pages: DataFrame, path: str, **columns: str) -> DataFrame:
    """Write a record per row of ``pages`` into bundles under ``path``; gives the INDEX of records.

    A null payload is empty; a null id is written as such; url is kept (percent-encoded) or null.
    Repeated rows get a record each. Without rows no bundle is written.
    """
    rows = with_revisits(pages, **columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        writer, index = None, []
        for batch in batches:
            for r in batch.to_pylist():
                writer = writer or BundleWriter(store.open_output_stream(f"{folder}/_{name}"))
                nth = f"{TaskContext.get().partitionId()}-{len(index)}" if r["repeated"] else ""
                data = record(r["page_id"], r["url"], r["payload"].encode(), r["payload_bytes"], r["payload_digest"], r["refers_to"], nth)
                index.append((*writer.add(data), len(data), urn(r["page_id"], nth)))
        if writer:
            writer.close()
            store.move(f"{folder}/_{name}", f"{folder}/{name}.warc.zst")
            frame, offset, length, ids = zip(*index, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"{path}/{name}.warc.zst"] * len(ids)), pa.array(frame, pa.int32()), pa.array(offset, pa.int32()), pa.array(length, pa.int32())], names=["record_id", "bundle", "frame", "offset", "length"])

    return stage(rows.mapInArrow(write, INDEX), "warc-index")


READ = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(index: DataFrame, with_html: bool = False) -> DataFrame:
    """READ rows of all records of the bundles in ``index``; a task reads whole frames.

    Digest and size of a response are taken from the payload it holds, and must be what its header
    says; a revisit has those of its header. html is null unless asked for.
    """
    frames = index.groupBy("bundle", "frame").count()
    # A row here is a whole frame, which planners take for a few bytes: deal frames out by number.
    frames = frames.repartition(max(1, -(-frames.count() // FRAMES_A_TASK)), "bundle", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        readers: dict[str, BundleReader] = {}
        for batch in batches:
            for bundle, frame, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle not in readers:
                    store, file = store_of(bundle)
                    readers = {bundle: BundleReader(store.open_input_file(file))}
                data, at, rows = readers[bundle].read(frame), 0, []
                while at < len(data):
                    headers, block, at = parse(data, at)
                    x = fields(headers, block)
                    if x["payload"] is not None and (len(x["payload"]), hashlib.sha256(x["payload"]).hexdigest()) != (x["size"], x["digest"]):
                        raise ValueError(f"record {x['page_id']} of {bundle} is damaged")
                    rows.append({"page_id": x["page_id"], "url": x["url"], "html": x["payload"].decode() if with_html and x["payload"] is not None else None, "payload_bytes": x["size"], "payload_digest": x["digest"], "record_type": x["type"], "refers_to": x["refers_to"]})
                if len(rows) != n:
                    raise ValueError(f"frame {frame} of {bundle} has {len(rows)} records, not {n}")
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return frames.mapInArrow(read, READ)


def fetch(index: DataFrame, record_ids: list[str]) -> dict[str, dict]:
    """The records of these ids, each by one seek and one frame (for a few ids, on the driver).

    ``<urn:page:ID>`` of a page id that several rows have gives all its records, under their own ids.
    """
    out = {}
    plain = F.regexp_replace("record_id", r":[0-9]+-[0-9]+>$", ">")
    for r in index.where(F.col("record_id").isin(record_ids) | plain.isin(record_ids)).collect():
        store, file = store_of(r["bundle"])
        data = BundleReader(store.open_input_file(file)).read(r["frame"])
        out[r["record_id"]] = fields(*parse(data, r["offset"])[:2])
    return out


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` to bundles in the shared folder and read all records back (READ rows)."""
    return read_bundles(write_bundles(pages, new_path(pages.sparkSession, "warc"), **columns))
