"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with a group of whole WARC records, and a
seek table in a skippable frame at the end. The index maps a record id to its bundle, its frame and
its offset inside the unpacked frame, so one record is read by unpacking one frame. Bundles are
written by the tasks straight to the shared folder under a name of their own attempt; the index
names only bundles of attempts that ended well, so a lost executor leaves nothing but an unused file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaycohorts.session import checkpoint_dir, materialize

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
MIN_PAYLOAD = 100
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, kind: str, refers_to: int | None, url: str | None, size: int, digest: str, payload: bytes) -> bytes:
    """One WARC record; header values are percent-coded where they hold line ends."""
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html"]
    if url is None:
        head.remove("WARC-Target-URI: ")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: memoryview | bytes) -> dict:
    """Fields of one record."""
    data = bytes(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name][10:-1]) if len(fields.get(name, "")) > 11 else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"][7:], "payload": rest[: int(fields["Content-Length"])],
    }


class Bundle:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, folder: str) -> None:
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = where.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.size, self.pending, self.fill = 0, [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        at = (len(self.frames), self.fill)
        self.pending.append(data)
        self.fill += len(data)
        if self.fill >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.fill))
            self.size += len(packed)
            self.pending, self.fill = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle through its seek table; keeps the last frame unpacked."""

    def __init__(self, uri: str) -> None:
        where, path = _open(uri)
        self.file = where.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(end - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", self.file.read(8 * count)))
        self.at = [0]
        for packed, _ in sizes:
            self.at.append(self.at[-1] + packed)
        self.sizes, self.last, self.data = sizes, -1, b""

    def frame(self, number: int) -> memoryview:
        if number != self.last:
            self.file.seek(self.at[number])
            self.data = zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[number][0]), max_output_size=self.sizes[number][1])
            self.last = number
        return memoryview(self.data)

    def close(self) -> None:
        self.file.close()


def mark_revisits(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` plus payload size, digest and, for copies, the page they refer to."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    pages = pages.withColumn("payload", payload).withColumns({"payload_bytes": F.length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    copies = (
        pages.where(F.col("payload_bytes") >= MIN_PAYLOAD).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    out = pages.join(copies, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("record_type", F.when(again, "revisit").otherwise("response")).drop("first")


def write_bundles(marked: DataFrame, folder: str) -> DataFrame:
    """Write every row as one record; returns the index, already stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            cols = {k: batch.column(k) for k in batch.schema.names}
            rows = []
            for i in range(batch.num_rows):
                v = {k: c[i].as_py() for k, c in cols.items()}
                if bundle is None:
                    bundle = Bundle(folder)
                body = b"" if v["record_type"] == "revisit" else v["payload"]
                data = record(v["page_id"], v["record_type"], v["refers_to"], v["url"], v["payload_bytes"], v["payload_digest"], body)
                frame, offset = bundle.add(data)
                rows.append({"page_id": v["page_id"], "bundle": f"{folder}/{bundle.name}", "frame": frame, "offset": offset, "length": len(data)})
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        if bundle is not None:
            bundle.close()

    wanted = marked.select(F.col("page_id").cast("long"), "record_type", F.col("refers_to").cast("long"), F.col("url").cast("string"), "payload_bytes", "payload_digest", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))
    return materialize(wanted.mapInArrow(write, INDEX))


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, frame by frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            rows, size = [], 0
            for v in batch.to_pylist():
                if v["bundle"] != name:
                    if reader:
                        reader.close()
                    name, reader = v["bundle"], BundleReader(v["bundle"])
                found = parse(reader.frame(v["frame"])[v["offset"] : v["offset"] + v["length"]])
                if found["page_id"] != v["page_id"]:
                    raise ValueError(f"index and bundle differ at page {v['page_id']}")
                if found["record_type"] == "response" and hashlib.sha256(found["payload"]).hexdigest() != found["payload_digest"]:
                    raise ValueError(f"payload of page {v['page_id']} is damaged")
                rows.append(found)
                size += len(found["payload"])
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
        if reader:
            reader.close()

    return index.mapInArrow(read, RECORD)


_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def archive(pages: DataFrame, folder: str | None = None, html: str = "html") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles and return their index.

    A null html is an empty payload, a null url leaves the header out, a null page_id is stored
    without a number. Equal payloads of at least 100 bytes are stored once, at the smallest page_id;
    rows that repeat that page_id are responses too. An empty table writes nothing. Other columns
    are not archived.
    """
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return write_bundles(mark_revisits(pages.select("page_id", "url", F.col(html).alias("html"))), folder)


def digest_rows(pages: DataFrame) -> DataFrame:
    return read_records(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
