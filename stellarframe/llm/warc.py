"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent frames, each holding some records, and a skippable frame with the seek table at its
end (the public Zstandard seekable format). Beside each bundle, the index maps a record identifier to its frame and the
offset in the frame, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the seekable format and of WARC.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records in a frame before it is closed, and of a bundle before the next is begun.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20

INDEX = "bundle string, frame int, at long, size long, record_id string"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    """The record's identifier, from its page alone."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}"


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def _block(head: list[str], block: bytes) -> bytes:
    return "\r\n".join([VERSION, *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def info(name: str, date: str) -> bytes:
    """The warcinfo record that opens a bundle."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _block(head, b"software: stellarframe\r\nformat: WARC File Format 1.1\r\n")


def record(key: object, url: str | None, payload: bytes, payload_digest: str, refers_to: object | None, date: str | None = None) -> bytes:
    """One WARC record: a response is an HTTP message with the payload as its body; a revisit names its original and carries no
    block."""
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(key)}>",
        f"WARC-Date: {date or now()}",
        f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Page-ID: {'' if key is None else key}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        return _block([*head, f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"], b"")
    return _block(head, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload)


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record that begins at `at`; a response's payload is the body of its HTTP message."""
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    body = raw.index(b"\r\n\r\n", stop + 4, end) + 4 if head["WARC-Type"] == "response" else stop + 4
    return head, raw[body:end], end + 4


class BundleWriter:
    """Writes records to a file-like sink; close() appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._sink, self._limit, self._level = sink, frame_bytes, level
        self._held: list[bytes] = []
        self._size = 0
        self._frames: list[tuple[int, int]] = []
        self.total = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in the decompressed frame) of the record."""
        if self._held and self._size + len(raw) > self._limit:
            self._flush()
        place = (len(self._frames), self._size)
        self._held.append(raw)
        self._size += len(raw)
        self.total += len(raw)
        return place

    def _flush(self) -> None:
        packed = zstandard.ZstdCompressor(level=self._level).compress(b"".join(self._held))
        self._sink.write(packed)
        self._frames.append((len(packed), self._size))
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self._frames) + struct.pack("<IBI", len(self._frames), 0, SEEKABLE)
        self._sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads frames of a seekable bundle by their number."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * entry)
        raw = source.read(n * entry)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", raw, k * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self._source.seek(at)
        out = zstandard.ZstdDecompressor().decompress(self._source.read(packed), max_output_size=plain)
        if len(out) != plain:
            raise ValueError(f"frame {k}: {len(out)} bytes, {plain} in the seek table")
        return out

    def record(self, frame: int, at: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), at)[:2]


def _open(uri: str):
    """(file system, path) for local, HDFS and object-store locations."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _local(uri: str) -> str:
    return uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write records (page_id, url, payload, refers_to) to bundles in folder; the index of all records (INDEX).

    Each task streams its rows into bundles of about bundle_bytes. A bundle's name is its own, so a task that is run
    again never touches what another wrote; the index, written once, names the bundles that count. All records bear the
    time of the call.
    """
    date = now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        writer = sink = None
        rows: list[tuple] = []
        name = ""

        def close() -> pa.RecordBatch:
            writer.close()
            sink.close()
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bundle", "frame", "at", "size", "record_id"])

        for b in common.slices(batches, 100):
            for row in b.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                    writer.add(info(name, date))
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                raw = record(row["page_id"], row["url"], payload, digest(payload), row["refers_to"], date)
                rows.append((name, *writer.add(raw), len(raw), record_id(row["page_id"])))
                if writer.total >= bundle_bytes:
                    yield close()
                    writer, rows = None, []
        if writer is not None:
            yield close()

    return common.materialise(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warc-index")


READ = "page_key string, payload_bytes long, payload_digest string, record_type string, refers_key string, record_id string, said string"


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the index names, by their frames: identifiers, types and the payloads' bytes and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, reader, source, number, frame = None, None, None, -1, b""
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["bundle"] != name:
                    if source is not None:
                        source.close()
                    name, number = row["bundle"], -1
                    source = fs.open_input_file(f"{root}/{name}")
                    reader = BundleReader(source)
                if row["frame"] != number:
                    number, frame = row["frame"], reader.frame(row["frame"])
                head, payload, _ = parse(frame, row["at"])
                if head["WARC-Record-ID"] != f"<{row['record_id']}>":
                    raise ValueError(f"{name}: another record at frame {number}, offset {row['at']}")
                said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                full = head["WARC-Type"] == "response"
                if full and digest(payload) != said:
                    raise ValueError(f"{name}: payload of {row['record_id']} does not match its digest")
                out.append((head["X-Page-ID"] or None, len(payload) if full else None, said, head["WARC-Type"], head.get("X-Refers-To-Page-ID"), row["record_id"], said))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), *[pa.string()] * 5)
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        if source is not None:
            source.close()

    n = common.shuffle_partitions(index.sparkSession)
    ordered = index.repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return ordered.mapInArrow(run, READ)


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) and refers_to: of equal payloads of least_bytes or more, the page with the smallest id.

    refers_to is null for that page itself and for smaller payloads. Equal payloads are found by their SHA-1; the
    smallest id is a partial aggregate, so very common payloads gather nowhere.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html").withColumn("_sha", F.unhex(F.sha1(html.cast("binary"))))
    first = keyed.where(F.octet_length(html) >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.where("_n > 1").select("_sha", "_first")
    other = keyed.select("page_id", "_sha").join(first, "_sha").where(F.col("page_id") != F.col("_first")).select("page_id", "_sha", F.col("_first").alias("refers_to")).distinct()
    return keyed.join(other, ["page_id", "_sha"], "left").select("page_id", "url", "html", "refers_to")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages to bundles and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    payload_bytes and payload_digest are of the full payload, which a revisit has through the record it refers to. Null
    html is an empty payload. Rows with the smallest id of equal payloads are responses, repeated rows too; rows with
    a null id are responses of their own. Other columns are ignored; an empty table gives no rows. folder is in the shared
    folder unless given.
    """
    spark: SparkSession = pages.sparkSession
    common.arrow_rows(spark)
    folder = _local(folder or common.scratch_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    index = write_bundles(with_originals(pages, least_bytes), folder)
    back = common.materialise(read_bundles(index, folder), "warc-read")
    sizes = back.where("record_type = 'response' and page_key is not null").select(F.col("page_key").alias("refers_key"), F.col("said"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = back.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_key", "said"], "left").withColumnRenamed("_bytes", "payload_bytes")
    every = back.where("record_type = 'response'").unionByName(revisits)
    return every.select(F.col("page_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast(kind).alias("refers_to"))
