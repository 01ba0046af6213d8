"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records, and ends
with a seek table in a skippable frame (the public seekable format). The index maps a record to its
bundle, its frame and its offset in the unpacked frame, so that one record costs one frame.

A record whose payload equals that of a record with a smaller key, and has at least
`min_revisit_bytes` bytes, is a `revisit` of the record with the smallest key: headers only. All
others are `response` records. URLs are written and read back as URIs: characters outside printable
ASCII are percent-encoded. Null payloads count as empty, null URLs are left out; repeated rows
give repeated records under one record identifier (all of them `response` if the key is the
smallest of its payload); a null key never is the smallest one and is read back as null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.sources.staging import pin, shared_dir

FRAME_BYTES = 256_000
BUNDLE_BYTES = 64_000_000

# Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _urn(key) -> str:
    return f"<urn:x-page:{'null' if key is None else key}>"


def _key(urn: str) -> int | None:
    value = urn.strip("<>").rsplit(":", 1)[1]
    return None if value == "null" else int(value)


def record(key, url: str | None, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; with `refers_to` a revisit, which carries HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_urn(key)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record; the payload of a revisit is None."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {data[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"fields": fields, "size": size, "payload": payload if fields["WARC-Type"] == "response" else None}


class BundleWriter:
    """Writes records to one bundle file; `place` is what the index needs."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.fs, self.path = _filesystem(uri)
        self.uri, self.frame_bytes = uri, frame_bytes
        self.out = self.fs.open_output_stream(self.path, compression=None)  # the name must not decide
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frame, self.table, self.size = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the unpacked frame and length of the record."""
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self._flush()
        place = (len(self.table), len(self.frame), len(data))
        self.frame += data
        self.size += len(data)
        return place

    def _flush(self) -> None:
        packed = self.packer.compress(bytes(self.frame))
        self.table.append((len(packed), len(self.frame)))
        self.out.write(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        entries = b"".join(struct.pack("<II", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        self.unpacker = zstandard.ZstdDecompressor()
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        entries = self.file.read_at(8 * count, end - 9 - 8 * count)
        self.starts, at = [], 0
        for packed, size in struct.iter_unpack("<II", entries):
            self.starts.append((at, packed, size))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, size = self.starts[number]
        return self.unpacker.decompress(self.file.read_at(packed, at), max_output_size=size)


def write_archives(pages: DataFrame, root: str | None = None, key: str = "page_id", url: str = "url",
                   payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write all rows as bundles under `root` (by default in the shared folder); the written index:
    key, bundle, frame, offset, length. Each attempt of a task writes files of its own name, and the
    index holds those of the attempts that Spark committed."""
    root = root or f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(
        pages[key].cast("long").alias("key"), pages[url].alias("url"), body.alias("body"),
        F.sha1(body).alias("sha1"), F.length(body).cast("long").alias("size"),
    )
    first = (
        rows.filter(F.col("size") >= min_revisit_bytes).groupBy("sha1", "size").agg(F.min("key").alias("first"))
    )
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    placed = rows.join(first, ["sha1", "size"], "left").select(
        "key", "url", "size", "sha1",
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("body")).alias("body"),
    )

    def write(batches):
        _filesystem(root)[0].create_dir(_filesystem(root)[1], recursive=True)
        writer = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if writer is None:
                    writer = BundleWriter(f"{root}/{uuid.uuid4().hex}.warc.zst")
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                place = writer.add(record(row["key"], row["url"], row["body"], row["size"], digest, row["refers_to"]))
                out.append((row["key"], writer.uri, *place))
                if writer.size >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, _INDEX_TYPES)], names=_INDEX_NAMES
            )
        if writer is not None:
            writer.close()

    return pin(placed.mapInArrow(write, "key long, bundle string, frame int, offset long, length long"), "warc-index")


_INDEX_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
_INDEX_NAMES = ["key", "bundle", "frame", "offset", "length"]


def read_archives(index: DataFrame) -> DataFrame:
    """The records named by `index` (all of it, or the rows of some keys), one row each:
    key, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    places = index.select("bundle", "frame", "offset", "length")

    def read(batches) -> Iterator[pa.RecordBatch]:
        reader, uri, number, frame = None, None, None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bundle"] != uri:
                    reader, uri, number = BundleReader(row["bundle"]), row["bundle"], None
                if row["frame"] != number:
                    frame, number = reader.frame(row["frame"]), row["frame"]
                found = parse_record(frame[row["offset"] : row["offset"] + row["length"]])
                fields, payload = found["fields"], found["payload"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"damaged payload of {fields['WARC-Record-ID']} in {uri}")
                refers = fields.get("WARC-Refers-To")
                out.append((
                    _key(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"),
                    payload, found["size"], digest, fields["WARC-Type"], _key(refers) if refers else None,
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 7, _RECORD_TYPES)], names=_RECORD_NAMES
            )

    return places.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(
        read,
        "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


_RECORD_TYPES = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
_RECORD_NAMES = ["key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
