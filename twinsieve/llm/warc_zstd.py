"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``;
frames into bundles of about ``bundle_bytes``.  A bundle ends with two skippable
frames: the record map (record id -> frame, offset within the decompressed frame,
length) and the seek table of the public seekable format (compressed and
decompressed size of every frame, then its footer).  Any Zstandard reader can
decompress a bundle whole; a seeking reader fetches one frame.

Records with equal payloads are stored once: the row with the largest id is the
``response``, the others are ``revisit`` records that refer to it.

Bundles are written by Spark's own committed text writer - one row is one file,
its "line separator" the four magic bytes that end a seek table - so they reach any
file system that Spark can write, a lost task leaves nothing behind, and executors
open no path themselves.  They are read back with the ``binaryFile`` source.

Defined results: null html is an empty payload; null ids are kept (never the
response of a group that has ids; a group without any is all response); rows equal
in id and payload get equal records; control characters of a url are percent-encoded,
a null url has no header; other columns are ignored; no pages, no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch

# Fixed values of the public formats.
SKIP_MAP = 0x184D2A51
SKIP_SEEK = 0x184D2A5E
SEEK_END = b"\xb1\xea\x92\x8f"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # of every record: archives are reproducible


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header (with the full length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records; ``close`` gives the bundle's bytes."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.z, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.raw, self.total, self.map = 0, 0, []

    def add(self, record_id: str, data: bytes) -> None:
        self.map.append(f"{record_id}\t{len(self.sizes)}\t{self.raw}\t{len(data)}")
        self.open.append(data)
        self.raw += len(data)
        if self.raw >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.open:
            frame = self.z.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.raw))
            self.total += len(frame)
            self.open, self.raw = [], 0

    def close(self) -> bytes:
        self._flush()
        names = self.z.compress("\n".join(self.map).encode())
        seek = b"".join(struct.pack("<II", *s) for s in [*self.sizes, (len(names) + 8, 0)])
        footer = struct.pack("<IB", len(self.sizes) + 1, 0) + SEEK_END
        return b"".join([*self.frames, struct.pack("<II", SKIP_MAP, len(names)), names,
                         struct.pack("<II", SKIP_SEEK, len(seek) + len(footer)), seek, footer])


class BundleReader:
    """Random access to a bundle's frames and records through its footer."""

    def __init__(self, data: bytes):
        import zstandard

        self.data, self.z = memoryview(data), zstandard.ZstdDecompressor()
        if bytes(self.data[-4:]) != SEEK_END:
            raise ValueError("no seek table")
        (n,) = struct.unpack("<I", self.data[-9:-5])
        at = len(self.data) - 9 - 8 * n
        self.frames, pos = [], 0
        for i in range(n):
            size, raw = struct.unpack("<II", self.data[at + 8 * i : at + 8 * i + 8])
            self.frames.append((pos, size, raw))
            pos += size
        pos, size, _ = self.frames.pop()  # the record map
        lines = self.z.decompress(self.data[pos + 8 : pos + size]).decode()
        self.records = [(a, int(f), int(o), int(n)) for a, f, o, n in (x.split("\t") for x in lines.split("\n") if x)]

    def frame(self, i: int) -> bytes:
        pos, size, raw = self.frames[i]
        return self.z.decompress(self.data[pos : pos + size], max_output_size=raw)

    def read(self, wanted: set[str] | None = None) -> Iterator[tuple[str, int, int, bytes]]:
        """(record id, frame, offset, record bytes), only the frames that hold a wanted id decompressed."""
        held, body = -1, b""
        for name, i, offset, size in self.records:
            if wanted is None or name in wanted:
                if i != held:
                    held, body = i, self.frame(i)
                yield name, i, offset, body[offset : offset + size]


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers, payload, full payload length) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, length


def decide(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another; narrow rows only."""
    seen = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                        F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).where(F.col("size") >= min_bytes)
    groups = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    groups = scratch.save(groups.select("digest", "refers_to"), "groups")
    # Both sides are shuffled for this join alone: AQE splits a payload that very many pages share.
    return seen.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = 0,
                  frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 23, level: int = 3) -> None:
    """Archive ``pages`` (page_id, url, html) below ``folder``, a folder per bundle."""
    revisits = decide(pages, scratch, min_bytes).withColumnRenamed("page_id", "rid").withColumnRenamed("digest", "rdigest")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("rid")) & (F.sha1("payload") == F.col("rdigest")), "left")
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def bundle(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, out = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes, level)

        def row(b):
            data = b.close()
            return pa.RecordBatch.from_pydict({"bundle": [f"{part:06d}-{n:05d}"], "data": pa.array([data[: -len(SEEK_END)]], pa.binary())})

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                name = page.as_py() if page.is_valid else "null"
                out.add(name, record(name, url.as_py(), payload.as_py(), refers.as_py()))
                if out.total >= bundle_bytes:
                    yield row(out)
                    n, out = n + 1, BundleWriter(frame_bytes, level)
        if out.map:
            yield row(out)

    bundles = rows.mapInArrow(bundle, "bundle string, data binary").select("bundle", F.col("data").cast("string").alias("value"))
    # Each file: one row and, as its line separator, the last bytes of the seek table.
    bundles.write.partitionBy("bundle").option("lineSep", SEEK_END.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)


def _bundles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


SCHEMA = ("bundle string, record_id string, frame int, offset long, length long, record_type string, url string, "
          "payload_digest string, payload_bytes long, refers_to string, payload binary")


def read_records(spark: SparkSession, folder: str, wanted: list[str] | None = None, payloads: bool = True) -> DataFrame:
    """Every record of the bundles (or those of ``wanted`` ids, a given list), with its place and fields."""
    ids = set(wanted) if wanted is not None else None

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for name, frame, offset, data in BundleReader(content.as_buffer()).read(ids):
                    h, payload, length = parse(data)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != length):
                        raise ValueError(f"damaged record {name} in {path}")
                    refers = h.get("WARC-Refers-To", "")[len("<urn:page:") : -1] or None
                    rows.append((path.as_py(), name, frame, offset, len(data), h["WARC-Type"], h.get("WARC-Target-URI"), digest, length, refers,
                                 payload if payloads else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _bundles(spark, folder).mapInArrow(run, SCHEMA)


def archive_and_read(pages: DataFrame, **params) -> DataFrame:
    """Write ``pages`` to bundles in the shared folder and read all records back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("bundles")
    write_bundles(pages, folder, scratch, **params)
    out = read_records(spark, folder, payloads=False)
    kind = pages.schema["page_id"].dataType
    return out.select(F.when(F.col("record_id") != "null", F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                      "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "bundle", "frame", "offset", "length")
