"""WARC records in seekable Zstandard bundles.

Payload digests pick one response per payload (the largest page id); other pages of that payload become
revisit records without a body. A bundle is a run of independent Zstandard frames, each with whole
records, and a footer: the seek table of the Zstandard seekable format in a skippable frame. Beside each
bundle stands the map from record id to (frame, offset in the frame, length), so that one record costs
one frame. Bundles are rows of a Parquet table in the shared folder (binary column, at most about
``BUNDLE_BYTES`` of input each), written by Spark's own committer: a lost task leaves nothing behind.
``export`` gives the bytes of a bundle as a file would hold them.

Null html is an empty payload; payloads shorter than ``min_bytes`` are all responses. Of rows with one page_id the one with the largest payload digest stays,
so that a page has one record. Null page ids are left out. A record whose digest
differs on reading raises ValueError. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import stage

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 8 << 20
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
BUNDLE = "bundle string, data binary, record_id array<long>, frame array<int>, offset array<long>, length array<long>"


def base32_sha1(payload) -> "F.Column":
    """Bare upper-case base32 SHA-1: forty bits at a time in radix 32, then its alphabet."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *B32)


def record(page_id: int, url: str, digest: str, n: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has headers only in its block."""
    kind = "response" if refers_to is None else "revisit"
    block = HEAD + payload if refers_to is None else HEAD
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; ``close`` appends the seek table."""

    def __init__(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.size = self.total = 0
        self.index: list[tuple[int, int, int, int]] = []
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, record_id: int, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size, len(data)))
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            self.frames.append((self.packer.compress(b"".join(self.open)), self.size))
            self.open, self.size = [], 0

    def close(self) -> bytes:
        self.end_frame()
        entries = b"".join(struct.pack("<II", len(data), n) for data, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join([*(data for data, _ in self.frames), struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, place, out = len(bundle) - 9 - n * width, 0, []
    if struct.unpack_from("<II", bundle, at - 8) != (SKIPPABLE, n * width + 9):
        raise ValueError("seek table of another size than its frame says")
    for i in range(n):
        packed, size = struct.unpack_from("<II", bundle, at + i * width)
        out.append((place, packed, size))
        place += packed
    if place != at - 8:
        raise ValueError("frames and seek table differ")
    return out


def read_record(bundle: bytes, table: list[tuple[int, int, int]], frame: int, offset: int, length: int) -> bytes:
    """One record by its frame and its offset there: only that frame is decompressed."""
    place, packed, size = table[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[place : place + packed], max_output_size=size)[offset : offset + length]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:n]


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, n, refers_to (null: response): slim rows, no html."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.select("page_id", base32_sha1(payload).alias("digest"), F.length(payload).cast("long").alias("n"))
    slim = slim.groupBy("page_id").agg(F.max(F.struct("digest", "n")).alias("x")).select("page_id", "x.*")
    slim = stage(slim, "warc-plan")
    first = slim.groupBy("digest").agg(F.max("page_id").alias("original"))
    revisit = (F.col("original") != F.col("page_id")) & (F.col("n") >= min_bytes)
    return slim.join(first, "digest").select("page_id", "digest", "n", F.when(revisit, F.col("original")).alias("refers_to"))


def write_bundles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The bundle table (bundle, data, record_id, frame, offset, length), written to the shared folder."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    roles = plan(pages, min_bytes)
    body = pages.withColumn("digest", base32_sha1(F.coalesce("html", F.lit("")).cast("binary")))
    rows = body.join(roles, ["page_id", "digest"]).select("page_id", F.coalesce("url", F.lit("")).alias("url"), "digest", "n", "refers_to", F.when(F.col("refers_to").isNull(), F.coalesce("html", F.lit(""))).alias("html"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            data = bundle.close()
            ids, frames, offsets, lengths = (list(x) for x in zip(*bundle.index))
            name = hashlib.sha1(data).hexdigest()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            lists = [pa.array([x], pa.list_(k)) for x, k in zip((ids, frames, offsets, lengths), kinds)]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), *lists], ["bundle", "data", "record_id", "frame", "offset", "length"])

        bundle, last = Bundle(), None
        for b in batches:
            for page_id, url, digest, n, refers_to, html in zip(*(c.to_pylist() for c in b.columns)):
                if page_id == last:
                    continue  # a repeated row of the same page and payload
                last = page_id
                bundle.add(page_id, record(page_id, url, digest, n, refers_to, (html or "").encode()))
                if bundle.total >= BUNDLE_BYTES:
                    yield done()
                    bundle = Bundle()
        if bundle.index:
            yield done()

    return stage(rows.sortWithinPartitions("page_id").mapInArrow(pack, BUNDLE), "warc")


def index_of(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length: where each record lies."""
    return bundles.select("bundle", F.explode(F.arrays_zip("record_id", "frame", "offset", "length")).alias("x")).select("x.record_id", "bundle", "x.frame", "x.offset", "x.length")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: each record read by its index entry and tested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, ids, frames, offsets, lengths in zip(*(b.column(i) for i in range(5))):
                data = data.as_py()
                table, at, text, rows = seek_table(data), -1, b"", []
                unpack = zstandard.ZstdDecompressor()
                for record_id, frame, offset, length in zip(ids.as_py(), frames.as_py(), offsets.as_py(), lengths.as_py()):
                    if frame != at:
                        place, packed, size = table[frame]
                        text, at = unpack.decompress(data[place : place + packed], max_output_size=size), frame
                    headers, block = parse(text[offset : offset + length])
                    digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Record-ID"] != f"<urn:page:{record_id}>":
                        raise ValueError("the index names another record")
                    if headers["WARC-Type"] == "response":
                        payload = block[len(HEAD) :]
                        if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"record {record_id} fails its digest")
                    refers = headers.get("WARC-Refers-To")
                    rows.append((record_id, n, digest, headers["WARC-Type"], int(refers[10:-1]) if refers else None))
                cols = [list(x) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return bundles.select("data", "record_id", "frame", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return read_bundles(write_bundles(pages, min_bytes))


ORACLE = """
WITH h AS (SELECT page_id, sha1(coalesce(html, '')) AS x, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, translate(list_aggregate(list_transform([1, 11, 21, 31],
        lambda i: to_base(CAST('0x' || substr(x, i, 10) AS BIGINT), 32, 8)), 'string_agg', ''),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to FROM o
"""
