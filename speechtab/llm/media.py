"""Media columns: lossless PNG bytes in a binary column, and cosine-transform hashes of the images.

A payload becomes an 8-bit grey PNG: rows of 64*k samples, one scanline filter chosen for the image by
least absolute differences, zlib data in IDAT chunks, a CRC on every chunk. Reading tests the
signature, every CRC and the zlib checksum, then undoes the filters with numpy (runs of Up and Sub rows
in one cumulative sum; Average and Paeth sample by sample, for images from elsewhere).
The hash resizes the image to 32x32 block means, takes its two-dimensional cosine transform and sets
a bit for each of the 8x8 lowest frequencies above their median.

Null and empty texts become one row of 64 zero samples. Equal texts give equal bytes and hashes.
A stored value that fails a test raises ValueError. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 15
UNIT = 64


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _width(n: int) -> int:
    """Samples in a row: the multiple of 64 that divides n and comes closest to a square image."""
    units = n // UNIT
    k = max(1, round(n**0.5 / UNIT))
    while units % k:
        k -= 1
    return UNIT * k


def write_png(payload: bytes, level: int = 4) -> bytes:
    """PNG of a payload whose length is a positive multiple of 64."""
    width = _width(len(payload))
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    forms = [image, image.copy(), image.copy()]
    forms[1][:, 1:] -= image[:, :-1]
    forms[2][1:] -= image[:-1]
    cost = [int(np.minimum(f, 0 - f).sum(dtype=np.int64)) for f in forms]
    kind = cost.index(min(cost))
    lines = np.empty((len(image), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, forms[kind]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered scanlines (first column: the filter), one byte a pixel."""
    kinds, data = lines[:, 0], lines[:, 1:]
    out = np.empty_like(data)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        kind = kinds[a]
        above = out[a - 1] if a else np.zeros(data.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = data[a:b]
        elif kind == 1:
            np.cumsum(data[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(data[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for r in range(a, b):
                up, left, corner = above.tolist(), 0, 0
                row = []
                for x, u in zip(data[r].tolist(), up):
                    if kind == 3:
                        guess = (left + u) >> 1
                    else:
                        p = left + u - corner
                        da, db, dc = abs(p - left), abs(p - u), abs(p - corner)
                        guess = left if da <= db and da <= dc else u if db <= dc else corner
                    left, corner = (x + guess) & 255, u
                    row.append(left)
                out[r] = above = np.array(row, np.uint8)
        else:
            raise ValueError(f"PNG filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples (rows, columns) of an 8-bit grey, not interlaced PNG; ValueError where a test fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG chunk cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        crc = data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise ValueError(f"PNG chunk {kind!r} fails its CRC")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"PNG data: {e}") from None
    width, height = head[:2]
    if len(raw) != height * (width + 1):
        raise ValueError("PNG data of another size than its header says")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_BASIS = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> bytes:
    """64-bit hash (8 bytes) of the low frequencies of an image."""
    rows, cols = (np.arange(32) * n // 32 for n in image.shape)
    tall, wide = (np.diff(np.append(x, n)) for x, n in zip((rows, cols), image.shape))
    if image.shape[0] >= 32:
        image, tall = np.add.reduceat(image, rows, axis=0, dtype=np.int64), tall[:, None]
    else:
        image, tall = image[rows].astype(np.int64), 1
    if image.shape[1] >= 32:
        image, wide = np.add.reduceat(image, cols, axis=1), wide[None, :]
    else:
        image, wide = image[:, cols], 1
    low = _BASIS @ (image / (tall * wide)) @ _BASIS.T
    return np.packbits(low.ravel() > np.median(low.ravel()[1:])).tobytes()


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (binary): the stored form of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                sizes = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), _binary([write_png(payload_of(t)) for t in texts])], ["id", "n_bytes", "media"])

    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return source.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, phash (binary): from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column(2):
                media = value.as_py()
                image = read_png(media)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
            cols = [list(c) for c in zip(*rows)] or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"]
    source = df.select(df[id_col].alias("id"), df[size_col].alias("n_bytes"), df[media_col].alias("media"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a PNG, read the stored bytes back and report sizes, digests and the hash as hex."""
    read = read_media(encode_media(df, id_col, text_col), id_col)
    return read.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")
