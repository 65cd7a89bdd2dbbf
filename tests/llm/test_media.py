import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from speechtab.llm import media


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000))
def test_payload_comes_back(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text.encode())
    assert media.read_png(media.write_png(payload)).tobytes() == payload


def filtered(image, kinds):
    """Reference filtering, sample by sample."""
    rows = []
    for r, kind in enumerate(kinds):
        line = [kind]
        for c in range(image.shape[1]):
            a = int(image[r, c - 1]) if c else 0
            b = int(image[r - 1, c]) if r else 0
            d = int(image[r - 1, c - 1]) if r and c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            line.append((int(image[r, c]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(line)
    return np.array(rows, np.uint8)


def test_all_filters_unfilter():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 19), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).tolist()
    assert (media.unfilter(filtered(image, kinds)) == image).all()


@pytest.mark.parametrize("at", [0, 20, 45, -6])
def test_damage_is_found(at):
    data = bytearray(media.write_png(media.payload_of("some text " * 50)))
    data[at] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(data))


def test_wrong_zlib_data():
    data = media.write_png(media.payload_of("x"))
    body = zlib.compress(bytes(10))
    bad = data[:33] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.read_png(bad)


def test_hash_is_stable_under_small_change():
    text = "the same words again and again in a row " * 200
    a, b, c = (np.unpackbits(np.frombuffer(media.cosine_hash(media.read_png(media.write_png(media.payload_of(t)))), np.uint8)) for t in (text, text[:4000] + "X" + text[4001:], "ZZZZ 99 " * 990))
    assert (a != b).sum() <= 6 < (a != c).sum()


def test_query(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "äöü" * 500, "z"), (3, "äöü" * 500, "z")], "doc_id long, text string, id string")
    rows = media.media_digest(docs).collect()
    assert len(rows) == 4
    for r in rows:
        payload = media.payload_of({1: None, 2: "", 3: "äöü" * 500}[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert len({tuple(r)[1:] for r in rows}) == 2
    assert media.media_digest(docs.limit(0)).count() == 0
