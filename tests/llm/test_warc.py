import base64
import hashlib

import pytest

from speechtab.llm import warc
from speechtab.llm.queries import op6_warc


def test_equals_sql(same):
    same(op6_warc, warc.ORACLE)


def test_one_record_by_its_index_entry(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bundles = warc.write_bundles(pages)
    data = {r["bundle"]: r["data"] for r in bundles.collect()}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    seen = 0
    for r in warc.index_of(bundles).collect():
        bundle = data[r["bundle"]]
        headers, block = warc.parse(warc.read_record(bundle, warc.seek_table(bundle), r["frame"], r["offset"], r["length"]))
        digest = base64.b32encode(hashlib.sha1((html[r["record_id"]] or "").encode()).digest()).decode()
        assert headers["WARC-Payload-Digest"] == f"sha1:{digest}"
        if headers["WARC-Type"] == "response":
            assert block == warc.HEAD + (html[r["record_id"]] or "").encode()
            seen += 1
    assert 0 < seen <= len(html)


def test_frames_are_independent_and_tested():
    b = warc.Bundle()
    for i in range(40):
        b.add(i, warc.record(i, "http://x", "D", 30_000, None, bytes([i]) * 30_000))
    data = b.close()
    table = warc.seek_table(data)
    assert len(table) > 3
    record_id, frame, offset, length = b.index[25]
    assert warc.parse(warc.read_record(data, table, frame, offset, length))[1][-1] == 25 == record_id
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1])


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "ß" * 400_000), (4, "u", "ß" * 400_000), (4, "u", "ß" * 400_000), (None, "u", "x"), (5, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "3 as refers_to")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (0, "revisit", 2), 2: (0, "response", None), 3: (800_000, "revisit", 4), 4: (800_000, "response", None), 5: (1, "response", None)}
    assert warc.round_trip(pages, min_bytes=1).where("page_id = 1").first()["record_type"] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0
