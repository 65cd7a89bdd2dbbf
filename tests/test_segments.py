import pytest
from pyspark.sql import functions as F

from speechtab.operators import segments as S


def merged(spark, rows, **kw):
    df = spark.createDataFrame([("r", a, b) for a, b in rows], "recording_id string, start_ms long, end_ms long")
    return [(r["start_ms"], r["end_ms"]) for r in S.merge_segments(df, **kw).orderBy("seg_idx").collect()]


def fold(rows, merge=10_000, least=2_000, blank=5_000):
    out, cur = [], None
    for a, b in rows:
        if cur is None:
            cur = [a, b]
        elif cur[1] - cur[0] > merge:
            out.append(tuple(cur))
            cur = [a, b]
        elif a - cur[1] > blank:
            if cur[1] - cur[0] > least:
                out.append(tuple(cur))
            cur = [a, b]
        else:
            cur[1] = b
    if cur and cur[1] - cur[0] > least:
        out.append(tuple(cur))
    return out


@pytest.mark.parametrize("rows, want", [
    ([(0, 10_001), (10_100, 10_200), (10_300, 13_000)], [(0, 10_001), (10_100, 13_000)]),
    ([(0, 10_000), (10_100, 12_300)], [(0, 12_300)]),
    ([(0, 1_500), (6_501, 9_000)], [(6_501, 9_000)]),
    ([(0, 1_500), (6_500, 9_000)], [(0, 9_000)]),
    ([(0, 3_000), (9_000, 11_000)], [(0, 3_000)]),
    ([(0, 2_000)], []),
])
def test_merge_goldens(spark, rows, want):
    assert fold(rows) == want
    assert merged(spark, rows) == want


def test_merge_none_keeps_all(spark):
    assert merged(spark, [(0, 1), (50_000, 50_010)], merge_ms=None) == [(0, 1), (50_000, 50_010)]


@pytest.mark.parametrize("seconds, parts", [(30.0, 1), (30.1, 1), (45.0, 2), (75.0, 2), (105.0, 4)])
def test_split_goldens(spark, seconds, parts):
    df = spark.createDataFrame([("r", 0, 500, 500 + int(seconds * 1000))], "recording_id string, seg_idx long, start_ms long, end_ms long")
    rows = S.split_segments(df).orderBy("part").collect()
    assert len(rows) == parts and rows[0]["start_sample"] == 8_000 and rows[-1]["end_sample"] == 8_000 + int(seconds * 16_000)
    assert all(a["end_sample"] == b["start_sample"] for a, b in zip(rows, rows[1:]))
    assert [r["name"] for r in rows] == [f"0-{i}" for i in range(parts)]


def test_assemble_open_sides(spark):
    e = [("r", 0, 0, 10, -1), ("r", 1, 0, -1, 50), ("r", 1, 1, 60, 70), ("r", 2, 0, 80, -1), ("q", 0, 0, -1, 5), ("q", 1, 0, 7, -1)]
    rows = S.assemble_segments(spark.createDataFrame(e, "recording_id string, chunk int, item int, start_ms long, end_ms long"))
    got = {(r["recording_id"], r["seg_idx"]): (r["start_ms"], r["end_ms"]) for r in rows.collect()}
    assert got == {("r", 0): (10, 50), ("r", 1): (60, 70), ("r", 2): (80, None), ("q", 0): (7, None)}


def test_routing_order(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.1,), (30.0,), (30.1,)], "duration double")
    assert [r["action"] for r in S.route_recordings(df).orderBy("duration").collect()] == ["drop", "drop", "copy", "copy", "segment"]


def test_chunk_plan(spark):
    rows = S.chunk_plan(spark.createDataFrame([("u", 70)], "u string, num_frames long"), 32, 13).orderBy("chunk").collect()
    assert [(r["start"], r["length"]) for r in rows] == [(0, 45), (32, 45), (64, 19)]
    assert S.chunk_plan(spark.createDataFrame([("u", 0)], "u string, num_frames long")).agg(F.count("*")).first()[0] == 0
