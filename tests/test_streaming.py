"""In-order, late within the bound, and too late rows; idle keys are closed by a timer."""

import datetime as dt

import pytest

from speechtab.streaming import stateful

SCHEMA = "recording_id string, chunk int, item int, start_ms long, end_ms long, is_final boolean, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def store(spark):
    spark.conf.set(*stateful.STATE_STORE)
    yield
    spark.conf.unset(stateful.STATE_STORE[0])


def test_segments_with_late_rows(spark, store, tmp_path):
    batches = [
        [("a", 0, 0, 10, -1, False, at(0)), ("b", 0, 0, 5, 9, False, at(0))],
        [("a", 1, 0, -1, 50, False, at(3)), ("c", 0, 0, 1, 2, True, at(30))],  # the watermark moves to minute 20
        [("a", 2, 0, 60, 70, True, at(2)), ("d", 0, 0, 7, 8, True, at(21))],  # a's row is too late, d's within the bound
        [("e", 0, 0, 1, 3, True, at(90))],
        [("e2", 0, 0, 1, 3, True, at(91))],
    ]
    src, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        q = stateful.stream_segments(spark.readStream.schema(SCHEMA).parquet(str(src)), "10 minutes", 600_000)
        run = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(out)).trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted((r["recording_id"], r["seg_idx"], r["start_ms"], r["end_ms"]) for r in spark.read.parquet(str(out)).collect())
    assert ("c", 0, 1, 2) in got and ("d", 0, 7, 8) in got
    assert ("a", 0, 10, 50) in got and ("b", 0, 5, 9) in got  # closed by the idle timer
    assert not any(r[0] == "a" and r[2] == 60 for r in got)


def test_greedy_replay(spark, store, tmp_path):
    rows = [("u", t, y, t == 5, at(t)) for t, y in enumerate([0, 3, 0, 2, 2, 7])] + [("v", 0, 0, True, at(0))]
    schema = "utt_id string, t int, y int, is_final boolean, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stateful.stream_greedy(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    got = {r["utt_id"]: (r["ys"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"u": ([3, 2, 2, 7], [1, 3, 4, 5]), "v": ([], [])}
