"""Structured Streaming operators with keyed state: segment assembly and greedy decoding.

Both need the RocksDB state store and an event-time watermark on ``ts``. A key that stays idle past the
watermark is closed by a timer: its open segment or hypothesis is emitted. Rows later than the watermark
are dropped by Spark and counted in the query's progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEGMENTS = "recording_id string, seg_idx long, start_ms long, end_ms long"
DECODED = "utt_id string, ys array<int>, ts array<int>"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


class _Segments(StatefulProcessor):
    """State: the open segment of a recording and the number of closed ones; a timer clears it, also of finished recordings."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seg_idx long, start_ms long, end_ms long, has boolean, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, start, end, has, timer = self.open.get() if self.open.exists() else (0, -1, -1, False, -1)
        events = pd.concat(list(rows)).sort_values(["chunk", "item"])
        out, final = [], False
        for s, e, last, ts in zip(events["start_ms"], events["end_ms"], events["is_final"], events["ts"]):
            if s == -1:
                if has:
                    end = int(e)
            elif s is not None and not pd.isna(s):
                if has:
                    out.append((key[0], n, start, end))
                    n += 1
                start, end, has = int(s), int(e), True
            final = final or bool(last)
        if final and has:
            out.append((key[0], n, start, end))
            n, has = n + 1, False
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(_millis(events["ts"].max()), timerValues.getCurrentWatermarkInMs()) + self.idle_ms  # after a final chunk too: then it only forgets the key
        self.handle.registerTimer(timer)
        self.open.update((n, start, end, has, timer))
        yield _segments(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, start, end, has, _ = self.open.get() if self.open.exists() else (0, -1, -1, False, -1)
        self.open.clear()
        yield _segments([(key[0], n, start, end)] if has else [])

    def close(self) -> None:
        pass


def _segments(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["recording_id", "seg_idx", "start_ms", "end_ms"])
    frame["end_ms"] = pd.array([None if e == -1 else e for e in frame["end_ms"]], "Int64")
    return frame.astype({"seg_idx": "int64", "start_ms": "int64"})


def stream_segments(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """Segments of a stream (recording_id, chunk, item, start_ms, end_ms, is_final, ts) as they close.

    Equals the batch assembly on a full replay in which every recording has a final chunk.
    """
    rows = events.select(F.col("recording_id").cast("string").alias("recording_id"), "chunk", "item", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "is_final", F.col("ts").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("recording_id").transformWithStateInPandas(_Segments(idle_ms), SEGMENTS, "append", "EventTime")


class _Greedy(StatefulProcessor):
    """State: labels and frame numbers emitted so far, per utterance."""

    def __init__(self, blank: int, idle_ms: int) -> None:
        self.blank, self.idle_ms = blank, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.labels = handle.getListState("labels", "t int, y int")
        self.timer = handle.getValueState("timer", "at long")

    def _finish(self, key) -> Iterator[pd.DataFrame]:
        found = sorted((int(t), int(y)) for t, y in self.labels.get()) if self.labels.exists() else []
        self.labels.clear()
        self.timer.clear()
        yield pd.DataFrame({"utt_id": [key[0]], "ys": [[y for _, y in found]], "ts": [[t for t, _ in found]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, latest = False, timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for t, y in zip(part["t"], part["y"]):
                if y != self.blank:
                    self.labels.appendValue((int(t), int(y)))
            done = done or bool(part["is_final"].any())
            latest = max(latest, _millis(part["ts"].max()))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if done:
            yield from self._finish(key)
        else:
            self.handle.registerTimer(latest + self.idle_ms)
            self.timer.update((latest + self.idle_ms,))
            yield pd.DataFrame({"utt_id": pd.Series([], dtype=object), "ys": pd.Series([], dtype=object), "ts": pd.Series([], dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._finish(key)

    def close(self) -> None:
        pass


def stream_greedy(frames: DataFrame, blank: int = 0, delay: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """Decoded utterances of a stream of frames (utt_id, t, y or logits, is_final, ts) when their frames end.

    Only blanks are dropped. Equals the batch greedy labels with unk = blank on a full replay.
    """
    y = F.col("y") if "y" in frames.columns else F.array_position("logits", F.array_max("logits")) - 1
    rows = frames.select(F.col("utt_id").cast("string").alias("utt_id"), "t", y.cast("int").alias("y"), "is_final", F.col("ts").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("utt_id").transformWithStateInPandas(_Greedy(blank, idle_ms), DECODED, "append", "EventTime")
