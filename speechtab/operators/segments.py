"""Voice-activity segments in milliseconds: assembling, merging, splitting, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.operators.scan import segmented_scan


def assemble_segments(events: DataFrame) -> DataFrame:
    """(recording_id, seg_idx, start_ms, end_ms) of chunk events (recording_id, chunk, item, start_ms, end_ms).

    A start of -1 gives the end of the segment left open before; every other item is a segment, of
    which an end of -1 is not yet known (null if it never comes).
    """
    key = W.partitionBy("recording_id").orderBy("chunk", "item")
    opened = events.withColumn("seg_idx", F.sum(F.when(F.col("start_ms") != -1, 1).otherwise(0)).over(key.rowsBetween(W.unboundedPreceding, 0)) - 1)
    start = F.max(F.when(F.col("start_ms") != -1, F.col("start_ms")))
    end = F.max_by("end_ms", F.struct("chunk", "item"))
    rows = opened.where("seg_idx >= 0").groupBy("recording_id", "seg_idx").agg(start.alias("start_ms"), end.alias("end_ms"))
    return rows.withColumn("end_ms", F.when(F.col("end_ms") != -1, F.col("end_ms"))).withColumn("seg_idx", F.col("seg_idx").cast("long"))


class Merge:
    """The greedy merge as a fold; the state is the open segment (none: -1 as its number)."""

    start = (-1, 0, 0)

    def __init__(self, merge_ms: int, min_ms: int, blank_ms: int):
        self.merge_ms, self.min_ms, self.blank_ms = merge_ms, min_ms, blank_ms

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        none, s, e = state
        start, end = row
        if none == -1:
            return (0, start, end), []
        if e - s > self.merge_ms:
            return (0, start, end), [(s, e)]
        if start - e > self.blank_ms:
            return (0, start, end), self.finish(state)
        return (0, s, end), []

    def finish(self, state: tuple) -> list[tuple]:
        _, s, e = state
        return [(s, e)] if e - s > self.min_ms else []


def merge_segments(df: DataFrame, merge_ms: int | None = 10_000, min_ms: int = 2_000, blank_ms: int = 5_000) -> DataFrame:
    """Greedy merge per recording, a fold over its segments in order, whatever their number.

    A segment longer than ``merge_ms`` is closed whatever its length; one before a gap over ``blank_ms``
    is closed, and kept only if longer than ``min_ms``; else the next extends it. The last is kept
    only if longer than ``min_ms``. Without ``merge_ms`` segments stay as they are. Segments without a start or an end are left out; a null recording is one of its own;
    an empty table gives no rows.
    """
    if merge_ms is None:
        return df.select("recording_id", (F.row_number().over(W.partitionBy("recording_id").orderBy("start_ms", "end_ms")) - 1).cast("long").alias("seg_idx"), "start_ms", "end_ms")
    rows = df.select("recording_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")).where("start_ms is not null and end_ms is not null")
    merged = segmented_scan(rows, "recording_id", ["start_ms", "end_ms"], ["start_ms", "end_ms"], Merge(merge_ms, min_ms, blank_ms), "start_ms long, end_ms long", "seg_idx")
    return merged.select("recording_id", "seg_idx", "start_ms", "end_ms")


def split_segments(df: DataFrame, max_s: float = 30.0, rate: int = 16_000) -> DataFrame:
    """Parts (seg_idx, part, name i-j, start and end sample) of equal length of segments longer than ``max_s``; others whole."""
    size = int(max_s * rate)
    a, b = (F.floor(F.col(c) * rate / 1000).cast("long") for c in ("start_ms", "end_ms"))
    rows = df.withColumn("a", a).withColumn("b", b)
    n = F.bround((F.col("b") - F.col("a")) / size)
    step = F.when(F.col("b") - F.col("a") > size, F.ceil((F.col("b") - F.col("a")) / n)).otherwise(F.greatest(F.col("b") - F.col("a"), F.lit(1))).cast("long")
    rows = rows.withColumn("step", step).where("b > a").withColumn("lo", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.col("step"))))
    part = ((F.col("lo") - F.col("a")) / F.col("step")).cast("long")
    return rows.select("recording_id", "seg_idx", part.alias("part"), F.concat_ws("-", "seg_idx", part).alias("name"), F.col("lo").alias("start_sample"), F.least(F.col("lo") + F.col("step"), "b").alias("end_sample"))


def route_recordings(df: DataFrame, min_s: float = 2.0, max_s: float = 30.0) -> DataFrame:
    """``df`` with ``action``: copy whole (up to max), dropped among those at most min, else segment."""
    return df.withColumn("action", F.when(F.col("duration") <= max_s, F.when(F.col("duration") <= min_s, "drop").otherwise("copy")).otherwise("segment"))


def align_to_frames(cuts: DataFrame, frame_shift: float = 0.01) -> DataFrame:
    """(cut_id, words, starts, ends): word alignments as frame numbers, halves to even, in order."""
    from speechtab.functions.text import to_frames

    word = cuts.select("cut_id", F.posexplode("supervisions").alias("s_idx", "s")).select("cut_id", "s_idx", F.posexplode(F.col("s.alignment")["word"]).alias("w_idx", "w"))
    item = F.struct("s_idx", "w_idx", F.col("w.symbol").alias("word"), to_frames(F.col("w.start"), frame_shift).alias("start"), to_frames(F.col("w.end"), frame_shift).alias("end"))
    lists = word.groupBy("cut_id").agg(F.array_sort(F.collect_list(item)).alias("v"))
    return lists.select("cut_id", F.col("v.word").alias("words"), F.col("v.start").alias("starts"), F.col("v.end").alias("ends"))


def chunk_plan(df: DataFrame, size: int = 32, pad: int = 13, frames: str = "num_frames") -> DataFrame:
    """(id columns, chunk, start, length): chunks that advance by ``size`` and read ``size + pad``; the last is short."""
    total = F.col(frames) + pad
    rows = df.where(F.col(frames) > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), (total - 1).cast("long"), F.lit(size).cast("long"))))
    return rows.withColumn("chunk", (F.col("start") / size).cast("long")).withColumn("length", F.least(total - F.col("start"), F.lit(size + pad)).cast("long"))
