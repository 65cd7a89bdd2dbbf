"""Batches, crops, pads, label alignment, masks and packing plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab.session import staged


def sort_by_duration(df: DataFrame, key: str = "cut_id") -> DataFrame:
    return df.orderBy(F.desc("duration"), key)


#: Rows of a part of the order: what one task folds.
LANE_ROWS = 1 << 16


def seeded(key: str, *salt: object) -> Column:
    """A hash of an id and a salt in 0..2^32 - 1 that any engine with md5 repeats."""
    text = F.concat_ws(":", F.col(key).cast("string"), *[F.lit(str(s)) if not isinstance(s, Column) else s.cast("string") for s in salt])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def simple_batches(df: DataFrame, max_duration: float, order: list[str], lanes: int = 1, key: str = "cut_id") -> DataFrame:
    """``df`` with lane, batch_id: consecutive rows of a lane (hash of the id) up to a pooled duration.

    However long a lane is, it is folded by parts of about ``LANE_ROWS`` rows. Null durations count as 0, negative ones are refused where they matter; a row longer than the limit
    is a batch of its own. Ties in ``order`` should be broken by it. Empty tables give no batches.
    """
    return _fold(df.withColumn("lane", F.pmod(seeded(key, "lane"), F.lit(lanes)).cast("long")), max_duration, order)


class Entries:
    """A part's fold for every state that may come in: the rows at which the first new batch may begin, and for each the state at the part's end.

    Without an incoming total the first reset comes last, so only the rows up to it can be the first to reset, and of these only those that add something. Chains that reset
    at the same row are one from there on.
    """

    def __init__(self, most: float):
        self.most, self.slow, self.closed = most, 0.0, False
        self.durations: list[float] = []  # of the rows that may be the first to reset
        self.chains: list[list] = []  # total, number, and for each such row in it: place, batches ahead of the number

    def step(self, d: float, after_long: bool) -> None:
        met = []
        for c in self.chains:
            if c[0] > 0 and c[0] + d > self.most:
                c[0], c[1] = 0.0, c[1] + 1
                met.append(c)
            c[0] += d
        if not self.closed and (d != 0 or after_long or not self.durations):
            met.append([0.0 + d, 1, [(len(self.durations), 0)]])
            self.chains.append(met[-1])
            self.durations.append(d)
            self.closed = self.slow > 0 and self.slow + d > self.most
            self.slow += d
        for c in met[1:]:
            met[0][2] += [(i, ahead + c[1] - met[0][1]) for i, ahead in c[2]]
        if len(met) > 1:
            gone = {id(c) for c in met[1:]}
            self.chains = [c for c in self.chains if id(c) not in gone]

    def ends(self) -> tuple[list[int], list[float]]:
        """Batches begun and the open batch's total at the end, by the row that was the first to reset."""
        at = sorted((i, c[1] + ahead, c[0]) for c in self.chains for i, ahead in c[2])
        return [n for _, n, _ in at], [t for _, _, t in at]


def _left(part, number: int, total: float, most: float) -> tuple[int, float]:
    """The state that a part of one lane leaves to the next, given the one that comes in."""
    for i, d in enumerate(part["durations"]):
        if total > 0 and total + d > most:
            return number + part["begun"][i], part["totals"][i]
        total += d
    if part["closed"]:
        raise ValueError("batches need durations of at least 0")
    return number, total


def _fold(rows: DataFrame, max_duration: float, order: list[str]) -> DataFrame:
    """Resetting running sums per lane over range-sorted parts: a lane's rows never sit together in memory, nor in one task.

    A first pass sums each part up for every state that may come in (``Entries``, about a batch's rows for each part), the driver goes from border to border, and a second pass numbers the batches.
    """
    by = ["lane", *order, "duration"]
    cut = staged(rows.repartitionByRange(max(1, -(-rows.count() // LANE_ROWS)), *by).withColumn("__part", F.spark_partition_id()))
    placed = cut.repartition("__part").sortWithinPartitions("__part", *by)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = lane = entries = None
        total, number, before = 0.0, 0, 0.0

        def done() -> pd.DataFrame:
            begun, totals = entries.ends() if entries else ([], [])
            one = {"part": part, "first": first, "last": lane, "whole": entries is not None, "closed": bool(entries and entries.closed), "number": number, "total": total}
            return pd.DataFrame([one | {"durations": entries.durations if entries else [], "begun": begun, "totals": totals}])

        for b in batches:
            for p, own, d in zip(b["__part"].tolist(), b["lane"].tolist(), b["duration"].fillna(0.0).tolist()):
                if p != part:
                    if part is not None:
                        yield done()
                    part, first, lane, entries = p, own, own, Entries(max_duration)
                if own != lane:
                    lane, entries, total, number = own, None, 0.0, 0
                if entries:
                    entries.step(d, before > max_duration)
                else:
                    if total > 0 and total + d > max_duration:
                        number, total = number + 1, 0.0
                    total += d
                before = d
        if part is not None:
            yield done()

    border = placed.select("__part", "lane", F.col("duration").cast("double").alias("duration")).mapInPandas(summed, "part int, first long, last long, whole boolean, closed boolean, number long, total double, durations array<double>, begun array<long>, totals array<double>")
    incoming: dict[int, tuple[int, float]] = {}
    last, state = None, (0, 0.0)
    for r in sorted(border.collect(), key=lambda r: r["part"]):  # a row a part
        if r["first"] == last:
            incoming[r["part"]] = state
        state = _left(r, *incoming.get(r["part"], (0, 0.0)), max_duration) if r["whole"] else (r["number"], r["total"])
        last = r["last"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = lane = None
        total, number = 0.0, 0
        for b in batches:
            ids = []
            for p, own, d in zip(b["__part"].tolist(), b["lane"].tolist(), b["duration"].fillna(0.0).tolist()):
                if p != part:
                    part, lane = p, own if p in incoming else None
                    number, total = incoming.get(p, (0, 0.0))
                if own != lane:
                    lane, total, number = own, 0.0, 0
                elif total > 0 and total + d > max_duration:
                    number, total = number + 1, 0.0
                total += d
                ids.append(f"{lane}-{number}")
            yield b.drop(columns="__part").assign(batch_id=ids)

    return placed.mapInPandas(run, rows.withColumn("batch_id", F.lit("")).schema)


def quantile_edges(df: DataFrame, value: str, parts: int) -> list[float]:
    """The exact 1/parts, 2/parts, ... quantiles of the values that are not null: the least value with at least that share of rows up to it.

    Distinct values are counted and sorted by range; each range's counts are summed up within it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts = staged(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row a range
    rows = sum(r["n"] for r in sizes)
    if not rows:
        return []
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, start long"))
    upto = F.col("start") + F.sum("n").over(W.partitionBy("part").orderBy("v"))
    places = counts.join(start, "part").withColumn("upto", upto)
    return list(places.agg(*[F.min(F.when(F.col("upto") >= -(-rows * i // parts), F.col("v"))).alias(f"q{i}") for i in range(1, parts)]).first()) if parts > 1 else []


def bucket_batches(df: DataFrame, buckets: int = 30, max_duration: float = 600.0, seed: int = 0, epoch: int = 0, drop_last: bool = True, key: str = "cut_id") -> DataFrame:
    """``df`` with bucket (equal-count duration quantiles), lane and batch_id; order within a bucket by seeded hash.

    A bucket is one lane, 2 * bucket, folded by parts as in ``simple_batches``. ``drop_last``: of each bucket its one last batch goes, unless it is full (a further row as long as its longest
    would not fit). Null durations count as 0 and are in the first bucket. Empty tables give no batches.
    """
    edges = sorted(set(quantile_edges(df, "duration", buckets)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda e: e < F.col("duration"))) if edges else F.lit(0)
    rows = df.withColumn("bucket", F.greatest(bucket, F.lit(0)).cast("long")).withColumn("__o", seeded(key, seed, epoch)).withColumn("lane", F.col("bucket") * 2)
    out = _fold(rows, max_duration, ["__o", key]).drop("__o")
    if not drop_last:
        return out
    out = staged(out)
    number, d = F.split("batch_id", "-")[1].cast("long"), F.coalesce("duration", F.lit(0.0))
    last = out.groupBy("lane").agg(F.max(number).alias("__last"))  # a row a bucket
    ends = out.join(F.broadcast(last), "lane").where(number == F.col("__last")).groupBy("lane", "batch_id").agg(F.sum(d).alias("__total"), F.max(d).alias("__longest"))
    gone = ends.where(F.col("__total") + F.col("__longest") <= max_duration).select("lane", "batch_id")
    return out.join(F.broadcast(gone), ["lane", "batch_id"], "left_anti").select(out.columns)


def pessimistic_batches(batches: DataFrame) -> DataFrame:
    """criterion, batch_id, value: the batch of largest total, of most rows and with the longest row; ties to the smaller id."""
    per = batches.groupBy("batch_id").agg(F.sum("duration").alias("total"), F.count("*").cast("double").alias("rows"), F.max("duration").alias("longest"))
    criteria = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.round(F.col(c), 6).alias("value")) for c in ("total", "rows", "longest")]))
    rank = F.row_number().over(W.partitionBy("criterion").orderBy(F.desc("value"), "batch_id"))
    return per.select("batch_id", criteria.alias("x")).select("batch_id", "x.*").withColumn("r", rank).where("r = 1").select("criterion", "batch_id", "value")


def pad_edges(frames: Column, target: Column) -> Column:
    """An array of at least ``target`` items: half of what lacks (the smaller half) stands before as copies of the first item, the rest behind as copies of the last.

    Longer arrays stay; null and empty ones have nothing to repeat and stay too.
    """
    lack = F.greatest(target - F.size(frames), F.lit(0)).cast("int")
    left = F.floor(lack / 2).cast("int")
    padded = F.concat(F.array_repeat(F.get(frames, F.lit(0)), left), frames, F.array_repeat(F.element_at(frames, -1), lack - left))
    return F.when(F.size(frames) > 0, padded).otherwise(frames)


def collate(batches: DataFrame, pad: bool = False, cap: int = 10_000, seed: int | None = None, key: str = "cut_id", edge: bool = False) -> DataFrame:
    """(batch_id, key, size, start, length, padding) and, given ``feats``, the cropped and padded arrays.

    The batch's size is its least (or, with ``pad``, largest) length, capped; longer rows are cropped at a
    seeded start (0 without seed), shorter ones padded with zeros that the mask marks. With ``edge`` they are padded as ``pad_edges`` does it: on both sides, by their own first
    and last frames, which the mask does not mark.
    """
    w = W.partitionBy("batch_id")
    size = F.least((F.max if pad else F.min)("num_frames").over(w), F.lit(cap)).cast("long")
    rows = batches.withColumn("size", size)
    over = F.greatest(F.col("num_frames") - F.col("size"), F.lit(0))
    start = F.pmod(F.xxhash64(key, F.lit(seed)), over + 1) if seed is not None else F.lit(0)
    rows = rows.withColumn("start", F.when(over > 0, start).otherwise(0).cast("long")).withColumn("length", F.least("num_frames", "size").cast("long")).withColumn("padding", F.col("size") - F.col("length"))
    if "feats" in batches.columns:
        kept = F.slice("feats", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
        rows = rows.withColumn("feats", kept)
        own, more = F.col("length").cast("int"), F.col("padding").cast("int")
        if edge:
            return rows.withColumn("feats", pad_edges(F.col("feats"), F.col("size"))).withColumn("mask", F.array_repeat(F.lit(False), F.col("size").cast("int")))
        filler = F.transform(F.col("feats")[0], lambda x: x * 0)
        rows = rows.withColumn("feats", F.concat("feats", F.array_repeat(filler, more))).withColumn("mask", F.concat(F.array_repeat(F.lit(False), own), F.array_repeat(F.lit(True), more)))
    return rows


def collate_labels(batches: DataFrame, ratio: float, classes: int, pad: bool = False) -> DataFrame:
    """``collate``d rows with labels cut from ``start * ratio``, to the batch's shortest remainder (unless ``pad``), and padded with the last class."""
    first = F.bround(F.col("start") * ratio).cast("int")
    want = F.bround(F.col("size") * ratio).cast("int")
    rows = batches.withColumn("__s", first).withColumn("__rest", F.size("labels") - F.col("__s"))
    w = W.partitionBy("batch_id")
    rows = rows.withColumn("__n", want if pad else F.least(want, F.min("__rest").over(w)))
    cut = F.slice("labels", F.col("__s") + 1, F.greatest("__n", F.lit(0)))
    rows = rows.withColumn("labels", cut).withColumn("__w", F.max(F.size("labels")).over(w))
    padded = F.concat("labels", F.array_repeat(F.lit(classes - 1).cast(batches.schema["labels"].dataType.elementType), F.col("__w") - F.size("labels")))
    return rows.withColumn("label_length", F.size("labels").cast("long")).withColumn("labels", padded).drop("__s", "__rest", "__n", "__w")


def resample_labels(df: DataFrame, ratio: float, frames: str = "num_frames", size: str | None = None, mask_rate: float | None = None) -> DataFrame:
    """``df`` with one label per feature frame, the one at floor(i * ratio); frames without labels go.

    With ``size`` (a batch's padded length, in frames) also ``mask``: true at each frame past the row's own. With ``mask_rate`` a column ``mask`` is read at floor(i * mask_rate).
    Null labels give none; frames whose mask is missing get null.
    """
    t = F.when(F.col(frames) * ratio > F.size("labels"), F.floor(F.size("labels") / ratio)).otherwise(F.col(frames)).cast("int")
    steps = F.when(t > 0, F.sequence(F.lit(0), t - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("num_frames", t.cast("long")).withColumn("labels", F.transform(steps, lambda i: F.get("labels", F.floor(i * ratio).cast("int"))))
    if mask_rate is not None:
        places = F.when(F.size("labels") > 0, F.sequence(F.lit(0), F.greatest(F.size("labels") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return rows.withColumn("mask", F.transform(places, lambda i: F.get("mask", F.floor(i * mask_rate).cast("int"))))
    if size is None:
        return rows
    own = F.least("num_frames", F.col(size)).cast("int")
    return rows.withColumn("mask", F.concat(F.array_repeat(F.lit(False), own), F.array_repeat(F.lit(True), F.col(size).cast("int") - own)))


def shrink_mask(mask: Column, to: Column) -> Column:
    """A padding mask at the rate of ``to`` feature frames: what does not divide is cut off the end, then each group of equal size is true where all of it is.

    Each item is read once. A mask shorter than ``to`` leaves empty groups, which are true; ``to`` of 0 gives none; a null mask stays null.
    """
    to = to.cast("int")

    def shrunk(m: Column) -> Column:
        group = F.floor(F.size(m) / to).cast("int")
        whole = lambda i: F.forall(F.transform(F.sequence(F.lit(0), group - 1), lambda j: F.get(m, i * group + j)), lambda x: x)
        return F.when(group > 0, F.transform(F.sequence(F.lit(0), F.greatest(to - 1, F.lit(0))), whole)).otherwise(F.array_repeat(F.lit(True), to))

    once = F.get(F.transform(F.array(mask), shrunk), F.lit(0))  # the mask is worked out once, not for each item
    return F.when(mask.isNull(), F.lit(None)).when(to > 0, once).otherwise(F.array().cast("array<boolean>"))


class FirstFit:
    """Groups by their ends in a tree of minima: the first group with room is found by one way down."""

    def __init__(self, most: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.least = [float("inf")] * (2 * self.size)
        self.used = 0

    def first(self, fits) -> int | None:
        """The first group whose end ``fits``; what an end fits, each smaller one does."""
        if not fits(self.least[1]):
            return None
        at = 1
        while at < self.size:
            at = 2 * at if fits(self.least[2 * at]) else 2 * at + 1
        return at - self.size

    def put(self, group: int, end: float) -> None:
        at = group + self.size
        self.least[at] = end
        while at > 1:
            at //= 2
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])
        self.used = max(self.used, group + 1)


def concat_plan(batches: DataFrame, factor: float = 1.0, gap: float = 1.0, key: str = "cut_id") -> DataFrame:
    """(batch_id, key, group, offset): first-fit of cuts, longest first, into groups of up to factor times the longest.

    A batch is packed in one task in n log n steps; batches of ``simple_batches`` or ``bucket_batches`` have a bounded duration. Null durations count as 0, a null batch is a batch;
    ties go by key. Empty tables give no rows.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(duration=part["duration"].fillna(0.0)).sort_values(["duration", key], ascending=[False, True])
        room, groups, rows = factor * part["duration"].max(), FirstFit(len(part)), []
        for own, d in zip(part[key], part["duration"].tolist()):
            g = groups.first(lambda e: e + gap + d <= room + 1e-9)
            at = 0.0 if g is None else groups.least[g + groups.size] + gap
            g = groups.used if g is None else g
            groups.put(g, at + d)
            rows.append((part["batch_id"].iloc[0], own, g, at))
        return pd.DataFrame(rows, columns=["batch_id", key, "group", "offset"])

    return batches.select("batch_id", key, "duration").groupBy("batch_id").applyInPandas(pack, f"batch_id string, {key} string, group long, offset double")


def spans(rng: np.random.Generator, size: int, p: float, length: int, min_masks: int, kind: str, other: float, no_overlap: bool, min_space: int) -> np.ndarray:
    """Masked positions of one row: int(p size / length + u) spans at starts drawn without replacement."""
    n = max(min_masks, int(p * size / length + rng.random()))
    draw = {
        "static": lambda: np.full(n, length),
        "uniform": lambda: rng.integers(int(other), 2 * length + 1, n),
        "normal": lambda: np.maximum(1, np.rint(rng.normal(length, other, n)).astype(int)),
        "poisson": lambda: rng.poisson(length, n),
    }
    sizes = draw[kind]()
    if n == 0 or size <= 1 or sizes.sum() == 0:
        return np.zeros(0, np.int64)
    if no_overlap:
        free, at = [(0, size)], []
        for k in sorted(sizes.tolist(), reverse=True):
            room = np.array([b - a if b - a >= k + min_space else 0 for a, b in free])
            if k == 0 or room.sum() == 0:
                continue
            a, b = free.pop(int(rng.choice(len(free), p=room / room.sum())))
            start = int(rng.integers(a, b - k + 1))
            at += range(start, start + k)
            free += [(x, y) for x, y in ((a, start - min_space), (start + k + min_space, b)) if y > x]
        marks = np.array(sorted(at), np.int64)
    else:
        least = int(sizes.min())
        reach = size - (least if size - least > n else max(0, size - n - 1))
        starts = rng.choice(reach, min(n, reach), replace=False)
        marks = np.unique(np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes)]))
    marks = marks[marks < size]
    return marks[:-1] if len(marks) >= size else marks


def as_spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs in sorted distinct positions."""
    first = np.flatnonzero(np.diff(marks, prepend=-2) > 1)
    return marks[first], np.diff(np.append(first, len(marks)))


def positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions that the spans cover, in order."""
    lengths = np.asarray(lengths, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def equalised(rng: np.random.Generator, marks: np.ndarray, size: int, target: int | None, dropout: float) -> np.ndarray:
    """``marks`` thinned or filled up, at random, to ``target`` (None: as they are), then without round(share * dropout) of them."""
    if target is not None and len(marks) > target:
        marks = np.sort(rng.choice(marks, target, replace=False))
    elif target is not None and len(marks) < min(target, size):
        free = np.setdiff1d(np.arange(size), marks, assume_unique=True)
        marks = np.sort(np.append(marks, rng.choice(free, min(target, size) - len(marks), replace=False)))
    holes = int(np.rint(len(marks) * dropout))
    return np.sort(rng.permutation(marks)[holes:]) if holes else marks


def span_masks(df: DataFrame, p: float = 0.65, length: int = 10, min_masks: int = 2, kind: str = "static", other: float = 0.0, no_overlap: bool = False, min_space: int = 1, seed: int = 0, epoch: int = 0, same: bool = True, add: bool = False, dropout: float = 0.0, rate: int = 1, key: str = "cut_id", size: str = "num_frames") -> DataFrame:
    """``df`` with ``starts`` and ``lengths`` of its masked spans and ``n_masked``, seeded by (seed, epoch, id).

    With ``same`` every row of a batch keeps as many positions as the fewest, or (``add``) is filled up to the most; ``dropout`` then takes that share of each row's away. With a ``rate``
    over 1 all this happens on every rate-th frame, and each position stands for the ``rate`` frames from there, as far as the row goes. A row of null length counts as empty. Masks are runs
    from one step to the next, so a batch of long rows is small; rows of 500,000 frames together are worked on at once.
    """
    rows = df.withColumn("__seed", F.xxhash64(key, F.lit(seed), F.lit(epoch))).withColumn("__size", F.ceil(F.coalesce(F.col(size), F.lit(0)) / rate).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("n_masked", T.LongType())])
    rng = lambda s, step: np.random.default_rng([int(s) & (2**63 - 1), step])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            yield from (part for _, part in whole.groupby(whole["__size"].cumsum() // 500_000, sort=False))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            runs = [as_spans(spans(rng(s, 0), int(n), p, length, min_masks, kind, other, no_overlap, min_space)) for s, n in zip(b["__seed"], b["__size"])]
            yield b.assign(starts=[x for x, _ in runs], lengths=[n for _, n in runs], n_masked=[int(n.sum()) for _, n in runs])

    out = rows.mapInPandas(plan, schema)
    if same and "batch_id" in df.columns:
        out = out.withColumn("__target", (F.max if add else F.min)("n_masked").over(W.partitionBy("batch_id")))
    else:
        out = out.withColumn("__target", F.lit(None).cast("long"))
    if not dropout and rate == 1 and "batch_id" not in df.columns:
        return out.drop("__seed", "__size", "__target")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            runs = []
            for s, n, target, x, k, frames in zip(b["__seed"], b["__size"], b["__target"], b["starts"], b["lengths"], b[size].fillna(0)):
                marks = equalised(rng(s, 1), positions(x, k), int(n), None if pd.isna(target) else int(target), dropout)
                if rate > 1:
                    marks = (marks[:, None] * rate + np.arange(rate)).ravel()
                    marks = marks[marks < int(frames)]
                runs.append(as_spans(marks))
            yield b.assign(starts=[x for x, _ in runs], lengths=[n for _, n in runs], n_masked=[int(n.sum()) for _, n in runs])

    return out.mapInPandas(finish, out.schema).drop("__seed", "__size", "__target")


def specaug_plan(df: DataFrame, time_masks: int = 2, max_time: int = 100, bins: int = 80, freq_masks: int = 2, max_freq: int = 27, seed: int = 0, key: str = "cut_id", size: str = "num_frames") -> DataFrame:
    """(key, axis, start, length): time and channel spans of seeded sizes, within the row."""
    specs = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("i"), F.lit(m).alias("most"), (F.col(size) if a == "time" else F.lit(bins)).cast("long").alias("whole")) for a, n, m in (("time", time_masks, max_time), ("freq", freq_masks, max_freq)) for i in range(n)])
    rows = df.select(key, F.explode(specs).alias("s"))
    draw = lambda salt, n: F.pmod(seeded(key, F.col("s.axis"), F.col("s.i"), seed, salt), n)
    rows = rows.withColumn("length", draw("size", F.least("s.most", "s.whole") + 1).cast("long"))
    return rows.select(key, F.col("s.axis").alias("axis"), draw("at", F.col("s.whole") - F.col("length") + 1).cast("long").alias("start"), "length")
