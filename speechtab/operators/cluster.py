"""Frame features, k-means and label assignment.

``frame_features``: 25 ms windows every 10 ms without edge snipping (frames are centred, ends mirrored),
mean removed, pre-emphasis 0.97, window (0.5 - 0.5 cos(2 pi n / (N - 1)))^0.85, power spectrum of a
512-point transform, 80 triangular filters even on the mel scale 1127 ln(1 + f / 700) from 20 Hz to
400 Hz under half the rate, natural log floored at 1e-10.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Frames that are transformed at once.
FRAMES = 1024


@functools.cache
def _filters(rate: int, bins: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Window's size, step, transform's points, window and triangular filters."""
    size, step = int(0.025 * rate), int(0.010 * rate)
    fft = 1 << (size - 1).bit_length()
    mel = lambda f: 1127 * np.log1p(f / 700)
    edges = np.linspace(mel(20.0), mel(rate / 2 - 400.0), bins + 2)
    freq = mel(np.arange(fft // 2 + 1) * rate / fft)
    up = (freq - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freq) / np.diff(edges)[1:, None]
    return size, step, fft, (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85, np.maximum(0, np.minimum(up, down))


def framed(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, window's size) of one channel, centred, the ends mirrored."""
    size, step = int(0.025 * rate), int(0.010 * rate)
    count = (len(samples) + step // 2) // step
    if count == 0:
        return np.zeros((0, size))
    at = step // 2 - size // 2 + np.arange((count - 1) * step + size)  # places of all frames, each once
    period = 2 * len(samples)
    edge = (at < 0) | (at >= len(samples))
    turned = np.mod(at[edge], period)
    at[edge] = np.where(turned >= len(samples), period - 1 - turned, turned)
    return np.lib.stride_tricks.sliding_window_view(samples[at], size)[::step]


def _log_mel(x: np.ndarray, rate: int, bins: int) -> np.ndarray:
    """(frames, bins) of frames, worked out in the array itself."""
    _, _, fft, window, bank = _filters(rate, bins)
    x -= x.mean(1, keepdims=True)
    x[:, 1:] -= 0.97 * x[:, :-1]
    x[:, 0] *= 1 - 0.97
    x *= window
    z = np.fft.rfft(x, fft)
    power = z.real**2 + z.imag**2
    return np.log(np.maximum(power @ bank.T, 1e-10)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int = 16_000, bins: int = 80) -> np.ndarray:
    """(frames, bins) of one channel of samples in -1..1."""
    x = framed(np.asarray(samples, np.float64), rate)
    parts = [_log_mel(x[lo : lo + FRAMES].copy(), rate, bins) for lo in range(0, len(x), FRAMES)]
    return np.concatenate([np.zeros((0, bins), np.float32), *parts])


def frame_features(audio: DataFrame, bins: int = 80, decode: Callable[[Any], np.ndarray] | None = None) -> DataFrame:
    """cut_id, t, feat of (cut_id, sampling_rate, samples array<float>).

    ``decode`` gives the samples of a value where the column holds another form (bytes, a text). Frames of many rows are transformed together, ``FRAMES`` at once.
    """

    def samples_of(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        rates, col = b.column(1).to_pylist(), b.column(2)
        for k, rate in enumerate(rates):
            v = col[k]
            if v.is_valid:
                yield k, int(rate), np.asarray(decode(v.as_py()) if decode else v.values.to_numpy(zero_copy_only=False), np.float64)

    def rows(cuts: pa.Array, held: list[tuple[int, int, np.ndarray]], rate: int) -> pa.RecordBatch:
        """Held frames (row, number of the first, frames) of one rate."""
        feats = _log_mel(np.concatenate([x for _, _, x in held]), rate, bins)
        n = [len(x) for _, _, x in held]
        at = pa.array(np.arange(len(feats) + 1, dtype=np.int32) * bins)
        t = np.concatenate([np.arange(first, first + k, dtype=np.int32) for (_, first, _), k in zip(held, n)])
        cut = cuts.take(pa.array(np.repeat([k for k, _, _ in held], n)))
        return pa.RecordBatch.from_arrays([cut, pa.array(t), pa.ListArray.from_arrays(at, pa.array(feats.ravel()))], ["cut_id", "t", "feat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, now = [], 0, None
            for k, rate, samples in samples_of(b):
                if held and rate != now:
                    yield rows(b.column(0), held, now)
                    held, size = [], 0
                x, lo, now = framed(samples, rate), 0, rate
                while lo < len(x):
                    part = x[lo : lo + FRAMES - size]
                    held.append((k, lo, part))
                    lo, size = lo + len(part), size + len(part)
                    if size == FRAMES:
                        yield rows(b.column(0), held, now)
                        held, size = [], 0
            if held:
                yield rows(b.column(0), held, now)

    return audio.select("cut_id", "sampling_rate", "samples").mapInArrow(run, "cut_id string, t int, feat array<float>")


def fit_kmeans(frames: DataFrame, k: int = 500, seed: int = 0, max_iter: int = 100, start: list[list[float]] | None = None) -> tuple[list[list[float]], float]:
    """Centres (k lists) and inertia per frame: full-batch, on the executors; from a k-means|| start, or from the centres ``start`` by ``refine_kmeans``."""
    if start is not None:
        return refine_kmeans(frames, start, max_iter)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = frames.select(array_to_vector(F.col("feat").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(data)
    return [list(map(float, c)) for c in model.clusterCenters()], model.summary.trainingCost / max(1, data.count())


def refine_kmeans(frames: DataFrame, centres: list[list[float]], rounds: int) -> tuple[list[list[float]], float]:
    """Centres after at most ``rounds`` rounds of assignment and means, and the inertia per frame under the last ones; a centre without frames stays.

    A task sends one row per centre it met: sums and counts, which are added up by centre. Null vectors take no part; without frames the inertia is 0.
    """
    c, inertia = np.asarray(centres, np.float64), 0.0

    def sums(c: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count, cost = np.zeros_like(c), np.zeros(len(c), np.int64), 0.0
            for b in batches:
                if len(b):
                    x = np.stack(b["feat"].to_list()).astype(np.float64)
                    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                    label = d.argmin(1)
                    np.add.at(total, label, x)
                    count += np.bincount(label, minlength=len(c))
                    cost += float(np.maximum(d.min(1), 0).sum())
            met = np.flatnonzero(count)
            if len(met):  # a partition without rows sends none: columns without items have no types
                yield pd.DataFrame({"id": met, "n": count[met], "total": list(total[met]), "cost": [cost] + [0.0] * (len(met) - 1)})

        return run

    rows = frames.select("feat").where("feat is not null")
    for last in [*[False] * rounds, True]:
        part = rows.mapInPandas(sums(c), "id int, n long, total array<double>, cost double")
        whole = part.groupBy("id").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.get("total", F.lit(d))).alias(f"t{d}") for d in range(c.shape[1])]).orderBy("id").collect()  # a row a centre
        inertia = sum(r["cost"] for r in whole) / max(1, sum(r["n"] for r in whole))
        if last:
            break
        moved = c.copy()
        for r in whole:
            moved[r["id"]] = [r[f"t{d}"] / r["n"] for d in range(c.shape[1])]
        if (moved == c).all():
            break
        c = moved
    return [list(map(float, x)) for x in c], inertia


def centres_of(table: DataFrame, id_col: str = "id", feat_col: str = "feat") -> list[list[float]]:
    """A bounded centre table as lists, by id."""
    return [list(map(float, r[0])) for r in table.orderBy(id_col).select(feat_col).collect()]


def assign_kmeans(frames: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``frames`` with label: argmin of |x|^2 - 2 x.c + |c|^2, the first minimum; one matrix product a batch."""
    c = np.asarray(centres, np.float64)
    norms = (c * c).sum(1)

    @F.pandas_udf("int")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            if len(b) == 0:
                yield pd.Series([], dtype="int32")
                continue
            x = np.stack(b.to_list()).astype(np.float64)
            yield pd.Series(np.argmin((x * x).sum(1)[:, None] - 2 * x @ c.T + norms, axis=1).astype(np.int32))

    return frames.withColumn("label", label("feat"))


def labels_per_cut(assigned: DataFrame) -> DataFrame:
    """cut_id, labels: blank-joined labels in frame order."""
    v = F.array_sort(F.collect_list(F.struct("t", "label")))
    return assigned.groupBy("cut_id").agg(F.array_join(F.transform(v, lambda x: x["label"].cast("string")), " ").alias("labels"))
