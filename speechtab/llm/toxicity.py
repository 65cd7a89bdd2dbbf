"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its terms: letter runs with A-Z folded, hashed to ``DIM`` buckets. The machine
adds a weight per term and, through ``RANK`` factors per term, a weight for each pair of terms in the
same text, so that an insult near a group's name counts beyond the two alone, and so do two terms that are
neutral alone. In the linear part a term's value is its association with the label: the squared z-score of the two classes' document frequencies over the
``Z_TOP``-th largest one's, at most 1 and at least ``Z_LEAST``, so that the thousands of other words of a long text do not drown an insult. The
pairs are not weighed by it: their sum is over the number of the text's terms.
The machine is fitted by AdaGrad on the logistic loss over at most ``TRAIN_ROWS`` labelled documents
(those of smallest id hash), in one task of bounded size, for ``EPOCHS`` epochs or ``UPDATES`` batches, whichever is more. The model (DIM * (RANK + 2) floats) goes to the
scorers as a broadcast value.

Null and empty texts score the bias alone. Without labelled rows the score is 0. Ids that repeat in the
labels count by their largest label; of several texts with one id the smallest is learnt from. Null labels are no labels. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import LETTERS, distinct_per_doc, map_rows, release, small, words

DIM, RANK, TRAIN_ROWS, EPOCHS, BATCH = 1 << 17, 8, 20_000, 12, 256
Z_TOP, Z_LEAST, RATE, UPDATES, PAIR_RATE, PAIR_L2 = 10, 0.01, 0.3, 300, 0.03, 1e-4
THRESHOLD = 0.3
BROADCAST_IDS = 2_000_000


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice lo..hi: (document in the slice, distinct term bucket)."""
    for lo, hi, h, counts in words(texts, LETTERS):
        doc = np.repeat(np.arange(hi - lo), counts)
        yield lo, hi, *distinct_per_doc(doc, (h % np.uint64(DIM)).astype(np.int64))


def raw_scores(doc: np.ndarray, term: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bias, linear and pairwise part of each of n documents."""
    out = np.full(n, bias, np.float64)
    if len(term):
        has, begin, size = np.unique(doc, return_index=True, return_counts=True)
        vt = v[term]
        total = np.add.reduceat(vt, begin)
        out[has] += np.add.reduceat(w[term], begin) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vt**2).sum(1), begin)) / size
    return out


def association(doc: np.ndarray, term: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Value of each term in 0..1 from (document, distinct term) pairs and labels; 0 for terms of under three documents."""
    one, all_ = np.bincount(term, y[doc], minlength=DIM), np.bincount(term, minlength=DIM)
    n, n1 = len(y), y.sum()
    p = all_ / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(n1, 1) + 1 / max(n - n1, 1)))
    z = np.abs(one / max(n1, 1) - (all_ - one) / max(n - n1, 1)) / spread
    z[all_ < 3] = 0
    top = max(1e-9, np.partition(z, -Z_TOP)[-Z_TOP])
    return np.where(all_ >= 3, np.clip((z / top) ** 2, Z_LEAST, 1), 0)


def train(doc: np.ndarray, term: np.ndarray, y: np.ndarray, value: np.ndarray | None = None, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights (times the terms' values) and factors, from (document, distinct term) pairs sorted by document and labels 0/1."""
    rng = np.random.default_rng(seed)
    n = len(y)
    value = np.ones(DIM) if value is None else value
    terms_of = np.bincount(doc, minlength=n)  # before terms of no value go, as the scorer counts
    keep = value[term] > 0
    doc, term = doc[keep], term[keep]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    bias = float(np.log(rate / (1 - rate)))
    w, v = np.zeros(DIM), rng.normal(0, 0.01, (DIM, RANK))
    gw, gv = np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6)
    begin = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // max(1, n)))):  # small samples get as many steps as large ones
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            size = begin[rows + 1] - begin[rows]
            rows, size = rows[size > 0], size[size > 0]
            if not len(rows):
                continue
            local = np.repeat(np.arange(len(rows)), size)
            t = term[np.repeat(begin[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            x, share = value[t], 1 / terms_of[rows]
            vt, first = v[t], np.cumsum(size) - size
            total = np.add.reduceat(vt, first)
            z = bias + np.add.reduceat(w[t] * x, first) + 0.5 * share * ((total**2).sum(1) - np.add.reduceat((vt**2).sum(1), first))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
            e, pull = err[local] * x / len(rows), (err * share)[local] / len(rows)
            u, inv = np.unique(t, return_inverse=True)
            dw = np.bincount(inv, e) + 1e-6 * w[u]
            dv = np.stack([np.bincount(inv, pull * (total[local, f] - vt[:, f])) for f in range(RANK)], 1) + PAIR_L2 * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= PAIR_RATE * dv / np.sqrt(gv[u])
            bias -= 0.02 * float(err.mean())
    return bias, w * value, np.where(value[:, None] > 0, v, 0)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """Model from at most ``train_rows`` labelled documents whose crc32(id) mod 4 is not 2."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(chosen, train_rows), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def as_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, term in terms(b.column(1)):
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=hi - lo))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists], ["doc_id", "y", "terms"])

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        size = part["terms"].map(len).to_numpy()
        term = np.concatenate(part["terms"].to_list()) if size.sum() else np.zeros(0, np.int32)
        doc, y = np.repeat(np.arange(len(part), dtype=np.int32), size), part["y"].to_numpy(np.float64)
        del part
        bias, w, v = train(doc, term, y, association(doc, term, y))
        release()
        used = np.flatnonzero((w != 0) | (v != 0).any(1))
        values = np.column_stack([w[used], v[used]]).astype(np.float32)
        return pd.DataFrame({"at": np.append(-1, used), "values": [np.full(1, bias, np.float32), *values]})

    sample = rows.select("doc_id", "text", "y").mapInArrow(as_terms, "doc_id long, y int, terms array<int>")
    model = sample.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(fitted, "at long, values array<float>").toPandas()  # at most DIM + 1 rows
    w, v, bias = np.zeros(DIM, np.float32), np.zeros((DIM, RANK), np.float32), -30.0
    for at, values in zip(model["at"], model["values"]):
        if at < 0:
            bias = float(values[0])
        else:
            w[at], v[at] = values[0], values[1:]
    return bias, w, v


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with a column score (0 to 1); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, v = shared.value
        for b in batches:
            z = [raw_scores(doc, term, hi - lo, bias, w, v) for lo, hi, doc, term in terms(b.column(1))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30))) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns kept; texts are scored where they lie."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, v = model.value
        for b in batches:
            z = [raw_scores(doc, term, hi - lo, bias, w, v) for lo, hi, doc, term in terms(b.column(at))]
            if z:
                p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30)))
                yield b.filter(pa.array(p < threshold))
        release()

    return map_rows(docs, run)


def held_out_remainder(doc_id: int) -> bool:
    """The fold rule, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
