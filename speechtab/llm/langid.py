"""Language identification in two steps: the family first, then the language within it.

A text's bytes (A-Z folded, other ASCII than letters one space) give all windows of one to three bytes, hashed to ``DIM`` buckets; its vector is
their relative frequencies. One linear support vector machine for each pair of families, and one for each pair of languages of a
family, are fitted by dual coordinate descent. The family with most pairwise wins is chosen, then among its languages the one with most
wins; ties by the summed margins. The score is the product of both choices' mean pairwise probabilities.

Families are a fixed table by language code (what follows ``-`` or ``_`` is left out); a code outside it is a family of its own. The model is fitted in one
task on at most ``TRAIN_ROWS`` documents, the same number of each of the ``LANGS`` most frequent languages, drawn by id hash from distinct texts (crc32 of the id mod 5 not 0);
scoring reads every whole text, long ones in pieces, and shuffles nothing.

Null texts and those without a letter are ``und`` with score 0, and so is everything where there is nothing to learn from. Rows without an id are scored and not learnt from; null
languages are not learnt. Repeated rows are scored each; equal texts get equal results. Empty tables stay empty. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.llm.common import SLICE_BYTES, buffers, release, small

DIM, ORDERS, TRAIN_ROWS, LANGS = 1 << 15, 3, 6000, 32
SCALE, C, EPOCHS, SLOPE = 20.0, 10.0, 12, 2.0
COLUMNS = 16
LETTER = r"\p{L}"
# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
    "sinitic": "zh yue wuu",
}

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), code)


def pairs(langs: list[str]) -> list[tuple[str, str]]:
    """The machines: pairs of families, then pairs of languages of one family; the first of a pair is the positive class."""
    families = sorted({family(x) for x in langs})
    return list(combinations(families, 2)) + [p for p in combinations(sorted(langs), 2) if family(p[0]) == family(p[1])]


# ---------------------------------------------------------------- features
def buckets(b: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the window that begins at each byte; ``DIM`` where it leaves its document (``at``: where documents begin, and the end)."""
    m = _FOLD[b]
    g = np.zeros(len(m), np.uint32)
    for n in range(ORDERS):
        g = g * np.uint32(257)
        g[: len(m) - n] += m[n:]
        idx = ((g + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int32)
        for back in range(1, n + 1):
            out = at[1:] - back
            idx[out[out >= at[:-1]]] = DIM
        yield idx


def slices(texts: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Slices lo..hi of documents, each with its windows."""
    offs, data = buffers(texts)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1))
        yield lo, hi, _windows(offs, data, lo, hi)
        lo = hi


def _windows(offs: np.ndarray, data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (and each piece of a long document): where the slice's documents begin, and the end; the buckets of their windows."""
    begin, end = int(offs[lo]), int(offs[hi])
    if end - begin <= SLICE_BYTES:
        at = offs[lo : hi + 1] - begin
        for idx in buckets(data[begin:end], at):
            yield at, idx
        return
    for x in range(begin, end, SLICE_BYTES):
        piece = data[x : min(x + SLICE_BYTES + ORDERS - 1, end)]
        for idx in buckets(piece, np.array([0, len(piece)])):
            own = idx[:SLICE_BYTES]  # windows that begin behind this are the next piece's
            yield np.array([0, len(own)]), own


def histogram(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per document its buckets and their shares."""
    for lo, hi, windows in slices(texts):
        counts = np.zeros((1, DIM + 1)) if hi - lo == 1 else None
        docs, all_ = [], []
        for at, idx in windows:
            if counts is not None:
                counts[0] += np.bincount(idx, minlength=DIM + 1)
            else:
                docs.append(np.repeat(np.arange(hi - lo), np.diff(at)))
                all_.append(idx)
        if counts is not None:
            used = np.flatnonzero(counts[0, :DIM])
            yield used.astype(np.int32), (counts[0, used] / max(1, counts[0, used].sum())).astype(np.float32)
            continue
        doc, idx = np.concatenate(docs), np.concatenate(all_)
        key, count = np.unique(doc[idx < DIM] * np.int64(DIM) + idx[idx < DIM], return_counts=True)
        begin = np.searchsorted(key, np.arange(hi - lo + 1) * np.int64(DIM))
        for i in range(hi - lo):
            c = count[begin[i] : begin[i + 1]]
            yield (key[begin[i] : begin[i + 1]] % DIM).astype(np.int32), (c / max(1, c.sum())).astype(np.float32)


# ---------------------------------------------------------------- machines
def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine over sparse rows and labels -1/1: dual coordinate descent on the hinge loss."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(DIM + 1), np.zeros(len(y))
    scaled = [(i, v.astype(np.float64) * SCALE) for i, v in x]
    norm = np.array([v @ v + 1 for _, v in scaled])
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            i, v = scaled[k]
            to = min(C, max(0.0, alpha[k] - (y[k] * (w[i] @ v + w[DIM]) - 1) / norm[k]))
            if to != alpha[k]:
                step = (to - alpha[k]) * y[k]
                w[i] += step * v
                w[DIM] += step
                alpha[k] = to
    return w


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Documents x machines: the mean weight of a document's windows, times ``SCALE``, and the bias. ``weights``: (DIM + 1) x machines, the last row the biases."""
    inner = np.vstack([weights[:DIM], np.zeros((1, weights.shape[1]), weights.dtype)])
    out = []
    for lo, hi, windows in slices(texts):
        total, count = np.zeros((hi - lo, weights.shape[1])), np.zeros(hi - lo)
        for at, idx in windows:
            full = np.flatnonzero(at[:-1] < at[1:])
            if not len(full):
                continue
            first = at[full]
            count[full] += np.add.reduceat(idx < DIM, first, dtype=np.int64)
            for c in range(0, weights.shape[1], COLUMNS):
                total[full, c : c + COLUMNS] += np.add.reduceat(inner[idx, c : c + COLUMNS], first, axis=0, dtype=np.float64)
        out.append(SCALE * total / np.maximum(count, 1)[:, None] + weights[DIM])
    return np.concatenate(out) if out else np.zeros((0, weights.shape[1]))


def decide(z: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the chosen language and the score, from the margins of ``pairs(langs)``."""
    machines, families = pairs(langs), sorted({family(x) for x in langs})
    place = {p: k for k, p in enumerate(machines)}

    def among(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner among the names and its mean pairwise probability."""
        if len(names) == 1:
            return np.zeros(len(z), np.int64), np.ones(len(z))
        wins, total, prob = (np.zeros((len(z), len(names))) for _ in range(3))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            m = z[:, place[a, b]]
            p = 1 / (1 + np.exp(-np.clip(SLOPE * m, -30, 30)))
            for n, sign, q in ((i, 1, p), (j, -1, 1 - p)):
                wins[:, n] += sign * m > 0
                total[:, n] += sign * m
                prob[:, n] += q / (len(names) - 1)
        best = np.lexsort((np.broadcast_to(np.arange(len(names)), wins.shape), -total, -wins), axis=1)[:, 0]
        return best, prob[np.arange(len(z)), best]

    which, sure = among(families)
    lang = np.zeros(len(z), np.int64)
    for f, name in enumerate(families):
        own = [x for x in sorted(langs) if family(x) == name]
        best, p = among(own)
        lang = np.where(which == f, np.array([langs.index(x) for x in own])[best], lang)
        sure = np.where(which == f, sure * p, sure)
    return lang, sure


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, most: int = LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and weights ((DIM + 1) x machines) from at most ``train_rows`` documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    rows = rows.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("text").rlike(LETTER)).withColumn("t", F.xxhash64("text"))
    distinct = rows.groupBy("t", "lang").agg(F.min("doc_id").alias("doc_id"))
    top = distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    langs = sorted(r["lang"] for r in top)
    machines = pairs(langs)
    if not machines:
        return langs, np.zeros((DIM + 1, 0), np.float32)
    quota = max(1, train_rows // len(langs))
    # twice the quota in expectation is drawn before the exact cut, so that no window holds a language whole
    drawn = F.create_map(*[x for r in top for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * quota + 100) / r["n"])))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = distinct.where(F.col("lang").isin(langs)).withColumn("draw", draw).where(F.col("draw") < F.element_at(drawn, F.col("lang")))
    picked = picked.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "t"))).where(F.col("k") <= quota).select("doc_id", "t", "lang")
    sample = rows.join(small(picked, train_rows + most), ["doc_id", "t", "lang"]).groupBy("doc_id", "t", "lang").agg(F.min("text").alias("text"))

    def as_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(histogram(b.column(3)))
            lists = [pa.array([x[i] for x in got], pa.list_(t)) for i, t in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], ["doc_id", "t", "lang", "at", "share"])

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "t", "lang"])
        x, lang = list(zip(part["at"], part["share"])), part["lang"].to_numpy()
        name = np.array([family(v) for v in lang])
        out = []
        for a, b in machines:
            of = name if (a, b) in family_pairs else lang
            rows = np.flatnonzero((of == a) | (of == b))
            out.append(svm([x[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0)).astype(np.float32))
        release()
        return pd.DataFrame({"machine": range(len(out)), "weights": out})

    family_pairs = set(combinations(sorted({family(v) for v in langs}), 2))
    vectors = sample.select("doc_id", "t", "lang", "text").mapInArrow(as_vectors, "doc_id long, t long, lang string, at array<int>, share array<float>")
    model = vectors.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(fitted, "machine int, weights array<float>").toPandas()  # a row a machine, of DIM + 1 numbers
    weights = np.zeros((DIM + 1, len(machines)), np.float32)
    for k, w in zip(model["machine"], model["weights"]):
        weights[:, k] = w
    return langs, weights


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fits a model from ``docs`` unless one is given."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = shared.value
        names = np.array([*langs, "und"], object)
        for b in batches:
            lettered = np.asarray(b.column(2).to_pylist(), bool) & bool(langs)
            if langs:
                lang, score = decide(margins(b.column(1), weights), langs)
            else:
                lang, score = np.zeros(len(b), np.int64), np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(names[np.where(lettered, lang, len(langs))], pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])
        release()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered"), held.alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
