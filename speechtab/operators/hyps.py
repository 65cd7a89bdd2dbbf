"""Hypotheses: greedy labels, ensembles, merging, ranking, rescoring, alignment and word error rates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def greedy_labels(frames: DataFrame, blank: int = 0, unk: int = 2, penalty: float = 0.0) -> DataFrame:
    """utt_id, ys, ts: largest logits per frame after a penalty on blank; blanks and unknowns dropped, first wins ties."""
    adjusted = F.transform("logits", lambda x, i: F.when(i == blank, x - F.lit(penalty)).otherwise(x))
    best = frames.withColumn("__a", adjusted).withColumn("y", (F.array_position("__a", F.array_max("__a")) - 1).cast("int"))
    kept = F.when(~F.col("y").isin(blank, unk), F.struct("t", "y"))
    lists = best.groupBy("utt_id").agg(F.array_sort(F.collect_list(kept)).alias("v"))
    return lists.select("utt_id", F.col("v.y").alias("ys"), F.col("v.t").alias("ts"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once: a lambda's body would work it out again for each item."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def log_softmax(arr: Column, temperature: float = 1.0) -> Column:
    def less_total(v: Column, top: Column) -> Column:
        total = F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        return _once(total, lambda z: F.transform(v, lambda x: x - top - z))

    return _once(F.transform(arr, lambda x: x / temperature), lambda v: _once(F.array_max(v), lambda top: less_total(v, top)))


def ensemble_mean(frames: DataFrame, form: str = "logits", temperature: float = 1.0) -> DataFrame:
    """utt_id, t, token, score: mean over models of logits or of log-probabilities."""
    values = F.col("logits").cast("array<double>") if form == "logits" else log_softmax(F.col("logits").cast("array<double>"), temperature)
    lists = frames.select("utt_id", "t", values.alias("v")).where("v is not null").groupBy("utt_id", "t").agg(F.collect_list("v").alias("vs"))  # a row a model
    total = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), F.get("vs", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return lists.select("utt_id", "t", F.posexplode(F.transform(total, lambda x: x / F.size("vs"))).alias("token", "score"))


def merge_hyps(df: DataFrame, keys: tuple[str, ...] = ("utt_id", "ys")) -> DataFrame:
    """One row per key: log of the summed probabilities."""
    top = F.max("log_prob").over(W.partitionBy(*keys))
    return df.withColumn("__m", top).groupBy(*keys).agg((F.max("__m") + F.log(F.sum(F.exp(F.col("log_prob") - F.col("__m"))))).alias("log_prob"))


def topk_hyps(df: DataFrame, k: int = 1, norm: bool = False, order: str = "hyp") -> DataFrame:
    """The k best of each utterance, optionally by score per symbol (the length includes the context prefix); first wins ties."""
    score = F.col("log_prob") / F.col("length") if norm else F.col("log_prob")
    rank = F.row_number().over(W.partitionBy("utt_id").orderBy(score.desc(), order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def filter_hyps(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("log_prob") > threshold)


def rescore_grid(nbest: DataFrame, form: str = "lm", scales: tuple[float, ...] = (0.1, 0.3, 0.5), second: tuple[float, ...] = (0.05, 0.1)) -> DataFrame:
    """setting, utt_id, hyp, score: best hypothesis per utterance and setting; ties go to the earlier.

    ``lm``: am + s lm. ``lodr``: am / s + lm - d ng ln 10. ``ngram_rnn``: am + s ng + d lm. An utterance's row holds one best pair of
    numbers a setting of the grid; settings become rows only when the best are known.
    """
    pairs = [(float(s), float(d)) for s in scales for d in (second if form != "lm" else (0.0,))]
    am, lm, ng = F.col("am"), F.col("lm"), F.col("ng")
    score = {"lm": lambda s, d: am + s * lm, "lodr": lambda s, d: am / s + lm - d * ng * math.log(10), "ngram_rnn": lambda s, d: am + s * ng + d * lm}[form]
    name = {"lm": lambda s, d: f"nnlm_scale_{s:.2f}", "lodr": lambda s, d: f"nnlm_scale_{s:.2f}_lodr_scale_{d:.2f}", "ngram_rnn": lambda s, d: f"ngram_lm_scale_{s}_nnlm_scale_{d}"}[form]
    best = [F.max(F.struct(score(F.lit(s), F.lit(d)).alias("score"), (-F.col("hyp")).alias("m"))).alias(f"b{i}") for i, (s, d) in enumerate(pairs)]
    per = nbest.groupBy("utt_id").agg(*best)
    settings = F.explode(F.array(*[F.struct(F.lit(name(s, d)).alias("setting"), F.col(f"b{i}").alias("b")) for i, (s, d) in enumerate(pairs)]))
    return per.select("utt_id", settings.alias("x")).select("x.setting", "utt_id", (-F.col("x.b.m")).alias("hyp"), F.col("x.b.score").alias("score"))


def _cost_row(above: np.ndarray, same: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The row of the cost table below ``above``; ``same``: whether the row's word equals each word of the other side."""
    row = above + 1
    np.minimum(row[1:], above[:-1] + ~same, out=row[1:])
    return np.minimum.accumulate(row - steps) + steps  # insertions run along the row


def edit_path(ref: list[str], hyp: list[str]) -> list[tuple[str | None, str | None]]:
    """Aligned word pairs at unit costs; ties prefer substitution, then deletion, then insertion.

    Of the cost table only each sqrt(len(ref))-th row is kept; the way back computes the rows between two of them again, block by block. So
    memory is len(hyp) * sqrt(len(ref)) numbers, with the same path as the whole table gives. What both sides end in alike is paired beforehand.
    """
    m, n = len(ref), len(hyp)
    out: list[tuple[str | None, str | None]] = []
    while m and n and ref[m - 1] == hyp[n - 1]:  # equal words are the first choice of the way back
        m, n = m - 1, n - 1
        out.append((ref[m], hyp[n]))
    number: dict[str, int] = {}
    r, h = (np.array([number.setdefault(w, len(number)) for w in v], np.int64) for v in (ref[:m], hyp[:n]))
    steps = np.arange(n + 1, dtype=np.int32)
    every = math.isqrt(m) + 1
    row, kept = steps.copy(), []
    for i in range(m):
        if i % every == 0:
            kept.append(row)
        row = _cost_row(row, h == r[i], steps)
    i, j = m, n
    while kept:
        first = (len(kept) - 1) * every
        rows = [kept.pop()]
        while first + len(rows) <= i:
            rows.append(_cost_row(rows[-1], h == r[first + len(rows) - 1], steps))
        while i > first:
            here, above = rows[i - first], rows[i - first - 1]
            if j and here[j] == above[j - 1] + (r[i - 1] != h[j - 1]):
                i, j = i - 1, j - 1
                out.append((ref[i], hyp[j]))
            elif here[j] == above[j] + 1:
                i -= 1
                out.append((ref[i], None))
            else:
                j -= 1
                out.append((None, hyp[j]))
    out += [(None, w) for w in reversed(hyp[:j])]
    return out[::-1]


ALIGNED = "setting string, cut_id string, n_ref long, correct long, substituted long, deleted long, inserted long, ref_words array<string>, hyp_words array<string>"


#: Cells of the cost tables that are worked out at once, and the length from which a pair is aligned by itself.
CELLS, LONG = 1 << 23, 1000
#: Pairs of a batch that are aligned together at most.
SLICE = 2000


def edit_paths(ref: np.ndarray, m: np.ndarray, hyp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths of many pairs at once, as ``edit_path`` finds them: places in ref and hyp (-1: none), a row of steps a pair from its right end, and the steps' numbers.

    ``ref``, ``hyp``: a row of word numbers a pair, of which the first ``m`` and ``n`` count.
    """
    pairs, steps = np.arange(len(ref)), np.arange(hyp.shape[1] + 1, dtype=np.int16)
    cost = np.empty((ref.shape[1] + 1, len(ref), len(steps)), np.int16)
    cost[0] = steps
    for i in range(ref.shape[1]):
        row = cost[i] + np.int16(1)
        np.minimum(row[:, 1:], cost[i][:, :-1] + (hyp != ref[:, i, None]), out=row[:, 1:])
        cost[i + 1] = np.minimum.accumulate(row - steps, axis=1) + steps
    i, j, size = m.copy(), n.copy(), np.zeros(len(ref), np.int64)
    most = int((m + n).max(initial=0))
    left, right = np.full((len(ref), most), -1, np.int32), np.full((len(ref), most), -1, np.int32)
    for at in range(most, 0, -1):
        now = pairs[(i > 0) | (j > 0)]
        if not len(now):
            break
        x, y = i[now], j[now]
        here, both = cost[x, now, y], (x > 0) & (y > 0)
        across = both & (here == cost[x - 1, now, y - 1] + (ref[now, x - 1] != hyp[now, y - 1]))
        up = ~across & (x > 0) & (here == cost[x - 1, now, y] + 1)
        dx, dy = across | up, ~up
        left[now, at - 1], right[now, at - 1] = np.where(dx, x - 1, -1), np.where(dy, y - 1, -1)
        i[now], j[now] = x - dx, y - dy
        size[now] += 1
    return left, right, size


def _aligned(ref: pa.ListArray, hyp: pa.ListArray) -> tuple[list[np.ndarray], pa.ListArray, pa.ListArray]:
    """n_ref, correct, substituted, deleted and inserted of each pair, and the words of both sides step by step."""
    both = pa.chunked_array([ref.flatten(), hyp.flatten()]).combine_chunks().dictionary_encode()
    words, code = both.dictionary, both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    m, n = (pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (ref, hyp))
    at_r = np.append(0, np.cumsum(m))
    at_h = np.append(0, np.cumsum(n)) + at_r[-1]
    steps: list[tuple[np.ndarray, np.ndarray]] = [(code[:0], code[:0])] * len(m)
    order, lo = np.lexsort((n, m)), 0
    while lo < len(order):
        k = order[lo]
        if max(m[k], n[k]) > LONG:
            path = edit_path(code[at_r[k] : at_r[k + 1]].tolist(), code[at_h[k] : at_h[k + 1]].tolist())
            steps[k] = tuple(np.array([-1 if p[side] is None else p[side] for p in path], np.int32) for side in (0, 1))
            lo += 1
            continue
        wide, hi = n[k], lo
        while hi < len(order) and max(m[order[hi]], n[order[hi]]) <= LONG:
            wide = max(wide, n[order[hi]])
            if hi > lo and (hi + 1 - lo) * (m[order[hi]] + 1) * (wide + 1) > CELLS:
                break
            hi += 1
        some = order[lo:hi]
        r, h = np.full((len(some), max(1, m[some].max())), -2, np.int32), np.full((len(some), max(1, n[some].max())), -3, np.int32)
        for row, k in enumerate(some):
            r[row, : m[k]], h[row, : n[k]] = code[at_r[k] : at_r[k + 1]], code[at_h[k] : at_h[k + 1]]
        left, right, size = edit_paths(r, m[some], h, n[some])
        for row, k in enumerate(some):
            a, z = left[row, left.shape[1] - size[row] :], right[row, right.shape[1] - size[row] :]
            steps[k] = np.where(a < 0, -1, np.append(r[row], -1)[a]), np.where(z < 0, -1, np.append(h[row], -1)[z])
        lo = hi
    a, z = (np.concatenate([code[:0], *(s[side] for s in steps)]) for side in (0, 1))
    at = np.append(0, np.cumsum([len(x) for x, _ in steps], dtype=np.int64))
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[at])
    right, gone, new, size = total(a == z), total(z < 0), total(a < 0), np.diff(at)
    lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.take(pa.array(x.astype(np.int32), mask=x < 0))) for x in (a, z)]
    return [size - new, right, size - right - gone - new, gone, new], *lists


def align(pairs: DataFrame) -> DataFrame:
    """Counts and aligned words (null: none) of (setting, cut_id, ref, hyp); null word lists count as empty.

    Pairs of like length are aligned together, ``SLICE`` pairs at most, so that what a task takes follows neither its rows nor its batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                setting, cut, ref, hyp = b.slice(lo, SLICE).columns
                counts, left, right = _aligned(ref, hyp)
                yield pa.RecordBatch.from_arrays([setting, cut, *map(pa.array, counts), left, right], [x.split()[0] for x in ALIGNED.split(", ")])

    return pairs.select("setting", "cut_id", "ref", "hyp").mapInArrow(run, ALIGNED)


def oracle_hyp(nbest: DataFrame, refs: DataFrame) -> DataFrame:
    """utt_id, hyp, errors: the hypothesis (utt_id, hyp, words) closest to the reference (utt_id, ref); ties to the earlier."""
    joined = nbest.join(refs, "utt_id").select(F.col("hyp").cast("string").alias("setting"), F.col("utt_id").cast("string").alias("cut_id"), "ref", F.col("words").alias("hyp"))
    errors = F.col("substituted") + F.col("deleted") + F.col("inserted")
    best = align(joined).groupBy(F.col("cut_id").alias("utt_id")).agg(F.min(F.struct(errors.alias("errors"), F.col("setting").cast("long").alias("hyp"))).alias("b"))
    return best.select("utt_id", "b.hyp", "b.errors")


def wer(aligned: DataFrame) -> DataFrame:
    """setting, errors, n_ref, wer: the corpus ratio, best first."""
    errors = F.sum(F.col("substituted") + F.col("deleted") + F.col("inserted"))
    t = aligned.groupBy("setting").agg(errors.alias("errors"), F.sum("n_ref").alias("n_ref"))
    return t.withColumn("wer", F.when(F.col("n_ref") > 0, 100 * F.col("errors") / F.col("n_ref"))).orderBy("wer", "setting")


def word_errors(aligned: DataFrame) -> DataFrame:
    """Per setting and word: times correct, substituted, deleted (as reference) and inserted."""
    pair = aligned.select("setting", F.explode(F.arrays_zip("ref_words", "hyp_words")).alias("p")).select("setting", F.col("p.ref_words").alias("r"), F.col("p.hyp_words").alias("h"))
    one = lambda c: F.count_if(c)
    return pair.groupBy("setting", F.coalesce("r", "h").alias("word")).agg(one(F.col("r") == F.col("h")).alias("correct"), one(F.col("r") != F.col("h")).alias("substituted"), one(F.col("h").isNull()).alias("deleted"), one(F.col("r").isNull()).alias("inserted"))
