"""Cross-entropy difference: a target and a background bigram model over one vocabulary score documents.

The target corpus is the documents labelled of good quality, the background all documents. Both models
have one order, smoothing and vocabulary, which is every word of the corpus: counts cover every word and
every bigram, without a cut-off. p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU), a Dirichlet prior around the
unigram p(w) = (c(w) + 1) / (tokens + words + 1); what is left of a history's mass is the end of the text.
A document's own counts are taken out of each model that holds them before it is scored (leave one out), so
that labelled and other documents are scored alike. The score is the mean over the tokens of
-log2 p_target + log2 p_background; lower is closer to the target.

How it runs. Documents are packed into groups of about ``GROUP`` tokens (token numbers and a word list), staged
as rows. Each group sends its distinct words and bigrams, as sorted 64-bit ids cut into hash ranges, to the range's
task; ranges are as many as keep one at about ``RANGE_IDS`` ids. The task sums counts over groups and
sends each group the totals of its own ids, in its own order, so totals (mostly 0 and 1) take next to no space. A group is cut into at most ``FAN_OUT`` parts; where there are more
ranges, the parts of many groups in one coarse range are merged into runs of about ``RANGE_IDS`` ids first, and the runs are cut again, level by level. So each row
holds thousands of ids and the number of rows grows with the tokens, not with groups x ranges; totals come back the same way.
A frequent word or bigram is one id a group, so no task is hot. Nothing is collected or broadcast.

A document starts from a start mark as history. Null and empty texts have no tokens and null losses and score.
Without target documents the target model is uniform. Repeated rows and ids are documents each by itself (copies leave
only themselves out); null ids are scored. Words fold A-Z. Texts of over ``GROUP`` tokens are left out and
scored piece by piece and summed. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import U64, mix, release, small, stage, words

MU = 2.0
GROUP, RANGE_IDS, FAN_OUT = 1 << 20, 2_000_000, 256
BROADCAST_IDS = 5_000_000
WORD, BIGRAM = 0, 1
DOC = "key long, doc_id long, n long, target boolean, background boolean, before long"
GROUPS = f"group long, words binary, tokens binary, docs array<struct<{', '.join(x.replace(' ', ':', 1) for x in DOC.split(', ')) }>>"


def pack(x: np.ndarray) -> bytes:
    """An integer array, byte by byte of equal weight, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1) if len(x) else b""


def unpack(data: bytes, dtype: type) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def bigram_ids(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit ids of bigrams of word ids (history 0: the start)."""
    return mix(h * U64(0x9E3779B97F4A7C15) + (w ^ (w >> U64(29))))


# ---------------------------------------------------------------- documents in groups
def marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, text, target (whether the id is in ``good``), background (true)."""
    ids = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("target")).where("doc_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(ids, BROADCAST_IDS), "doc_id", "left")
    return rows.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"), F.lit(True).alias("background"))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, doc_id, target, background, word before), word ids of each document, or of its parts of up to ``most`` tokens."""
    key = TaskContext.get().partitionId() << 36
    for b in batches:
        flags = list(zip(*(b.column(c).to_pylist() for c in (0, 2, 3))))
        for lo, hi, ids, counts in words(b.column(1)):
            ends = np.cumsum(counts)
            for i in range(hi - lo):
                own = ids[ends[i] - counts[i] : ends[i]]
                for at in range(0, max(1, len(own)), most):
                    yield (key, *flags[lo + i], int(own[at - 1]) if at else 0), own[at : at + most]
                key += 1


def _group(number: int, held: list[tuple[tuple, np.ndarray]]) -> tuple:
    """A row of ``GROUPS``: words by falling frequency, tokens as places in that list; before: place of the word before, from 1."""
    w = np.concatenate([x for _, x in held])
    before = np.array([m[4] for m, _ in held], np.uint64)
    listed, place, count = np.unique(np.append(w, before[before > 0]), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    at = np.empty(len(order), np.uint32)
    at[order] = np.arange(len(order), dtype=np.uint32)
    place = at[place]
    first = np.zeros(len(held), np.int64)
    first[before > 0] = place[len(w) :].astype(np.int64) + 1
    docs = [dict(key=m[0], doc_id=m[1], n=len(x), target=m[2], background=m[3], before=int(f)) for (m, x), f in zip(held, first)]
    return number, pack(listed[order]), pack(place[: len(w)]), docs


def grouped(docs: DataFrame, group_tokens: int = GROUP) -> DataFrame:
    """``docs`` (doc_id, text, target, background) as rows of ``GROUPS``."""
    doc = pa.list_(pa.struct([(n, {"long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in DOC.split(", "))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 28, [], 0

        def out() -> pa.RecordBatch:
            g, w, t, d = _group(number, held)
            return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([w]), pa.array([t]), pa.array([d], doc)], ["group", "words", "tokens", "docs"])

        for piece in _pieces(batches, group_tokens):
            if size and size + len(piece[1]) > group_tokens:
                yield out()
                number, held, size = number + 1, [], 0
            held.append(piece)
            size += len(piece[1]) + 1
        if held:
            yield out()
        release()

    return docs.select("doc_id", "text", "target", "background").mapInArrow(run, GROUPS)


class Tokens:
    """A group's documents, tokens and distinct ids."""

    def __init__(self, listed: bytes, tokens: bytes, docs: list[dict]) -> None:
        self.docs = docs
        self.n = np.array([d["n"] for d in docs], np.int64)
        self.doc = np.repeat(np.arange(len(docs)), self.n)
        self.flags = [np.array([d[f] for d in docs], bool) for f in ("background", "target")]
        listed = unpack(listed, np.uint64)
        w = unpack(tokens, np.uint32).astype(np.int64) + 1
        h = np.append(0, w[:-1]) if len(w) else w
        has = self.n > 0
        h[(np.cumsum(self.n) - self.n)[has]] = np.array([d["before"] for d in docs], np.int64)[has]
        of = np.append(U64(0), listed)
        order = np.argsort(listed)
        place = np.empty(len(of), np.int64)
        place[0], place[order + 1] = -1, np.arange(len(order))
        self.words, self.w, self.h = listed[order], place[w], place[h]  # places in the sorted words; -1: the start
        self.bigrams, self.pair = np.unique(bigram_ids(of[h], of[w]), return_inverse=True)

    def counts(self, kind: int, flag: int) -> np.ndarray:
        """Occurrences of each distinct id in the documents flagged as background (0) or target (1)."""
        at, size = (self.w, len(self.words)) if kind == WORD else (self.pair, len(self.bigrams))
        return np.bincount(at, self.flags[flag][self.doc], size).astype(np.uint64) if len(at) else np.zeros(size, np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


# ---------------------------------------------------------------- totals
def shares(groups: DataFrame, ranges: int) -> DataFrame:
    """kind, range, group, ids, background, target (packed): each group's distinct ids and counts, cut by hash range."""
    edges = np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t = Tokens(row["words"], row["tokens"], row["docs"])
            for kind, ids in ((WORD, t.words), (BIGRAM, t.bigrams)):
                b, a = t.counts(kind, 0), t.counts(kind, 1)
                cut = np.concatenate([[0], np.searchsorted(ids, edges), [len(ids)]])
                for at in range(0, ranges, 64):
                    own = [r for r in range(at, min(at + 64, ranges)) if cut[r] < cut[r + 1]]
                    packed = [[pack(x[cut[r] : cut[r + 1]]) for r in own] for x in (ids, b, a)]
                    as_long = lambda x: pa.array([x] * len(own), pa.int64())
                    yield pa.RecordBatch.from_arrays([as_long(kind), pa.array(own, pa.int64()), as_long(row["group"]), *(pa.array(p, pa.binary()) for p in packed)], ["kind", "range", "group", "ids", "background", "target"])
        release()

    return groups.mapInArrow(run, "kind long, range long, group long, ids binary, background binary, target binary")


def _totals(part: pd.DataFrame) -> pd.DataFrame:
    """One hash range: the totals of each group's ids, in the group's order; a row of group -1 tells how many ids are distinct."""
    part = part.sort_values("group")
    ids = [unpack(x, np.uint64) for x in part["ids"]]
    every, at = np.unique(np.concatenate(ids), return_inverse=True)
    ends = np.cumsum([len(x) for x in ids])
    del ids
    out = {"group": [-1, *part["group"]], "distinct": [len(every), *[0] * len(part)]}
    for c in ("background", "target"):
        total = np.bincount(at, np.concatenate([unpack(x, np.uint64) for x in part[c]]), len(every)).astype(np.uint64)[at]
        out[c] = [b"", *(pack(x) for x in np.split(total, ends[:-1]))]
    release()
    return pd.DataFrame({"kind": part["kind"].iloc[0], "range": part["range"].iloc[0], **out})


RUNS = "kind long, range long, block long, group long, ids binary, background binary, target binary"


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """A coarse range's parts of some groups as one run: a row of group -1 has all their ids and summed counts, a row of each group the places of its ids in the run."""
    part = part.sort_values("group")
    ids = [unpack(x, np.uint64) for x in part["ids"]]
    every, at = np.unique(np.concatenate(ids), return_inverse=True)
    ends = np.cumsum([len(x) for x in ids])
    sums = [pack(np.bincount(at, np.concatenate([unpack(x, np.uint64) for x in part[c]]), len(every)).astype(np.uint64)) for c in ("background", "target")]
    places = [pack(x) for x in np.split(at.astype(np.uint32), ends[:-1])]
    none = [b""] * len(part)
    release()
    return pd.DataFrame({"kind": part["kind"].iloc[0], "range": part["range"].iloc[0], "block": part["block"].iloc[0], "group": [-1, *part["group"]], "ids": [pack(every), *places], "background": [sums[0], *none], "target": [sums[1], *none]})


def _cut_again(runs: DataFrame, children: int, divisions: int) -> DataFrame:
    """Runs cut into the ``children`` finer ranges of theirs (of ``divisions`` in all): kind, range, group (the run's block), ids, background, target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, *counts = (unpack(row[c], np.uint64) for c in ("ids", "background", "target"))
                first = row["range"] * children
                edges = np.array([-(-(k << 64) // divisions) for k in range(first + 1, first + children)], dtype=np.uint64)
                cut = np.concatenate([[0], np.searchsorted(ids, edges), [len(ids)]])
                own = [r for r in range(children) if cut[r] < cut[r + 1]]
                packed = [pa.array([pack(x[cut[r] : cut[r + 1]]) for r in own], pa.binary()) for x in (ids, *counts)]
                longs = [pa.array(x, pa.int64()) for x in ([row["kind"]] * len(own), [first + r for r in own], [row["block"]] * len(own))]
                yield pa.RecordBatch.from_arrays([*longs, *packed], ["kind", "range", "group", "ids", "background", "target"])
        release()

    return runs.select("kind", "range", "block", "ids", "background", "target").mapInArrow(run, "kind long, range long, group long, ids binary, background binary, target binary")


TOTALS = "kind long, range long, group long, distinct long, background binary, target binary"


def _hand_back(places: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """The totals of a run, from those of its finer ranges, to each group that it was merged of."""
    parts = parts.sort_values("range")
    whole = [np.concatenate([unpack(x, np.uint64) for x in parts[c]]) for c in ("background", "target")]
    back = [[pack(t[unpack(x, np.uint32)]) for x in places["ids"]] for t in whole]
    release()
    return pd.DataFrame({"kind": places["kind"], "range": places["range"], "group": places["group"], "distinct": 0, "background": back[0], "target": back[1]})


def _summed(sent: DataFrame, ids: int, ranges: int, divisions: int, range_ids: int, fan_out: int) -> DataFrame:
    """``TOTALS`` of the parts ``sent`` to ``divisions`` ranges: at once where these are as many as needed, else by way of merged runs."""
    if divisions >= ranges:
        return sent.repartition(2 * divisions, "kind", "range").groupBy("kind", "range").applyInPandas(_totals, TOTALS)
    blocks = max(1, -(-ids // (divisions * range_ids)))
    keyed = sent.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("long"))
    merged = stage(keyed.repartition(2 * divisions * blocks, "kind", "range", "block").groupBy("kind", "range", "block").applyInPandas(_merge, RUNS), "lm-runs")
    children = min(fan_out, -(-ranges // divisions))
    finer = stage(_summed(_cut_again(merged.where("group = -1"), children, divisions * children), ids, ranges, divisions * children, range_ids, fan_out), "lm-finer")
    parts = finer.where("group >= 0").select("kind", F.floor(F.col("range") / children).cast("long").alias("above"), F.col("group").alias("block"), "range", "background", "target")
    back = merged.where("group >= 0").groupBy("kind", "range", "block").cogroup(parts.groupBy("kind", "above", "block")).applyInPandas(_hand_back, TOTALS)
    return back.unionByName(finer.where("group = -1"))


def totals(groups: DataFrame, ids: int, range_ids: int = RANGE_IDS, fan_out: int = FAN_OUT) -> DataFrame:
    """``TOTALS``: the totals that come back to each group, and rows of group -1 with the distinct ids of each finest range. ``ids``: about how many there are."""
    ranges = max(1, -(-ids // range_ids))
    first = min(ranges, fan_out)
    return _summed(shares(groups, first), ids, ranges, first, range_ids, fan_out)


# ---------------------------------------------------------------- scores
def losses(t: Tokens, totals_: list[list[np.ndarray]], tokens: list[int], texts: list[int], width: int) -> np.ndarray:
    """Bits of each token under background and target; totals_[model][kind] are the totals of the group's ids, own counts still in."""
    size = len(t.words) + 1
    own_w, own_at, own_n = np.unique(t.doc * size + t.w, return_inverse=True, return_counts=True)
    pair_at, pair_n = np.unique(t.doc * (len(t.bigrams) + 1) + t.pair, return_inverse=True, return_counts=True)[1:]
    key_h = t.doc * size + t.h
    spot = np.minimum(np.searchsorted(own_w, key_h), max(0, len(own_w) - 1))
    own_h = np.where((t.h >= 0) & (own_w[spot] == key_h), own_n[spot], 0) if len(own_w) else key_h
    begins = np.where(t.h < 0, 1, own_h)
    out = np.empty((2, len(t.w)))
    for m in (0, 1):
        held = t.flags[m][t.doc]
        words_, pairs = (totals_[m][k].astype(np.float64) for k in (WORD, BIGRAM))
        hist = np.where(t.h < 0, texts[m], words_[t.h] if len(words_) else 0) - begins * held
        uni = (words_[t.w] - own_n[own_at] * held + 1) / (tokens[m] - t.n[t.doc] * held + width + 1)
        out[m] = -np.log2((pairs[t.pair] - pair_n[pair_at] * held + MU * uni) / (hist + MU))
    return out


def score(docs: DataFrame, group_tokens: int = GROUP, range_ids: int = RANGE_IDS, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (bits a token) of ``docs`` (doc_id, text, target, background).

    The flags tell which models count a document; one in neither is only scored.
    """
    groups = stage(grouped(docs, group_tokens), "lm-groups")
    d = F.col("d")
    held = lambda f, x: F.coalesce(F.sum(F.when(d[f], x)), F.lit(0))
    begins = (d["n"] > 0).cast("int") * (d["before"] == 0).cast("int")
    sums = groups.select(F.explode("docs").alias("d")).agg(F.coalesce(F.sum(d["n"]), F.lit(0)), *[held(f, x) for x in (d["n"], begins) for f in ("background", "target")]).first()
    tokens, texts = list(sums[1:3]), list(sums[3:5])
    found = stage(totals(groups, sums[0], range_ids, fan_out), "lm-totals")
    width = found.where(f"group = -1 and kind = {WORD}").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    back = found.where("group >= 0").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("kind", "range", "background", "target"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t = Tokens(row["words"], row["tokens"], row["docs"])
            got = [[np.concatenate([np.zeros(0, np.uint64), *(unpack(x[m], np.uint64) for x in row["found"] or [] if x["kind"] == k)]) for k in (WORD, BIGRAM)] for m in ("background", "target")]
            bits = losses(t, got, tokens, texts, width)
            b, a = (np.bincount(t.doc, x, len(t.n)).astype(np.float64) for x in bits)
            ids = [pa.array([x[c] for x in t.docs], pa.int64()) for c in ("key", "doc_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(t.n), pa.array(a), pa.array(b)], ["key", "doc_id", "n_tokens", "a", "b"])
        release()

    each = groups.join(back, "group", "left").mapInArrow(run, "key long, doc_id long, n_tokens long, a double, b double")
    whole = each.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", mean("a").alias("loss_target"), mean("b").alias("loss_background")).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all of ``docs``: target are those that ``labels`` (doc_id, quality) calls good, background all."""
    return score(marked(docs, labels.where("quality = 1")))
