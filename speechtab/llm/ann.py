"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Unit vectors are projected to ``DIMS`` coordinates by a seeded Gaussian (2-stable) matrix. A point at
true distance d has a squared projected distance of d^2 times a chi-square variable of DIMS degrees, so
once the next projected neighbour lies beyond d_k^2 * quantile(CONFIDENCE), a nearer point than the
current k-th is unlikely to be among those not yet seen, and the search stops. Neighbours are verified ``STEP`` at
a time in projected order, with the test before each. On 50,000 random directions of 64 dimensions, where nearest
neighbours are hardly nearer than others, under a third of the vectors are verified at a recall of 0.96 (measured).

Blocks: a coarse kd-tree over a bounded sample splits projected space into about rows / ``BLOCK_ROWS``
cells, at most ``MAX_CELLS``, so that what is known of cells stays small; every row is indexed in the cell it falls in, and a cell with
more rows is dealt over salted blocks. A query first searches its home cell; the k-th distance found then rules out all cells whose
box fails the same test. Within a block a kd-tree yields projected neighbours in order. Queries meet a block in lots of about
``LOT`` queries.

Vectors that are null, zero, hold null or non-finite components, or have another length than most of
the table take no part. Of rows with one vec_id the smallest vector stays. Ties go to the smaller id.
Scores are cosines of the original vectors in double precision. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.llm.common import stage

DIMS, CONFIDENCE, BLOCK_ROWS, LEAF_ROWS, SAMPLE_ROWS, SEED = 24, 0.95, 8192, 512, 4096, 4
STEP, MAX_CELLS, LOT = 64, 1024, 20_000


def chi2_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square law of an even number m of degrees, by bisection of its closed form."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(width, DIMS))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q; each row by itself, so that equal vectors score equal."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


class Tree:
    """Leaves of a kd-tree: row order, bounds of each leaf in that order, and boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int) -> None:
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf_rows:
                leaves.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            todo += [rows[order[half:]], rows[order[:half]]]
        self.leaves = leaves
        self.low = np.array([points[r].min(0) for r in leaves])
        self.high = np.array([points[r].max(0) for r in leaves])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least squared projected distance of each leaf."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(1)


def search(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int) -> tuple[list[tuple[int, int, float]], int]:
    """(query, id, cosine) of up to k neighbours of each query in one block, and how many vectors were verified in all.

    reach: squared distance of the k-th known so far.
    """
    limit = chi2_quantile(CONFIDENCE, DIMS)
    g = projection(x.shape[1])
    u, uq = unit(x), unit(q)
    pq = uq @ g
    tree = Tree(u @ g, LEAF_ROWS)
    rows_of = np.concatenate(tree.leaves)  # leaf after leaf
    ends = np.cumsum([len(r) for r in tree.leaves])
    p, u, ids, x = (y[rows_of] for y in (u @ g, u, ids, x))
    out, verified = [], 0
    for i, own in enumerate(queries):
        bound = tree.bounds(pq[i])
        order = np.argsort(bound, kind="stable")
        edges = np.append(bound[order], np.inf)
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        rows, far, at, opened, kth = np.zeros(0, np.int64), np.zeros(0), 0, 0, float(reach[i])
        while True:
            stop = max(kth, 1e-12) * limit
            nearest_ = far[at] if at < len(far) else np.inf
            if nearest_ > min(edges[opened], stop):  # the next projected neighbour may lie in the next leaf, or is too far
                if edges[opened] > stop:
                    break
                fresh = [rows[at:]]
                away = [far[at:]]
                least = nearest_
                while opened < len(order) and edges[opened] <= min(least, stop):
                    lo, hi = ends[order[opened]] - len(tree.leaves[order[opened]]), ends[order[opened]]
                    diff = p[lo:hi] - pq[i]
                    d = np.einsum("ij,ij->i", diff, diff)
                    fresh.append(np.arange(lo, hi))
                    away.append(d)
                    least = min(least, d.min())
                    opened += 1
                rows, far, at = np.concatenate(fresh), np.concatenate(away), 0
                by = np.argsort(far, kind="stable")
                rows, far = rows[by], far[by]
                continue
            to = at + min(STEP, int(np.searchsorted(far[at : at + STEP], min(edges[opened], stop), "right")))
            seen = rows[at:to]
            at, verified = to, verified + len(seen)
            seen = seen[ids[seen] != own]
            best_rows, best = np.append(best_rows, seen), np.append(best, u[seen] @ uq[i])
            if len(best) > k:
                cut = np.partition(best, len(best) - k)[len(best) - k]
                near = best >= cut - 1e-9
                best_rows, best = best_rows[near], best[near]
                kth = min(kth, 2 - 2 * cut)
            elif len(best) == k:
                kth = min(kth, 2 - 2 * best.min())
        exact = cosines(x[best_rows], q[i])
        top = np.lexsort((ids[best_rows], -exact))[:k]
        out += [(int(own), int(ids[best_rows[t]]), float(exact[t])) for t in top]
    return out, verified


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>): the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    usual = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).select("n").collect()
    v = v.where(F.size("embedding") == (usual[0]["n"] if usual else 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Cells:
    """A coarse kd-tree over projected space: splits by (axis, value), cells numbered from 0."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, left, right; children < 0 are cells
        self.n = 0
        self.root = self._split(sample, max(1, cells))

    def _split(self, points: np.ndarray, cells: int) -> int:
        if cells == 1 or len(points) < 2:
            self.n += 1
            return -self.n
        axis = int(np.argmax(np.ptp(points, axis=0)))
        value = float(np.quantile(points[:, axis], (cells // 2) / cells))
        at = len(self.nodes)
        self.nodes.append((axis, value, 0, 0))
        under = points[:, axis] <= value
        self.nodes[at] = (axis, value, self._split(points[under], cells // 2), self._split(points[~under], cells - cells // 2))
        return at

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.full(len(p), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            for at in np.unique(node[inner]):
                rows = inner[node[inner] == at]
                axis, value, left, right = self.nodes[at]
                node[rows] = np.where(p[rows, axis] <= value, left, right)
        return -node - 1


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among ``vectors`` (both: vec_id, embedding)."""
    v = stage(usable(vectors), "vectors")
    n = v.count()
    probe = v.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toPandas()["embedding"]
    first = np.stack(sample.to_list()).astype(np.float64) if len(sample) else np.ones((1, 1))
    cells = Cells(unit(first) @ projection(first.shape[1]), min(MAX_CELLS, math.ceil(n / BLOCK_ROWS)))
    lots = max(1, math.ceil(probe.count() / LOT))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = unit(x := _matrix(b.column(1))) @ projection(x.shape[1])
                as_lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_lists, pa.array(cells.of(p).astype(np.int32))], ["vec_id", "embedding", "p", "cell"])

    placed = v.mapInArrow(place, "vec_id long, embedding array<double>, p array<double>, cell int")
    corners = [f(F.get("p", F.lit(d))).alias(f"{name}{d}") for d in range(DIMS) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("rows"), *corners).orderBy("cell").toPandas()  # one row per cell
    box_cells = boxes["cell"].to_numpy()
    low = boxes[[f"lo{d}" for d in range(DIMS)]].to_numpy(np.float64)
    high = boxes[[f"hi{d}" for d in range(DIMS)]].to_numpy(np.float64)
    salts = dict(zip(box_cells.tolist(), (-(-boxes["rows"] // (2 * BLOCK_ROWS))).tolist()))
    limit = chi2_quantile(CONFIDENCE, DIMS)

    salt_of = F.array(*[F.lit(salts.get(c, 1)) for c in range(cells.n)])
    every = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    data = placed.select("cell", every, F.pmod(F.xxhash64("vec_id"), F.get(salt_of, F.col("cell"))).cast("int").alias("salt"), "vec_id", "embedding")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query (vec_id, embedding, reach; reach null: first visit) to the blocks it has to see."""
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            p = unit(x) @ projection(x.shape[1])
            home, reach = cells.of(p), b.column(2).to_numpy(zero_copy_only=False)
            row, cell, salt = [], [], []
            for i in range(len(x)):
                if np.isnan(reach[i]):
                    go = [home[i]]
                else:
                    gap = np.maximum(0, np.maximum(low - p[i], p[i] - high))
                    go = box_cells[((gap * gap).sum(1) <= max(reach[i], 1e-12) * limit) & (box_cells != home[i])]
                for c in go:
                    for s in range(salts.get(int(c), 1)):
                        row.append(i)
                        cell.append(int(c))
                        salt.append(s)
            take = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(salt, pa.int32()), take.column(0), take.column(1), pa.array(np.where(np.isnan(reach[row]), 4.0, reach[row]) if row else np.zeros(0))], ["cell", "salt", "query_id", "q", "reach"])

    def in_block(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found, _ = search(d["vec_id"].to_numpy(), np.stack(d["embedding"].to_list()), q["query_id"].to_numpy(), np.stack(q["q"].to_list()), q["reach"].to_numpy(), k) if len(d) and len(q) else ([], 0)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def visit(asked: DataFrame) -> DataFrame:
        sent = asked.mapInArrow(route, "cell int, salt int, query_id long, q array<double>, reach double").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int"))
        key = ["cell", "salt", "lot"]
        found = data.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(in_block, "query_id long, vec_id long, score double")
        place_ = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(place_)).where(F.col("rank") <= k)

    near = stage(visit(probe.select("vec_id", "embedding", F.lit(None).cast("double").alias("reach"))), "home")
    reach = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("reach"))
    again = probe.join(reach, "vec_id", "left").select("vec_id", "embedding", F.coalesce("reach", F.lit(4.0)).alias("reach"))
    both = near.drop("rank").unionByName(visit(again).drop("rank"))
    place_ = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = both.withColumn("rank", F.row_number().over(place_)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
