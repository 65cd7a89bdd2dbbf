"""Shared pieces: staged tables, size-checked broadcast joins and batch word hashing.

Words are hashed for a whole Arrow batch at once from its UTF-8 buffer, so no Python loop runs per
word. A word's 64-bit id is a polynomial over random byte codes, finished by a bit mixer.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.session import shared_dir

U64 = np.uint64
#: Bytes of text that one numpy pass covers; a longer document is cut at blanks.
SLICE_BYTES = 1 << 18


# ---------------------------------------------------------------- staged tables
def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    Cuts lineage: a lost executor costs a reread, not a recomputation. Removed by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/speechtab-stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no plan still to run reads; others are left alone."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            _delete(t.sparkSession, path)


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Python workers get at most ``rows`` rows at once, which bounds what a batch of long texts takes; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged (shuffle join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_rows(df: DataFrame, run) -> DataFrame:
    """``df`` through a function of record batches that keeps the columns, whatever their names (columns are numbered inside)."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def release() -> None:
    """Gives freed memory of Arrow, numpy and Python back at the end of a task: Python workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, memory stays with the worker
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- word hashing
def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CODES_FOLDED = _CODES[_FOLD]
_POW = {"p": np.ones(1, np.uint64)}

#: Which bytes belong to words: everything but blank and \t..\r.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Which bytes belong to letter runs: A-Z, a-z and all of a multi-byte character.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def _powers(n: int) -> np.ndarray:
    if len(_POW["p"]) < n:
        base = np.full(max(n, 2 * len(_POW["p"])), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POW["p"] = np.multiply.accumulate(base)
    return _POW["p"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null counts as empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return offs, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _hashed(b: np.ndarray, at: np.ndarray, in_word: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of the bytes ``b``, and the number of words of each document (``at``: where they begin, and the end)."""
    inside = in_word[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = at[:-1][at[:-1] < at[1:]]
    first[opens] = inside[opens]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, at))
    if len(starts) == 0:
        return np.zeros(0, np.uint64), counts
    w = b[inside]
    begin = np.cumsum(inside)[starts] - 1
    length = np.diff(np.append(begin, len(w)))
    within = np.arange(len(w)) - np.repeat(begin, length)
    h = np.add.reduceat(codes[w] * _powers(int(length.max()))[within], begin)
    return mix(h ^ (length.astype(np.uint64) * U64(0xD6E8FEB86659FD93))), counts


def _ends(b: np.ndarray, in_word: np.ndarray, most: int) -> Iterator[int]:
    """Cuts of a long document at bytes outside words, about ``most`` apart (farther only where a word is longer)."""
    at = 0
    while len(b) - at > most:
        outside = np.flatnonzero(~in_word[b[at : at + most]])
        step = most
        while not len(outside) and at + step < len(b):
            outside = step + np.flatnonzero(~in_word[b[at + step : at + step + most]])[:1]
            step += most
        if not len(outside):
            break
        at += int(outside[-1]) + 1
        yield at
    yield len(b)


def words(texts: pa.Array, in_word: np.ndarray = NON_SPACE, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of documents lo..hi: the word ids in order, and the number of words of each document.

    A document over ``SLICE_BYTES`` is a slice by itself, hashed piece by piece: what it needs beyond its ids does not grow with it.
    """
    offs, data = buffers(texts)
    codes, n, lo = (_CODES_FOLDED if fold else _CODES), len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        b, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        if len(b) <= SLICE_BYTES:
            yield lo, hi, *_hashed(b, at, in_word, codes)
        else:
            cuts = [0, *_ends(b, in_word, SLICE_BYTES)]
            ids = np.concatenate([_hashed(b[x:y], np.array([0, y - x]), in_word, codes)[0] for x, y in zip(cuts, cuts[1:])])
            yield lo, hi, ids, np.array([len(ids)])
        lo = hi


def distinct_per_doc(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, id) pairs."""
    order = np.lexsort((ids, doc))
    doc, ids = doc[order], ids[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])
    return doc[keep], ids[keep]
