"""Byte-level BPE encoding and decoding over a column of texts.

A short word is a row of two contiguous arrays: its parts and the ranks of adjacent parts. Each round
scans every row for its smallest rank, deletes the boundary there and refreshes the two neighbouring
ranks, for all new words of a few hundred documents at once. A long word (over ``LONG`` bytes) merges
in the same order through a heap, so no word costs the square of its length. Words repeat, so each
Python worker keeps a bounded map from word to ids.

Null and empty texts have no tokens and decode to the empty text. Special-token strings in a text
become their own id, as the library does by default; ids outside the vocabulary raise KeyError.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from speechtab.llm.common import release

#: The published word pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same words by the faster standard matcher, for texts without ODD characters.
PLAIN = re.compile(r""" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:(?!\s)[\W_])+|\s+(?!\S)|\s+""")


def odd_characters() -> str:
    """Characters of the basic plane on which the two matchers differ: numbers that are not decimal digits, and the four separators that only one takes for blanks."""
    numbers = (chr(i) for i in range(0x10000) if chr(i).isalnum() and not chr(i).isalpha() and not chr(i).isdecimal())
    return "[\x1c-\x1f" + "".join(map(re.escape, numbers)) + "]"


#: Bytes from which a word merges through a heap.
LONG = 96
#: Documents encoded together.
TOGETHER = 256
NONE = 1 << 30
#: Words that a worker remembers before it starts its map afresh; each task ends by forgetting them, as workers live on.
REMEMBERED = 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: printable Latin-1 bytes are themselves, others count up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary, given as the text of its JSON file."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"] if token not in self.special}
        self.id_of = {as_bytes[token]: i for token, i in spec["model"]["vocab"].items() if token in as_bytes}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.rank = {(as_bytes[a], as_bytes[b]): k for k, (a, b) in enumerate(pairs)}
        keys = np.array([self.id_of[a] << 32 | self.id_of[b] for a, b in self.rank], np.int64)
        self.order = np.argsort(keys).astype(np.int32)  # rank of each pair, by key
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, NONE).astype(np.int32)
        self.joined = np.array([self.id_of[a + b] for a, b in self.rank], np.int64)
        self.single = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.first = self.ranks(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        self.full, self.odd = regex.compile(PATTERN).findall, re.compile(odd_characters()).search
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        count = max(self.bytes_of) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(count)])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(count)), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of part ids; NONE where the pair does not merge (id -1: past the word's end)."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (b >= 0), self.order[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of up to LONG bytes and about equal length, one row each."""
        n, width = np.array(list(map(len, words))), max(map(len, words)) + 1
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        col = np.arange(width)
        parts = np.where(col < n[:, None], self.single[raw], -1)
        rank = np.where(col[:-1] < n[:, None] - 1, self.first[raw[:, :-1], raw[:, 1:]], NONE)
        out = [b""] * len(words)
        row = np.arange(len(words))
        while len(row):
            at = rank.argmin(1)
            every = np.arange(len(row))
            least = rank[every, at]
            ended = least == NONE
            if ended.any():
                done, size = parts[ended].astype("<u4"), 4 * (parts[ended] >= 0).sum(1)
                flat, wide = done.tobytes(), 4 * width
                for i, (r, k) in enumerate(zip(row[ended].tolist(), size.tolist())):
                    out[r] = flat[i * wide : i * wide + k]
                go = ~ended
                row, parts, rank, at, least = row[go], parts[go], rank[go], at[go], least[go]
                every = np.arange(len(row))
                if not len(row):
                    break
            after = at[:, None] + 1
            left = parts[:, :-1]
            parts = np.column_stack([np.where(col[:-1] >= after, parts[:, 1:], left), np.full(len(row), -1)])
            parts[every, at] = joined = self.joined[least]
            rank = np.column_stack([np.where(col[:-2] >= at[:, None], rank[:, 1:], rank[:, :-1]), np.full(len(row), NONE)])
            rank[every, at] = self.ranks(joined, parts[every, at + 1])
            inner = np.flatnonzero(at)
            rank[inner, at[inner] - 1] = self.ranks(parts[inner, at[inner] - 1], joined[inner])
        return out

    def learn(self, words: set[str]) -> None:
        """Adds the ids of new words to the map."""
        raw = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        short = [x for x in raw if len(x[0]) <= LONG]
        lo = 0
        while lo < len(short):
            size = len(short[lo][0])
            hi = lo
            while hi < len(short) and hi - lo < 20_000 and len(short[hi][0]) <= size + size // 2:
                hi += 1
            self.known.update(zip([w for _, w in short[lo:hi]], self.merge_short([b for b, _ in short[lo:hi]])))
            lo = hi
        self.known.update((w, self.merge_long(b)) for b, w in raw[len(short) :])

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for a long word: a heap of (rank, position) over a linked list of parts."""
        n, rank = len(word), self.rank.get
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([self.id_of[p] for p in parts if p is not None], "<u4").tobytes()

    def find(self, text: str) -> list[str]:
        return self.full(text) if self.odd(text) or self.beyond(text) else PLAIN.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special strings stand for themselves."""
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self.find(text)
        out: list[str] = []
        at = 0
        for m in found:
            out += [*self.find(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.find(text[at:])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not self.known:
            self.known.update((s, np.array([i], "<u4").tobytes()) for s, i in self.special.items())
        new = set().union(*words).difference(self.known)
        if new:
            self.learn(new)
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, w)), "<u4") for w in words]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of an array of ids; bytes that are no UTF-8 become the replacement character."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise KeyError("id outside the vocabulary")
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.places[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)
        return self.letters[at].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The worker's codec for a file that the driver sent with the job."""
    if name not in _CODECS:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _CODECS[name] = Codec(f.read())
    return _CODECS[name]


def send(spark, vocabulary_path: str) -> str:
    """Ship the vocabulary (fixed size, a few MB) to the executors once; returns its name there."""
    name = vocabulary_path.rstrip("/").rpartition("/")[2]
    spark.sparkContext.addFile(vocabulary_path)
    return name


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: one row per row of ``df``, no shuffle."""
    name = send(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [x.astype(np.int32) for at in range(0, len(texts), TOGETHER) for x in c.encode_many(texts[at : at + TOGETHER])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])
        c.known.clear()
        release()

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the inverse of ``encode`` on valid texts; a null list decodes to the empty text."""
    name = send(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for b in batches:
            texts = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode those ids, in one pass over each text."""
    name = send(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(name), hashlib.sha256
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for at in range(0, b.num_rows, TOGETHER):
                for ids in c.encode_many([t or "" for t in b.column(1).slice(at, TOGETHER).to_pylist()]):
                    counts.append(len(ids))
                    ids_sha.append(sha(ids.tobytes()).hexdigest())
                    text_sha.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.known.clear()
        release()

    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def ranks_of(tiktoken_file: str) -> dict[bytes, int]:
    """Rank table of a ``base64 rank`` file (for tests against another published form of the vocabulary)."""
    with open(tiktoken_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
