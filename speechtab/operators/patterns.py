"""Many patterns at once: a trie with failure links, run over a batch of sequences in lock step.

Patterns are cut into parts of about ``PART_SYMBOLS`` symbols; each part becomes one automaton of sorted arrays (about 24 bytes a symbol), which
travels to the tasks as a broadcast of that bounded size. More patterns mean more parts, never a larger one. A batch's sequences are cut
into pieces that overlap by the longest pattern, and one step of numpy moves all pieces by a symbol, so neither the number of patterns nor a
very long sequence changes the work per symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_SYMBOLS = 1 << 20
PIECE = 512
NONE = -1


class Automaton:
    """Finds all occurrences of distinct non-empty integer patterns."""

    def __init__(self, patterns: list[np.ndarray]):
        sizes = np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate(patterns).astype(np.int64) if len(patterns) else np.zeros(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        self.longest, self.alphabet = int(sizes.max(initial=0)), int(flat.max(initial=0)) + 1
        self.sizes, at = sizes, np.zeros(len(patterns), np.int64)
        keys, levels, count = [], [], 1
        ends = [np.array([NONE], np.int64)]
        for depth in range(self.longest):
            own = np.flatnonzero(sizes > depth)
            key, child = np.unique(at[own] * self.alphabet + flat[begin[own] + depth], return_inverse=True)
            at[own] = count + child
            last = np.full(len(key), NONE, np.int64)
            done = sizes[own] == depth + 1
            last[child[done]] = own[done]
            keys.append(key)
            ends.append(last)
            levels.append((count, count + len(key)))
            count += len(key)
        # nodes are numbered by depth and then by key, so that the keys of all levels are sorted already
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.end = np.concatenate(ends)
        self.fail = np.zeros(count, np.int64)
        self.hit = np.full(count, NONE, np.int64)
        for lo, hi in levels:
            parent, symbol = np.divmod(self.keys[lo - 1 : hi - 1], self.alphabet)
            self.fail[lo:hi] = np.where(parent == 0, 0, self.step(self.fail[parent], symbol))
            self.hit[lo:hi] = np.where(self.end[lo:hi] != NONE, np.arange(lo, hi), self.hit[self.fail[lo:hi]])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; symbols outside the alphabet lead to the root."""
        out = np.zeros(len(state), np.int64)
        todo = np.flatnonzero((symbol >= 0) & (symbol < self.alphabet))
        state, symbol = state[todo], symbol[todo]
        while len(todo) and len(self.keys):
            key = state * self.alphabet + symbol
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            out[todo[found]] = place[found] + 1
            more = ~found & (state != 0)
            todo, state, symbol = todo[more], self.fail[state[more]], symbol[more]
        return out

    def find(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, start, pattern) of every occurrence in sequences offsets[i]..offsets[i + 1] of ``symbols``."""
        symbols = np.asarray(symbols, np.int64)
        size, overlap = np.diff(offsets), max(0, self.longest - 1)
        pieces = np.maximum(1, -(-size // PIECE))
        row = np.repeat(np.arange(len(size)), pieces)
        own = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE  # where a piece's own symbols begin
        at = np.maximum(own - overlap, 0)
        until = np.minimum(own + PIECE, size[row])
        order = np.argsort(at - until, kind="stable")  # longest first: the pieces still running are a prefix
        row, own, at, until = row[order], own[order], at[order], until[order]
        length, state, found = until - at, np.zeros(len(row), np.int64), []
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k, "left"))
            state[:n] = self.step(state[:n], symbols[offsets[row[:n]] + at[:n] + k])
            live = np.flatnonzero((self.hit[state[:n]] != NONE) & (at[:n] + k >= own[:n]))
            node = self.hit[state[live]]
            while len(live):
                pattern = self.end[node]
                found.append((row[live], at[live] + k + 1 - self.sizes[pattern], pattern))
                node = self.hit[self.fail[node]]
                live, node = live[node != NONE], node[node != NONE]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def parts(patterns: DataFrame, key: Column, size: Column) -> Iterator[list]:
    """The rows of ``patterns`` in lists of about ``PART_SYMBOLS`` symbols, dealt by a hash of ``key``; one list at a time is on the driver."""
    total = patterns.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = max(1, -(-total // PART_SYMBOLS))
    for k in range(n if total else 0):
        some = patterns.where(F.pmod(F.xxhash64(key), F.lit(n)) == k).collect() if n > 1 else patterns.collect()  # bounded by the part's size
        if some:
            yield some


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in one array, and where each begins (and the end); null counts as empty."""
    coded = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(coded), np.uint32).astype(np.int64), np.append(0, np.cumsum([len(c) // 4 for c in coded])).astype(np.int64)
