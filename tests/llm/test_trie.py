import hashlib
import random
import zlib

import pytest

from speechtab.llm import queries, trie


def loop(rows):
    """The contract's nodes by rebuilding every conversation."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
    for v in own.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))
    own = {c: [(r, x) for _, r, x in v] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        full[c] = own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)

    def under(n):
        return [n] + [x for k in children.get(n, []) for x in under(k)]

    out = set()
    for n, members in nodes.items():
        below = under(n)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(n))))
        out.add((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children.get(n, [])), sum(x not in children for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    got = df.collect()
    as_set = {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got}
    assert len(as_set) == len(got)
    return as_set


@pytest.mark.parametrize("piece", [trie.PIECE, 4])
def test_nodes_equal_rebuilt_texts(spark, monkeypatch, piece):
    """Copies, nulls, ties, repeated rows, negative and missing ids and bases, long conversations over several partitions, a clashing column."""
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = random.Random(piece)
    rows = []
    for c in [*range(0, 40, rng.choice([1, 2])), -7, -5, 1001, None]:
        n = rng.choice([1, 2, 5, 12])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None])) for t in range(n)]
    rows += [(c, t, "user", "hello there") for c in range(50, 75) for t in range(10)]
    rows += [(c, t, "user", str(t % 7)) for c in (80, 81, 83) for t in range(200)] + [(90, 1, "user", "twice")] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(7)
    assert rows_of(trie.trie(df)) == loop(rows)


def test_a_collision_is_seen_and_drawn_again(spark, monkeypatch):
    """With a multiplier of 1 a fingerprint is blind to the order of turns, so different conversations share it."""
    drawn, draws = trie.multipliers, []
    monkeypatch.setattr(trie, "multipliers", lambda draw: draws.append(draw) or ([1] * trie.PARTS if draw == 0 else drawn(draw)))
    rows = [(c, t, "user", "abcdefghijkl"[(t * (c % 3 * 2 + 5)) % 12]) for c in range(12) for t in range(12)]
    assert rows_of(trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == loop(rows) and 1 in draws


def test_query_equals_sql(same):
    same(queries.queries()["op12_prefix_trie"], queries.oracle_sql()["op12_prefix_trie"])


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(5, 0, "user", "x" * 400_000), (6, 0, "user", "x" * 400_000)], "conv_id long, turn long, role string, text string")
    assert rows_of(trie.trie(df)) == loop([tuple(r) for r in df.collect()])
    assert trie.trie(df.limit(0)).collect() == []
