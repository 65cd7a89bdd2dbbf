import hashlib
import itertools
import random
import re
import sys
import zlib

import pyarrow as pa
import pytest

from speechtab.llm import queries, repair

sys.setrecursionlimit(20_000)
SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """The contract's damage of (conv_id, turn, role, text) rows, row by row; a list per conversation, in order."""
    out = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out.setdefault(c, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(v, key=key) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        cut = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not cut else 2 if (role, text) in seen else 0 if cut[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, repaired lines): every choice of edits, at most three inserts at a place."""
    fault, best = faults(rows), None
    own = [[("D", 3, None)] + ([] if f in (1, 2) else [("K", f // 3, r[1])] + [("R", 2 + f // 3, x) for x in ("user", "assistant")]) for r, f in zip(rows, fault)]
    gaps = [p for n in range(4) for p in itertools.product(("user", "assistant"), repeat=n)]
    for choice in itertools.product(*own):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            roles, lines, edits, cost = [], [], "", 0
            for i, g in enumerate(fill):
                roles += g
                lines += [f"{x}:" for x in g]
                edits += "I" * len(g)
                cost += 2 * len(g)
                if i < len(rows):
                    e, price, role = choice[i]
                    edits += e
                    cost += price
                    if role is not None:
                        roles.append(role)
                        lines.append(f"{role}:{rows[i][2]}")
            if (best is None or (cost, edits) < best[:2]) and SHAPE.fullmatch("".join(r[:1] or "?" for r in roles)):
                best = cost, edits, lines
    return best


def steps(rows):
    """``forward`` over one conversation's rows without Spark."""
    fault = faults(rows)
    names = ["conv_id", "has", "turn", "role", "digest", "fault", "later", "text", "at", "costs"]
    table = [(7, t is not None, t, role, str(i), 3 if f == 2 else f, f == 2, text, None, None) for i, ((t, role, text), f) in enumerate(zip(rows, fault))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) if n != "costs" else pa.array(c, pa.list_(pa.int64())) for n, c in zip(names, zip(*table))], names)
    return [r for b in repair.forward(iter([batch])) for r in b.to_pylist()]


def test_edits_equal_trying_all_choices():
    rng = random.Random(3)
    for n, count in ((1, 60), (2, 60)):
        for _ in range(count):
            rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", "Why?"])) for i in range(n)]
            cost, edits, lines = cheapest(rows)
            got = steps(rows)
            assert ("".join(s["edit"][0] for s in got), sum(s["cost"] for s in got)) == (edits, cost)
            assert [f"{s['role']}:{s['text']}" for s in got if s["role"]] == lines


def reference(rows):
    """Cheapest edits by memoised recursion over (row, last initials), for longer conversations; independent of the vectors."""
    from functools import lru_cache

    fault = faults(rows)
    free = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, last, room):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        if room:
            c, e = go(i, free[last], room - 1)
            found.append((c + 2, "I" + e))
        if i < len(rows):
            more, x = fault[i] // 3, rows[i][1][:1]
            c, e = go(i + 1, last, 3)
            found.append((c + 3, "D" + e))
            if fault[i] in (0, 3):
                if x and (x == free[last] or (x == "s" and last == "")):
                    c, e = go(i + 1, x, 3)
                    found.append((c + more, "K" + e))
                c, e = go(i + 1, free[last], 3)
                found.append((c + 2 + more, "R" + e))
        return min(found, default=(10**9, ""))

    return go(0, "", 3)


def expected(rows):
    fault = faults(rows)
    cost, edits = reference(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    out, i, last = [], 0, ""
    for e in edits:
        role = "assistant" if last == "u" else "user"
        if e == "I":
            out.append(f"{role}:")
        elif e != "D":
            role = rows[i][1] if e == "K" else role
            out.append(f"{role}:{rows[i][2]}")
        last = last if e == "D" else role[0]
        i += e != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("whole", [repair.WHOLE, 2])
def test_table_equals_a_loop(spark, monkeypatch, whole):
    """With and without checkpoints; long conversations, nulls, ties, repeated rows and a clashing column."""
    monkeypatch.setattr(repair, "WHOLE", whole)
    rng = random.Random(whole)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None, "", "umpire"]), rng.choice(["A.", "b", None, "", "Ça?", " \t", "x!\n"])) for c in (1, 2, None, 4, 5) for t in range(rng.choice([1, 3, 40]))]
    rows += [(6, t % 90, "user" if t % 2 else "assistant", rng.choice(["hm.", "oh", "", "no!"])) for t in range(300)]
    rows += [(8, 3, "user", "same.")] * 30 + [(9, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, step int").repartition(5)
    assert result(repair.repaired_digests(df)) == {c: expected(v) for c, v in damaged(rows).items()}


def test_checkpoints_are_square_root(spark):
    rows = [(1, True, t, "user", str(t), 3 * (t % 2), False, 400) for t in reversed(range(400))]
    names = ["conv_id", "has", "turn", "role", "digest", "fault", "later", "n"]
    got = [r for b in repair.checkpoints(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)])) for r in b.to_pylist()]
    assert [r["at"] for r in got] == list(range(380, 0, -20))


def test_query_equals_sql(spark, same):
    same(queries.queries()["op11_conversation_repair"], queries.oracle_sql()["op11_conversation_repair"])


def test_steps_carry_the_texts_and_empty_tables_give_none(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Hm"), (2, 0, "user", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    got = repair.repair(df).orderBy("conv_id", "step").collect()
    assert [(r["edit"], r["role"], len(r["text"])) for r in got if r["conv_id"] == 2] == [("Delete", None, 300_000)]
    assert {r["fault"] for r in got} == {"", "truncated"}
    assert repair.repair(df.limit(0)).collect() == [] and repair.repaired_digests(df.limit(0)).collect() == []
