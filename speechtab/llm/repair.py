"""Conversation structure repair: cheapest edits by a dynamic programme with square-root checkpoints.

``repair`` takes any table of conv_id, turn, role, text. A conversation is its rows by turn (null first; rows of one turn by role,
then by the text's SHA-256). A row's fault is the first of: blank (no character but space and \\t..\\r), duplicate (its role and text came
earlier), truncated (its last such character is none of ``.!?``). Edits are Keep (0), Rerole to user or assistant (2), Delete (3, the
only one for blank and duplicate rows), Insert of an empty user or assistant turn (2); a truncated row that stays adds 1. The edited roles'
initials must read ``(s?(ua)+)?``, which four states check: nothing yet, after s, after u, after a.

The cost of the rest of a conversation from each state is a vector of four numbers. A first pass goes backward over rows without texts,
in conversations of more than ``WHOLE`` rows only, and keeps the vectors before each ceil(sqrt(n))-th row. The second pass reads a conversation's
checkpoints, then its rows forward: it holds one block of rows, recomputes the block's vectors from the checkpoint behind it, and
takes at each step the tight edit whose initial is least (D, I, K, R). So a task holds sqrt(n) vectors and sqrt(n) rows of a conversation of n.
Whether a row repeats an earlier one is found by grouping (conversation, role, digest), which splits any one conversation over tasks.

Null roles and texts are one space (so such rows are blank, or of no known role); a null conv_id is a conversation of its own, and a null turn comes
first. Equal rows are duplicates of the first. Empty tables give no rows. Further columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import small, stage

WHOLE = 64
#: Of the duplicates' and the long conversations' tables, rows that may be broadcast.
BROADCAST_ROWS = 200_000
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, S, U, A = range(4)
#: State after a turn with this initial, where one is allowed.
KEEPS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
#: State after a turn whose role is free, and that role.
FREE = {START: (U, "user"), S: (U, "user"), U: (A, "assistant"), A: (U, "user")}
FAULTS = ("", "blank", "duplicate", "truncated")
ROWS_OUT, CHARS_OUT = 8192, 1 << 23
STEPS = "conv_id long, step long, edit string, fault string, cost int, turn long, was string, role string, text string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32("conv_id:turn") mod 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it user's; nulls are one space."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


# ---------------------------------------------------------------- costs
def relaxed(v: list[float]) -> tuple[float, ...]:
    """Costs from each state once turns may also be inserted here."""
    u, a = min(v[U], INSERT + v[A]), min(v[A], INSERT + v[U])
    return min(v[START], INSERT + u), min(v[S], INSERT + u), u, a


END = relaxed([0, math.inf, math.inf, 0])


def options(state: int, initial: str, fault: int, after: tuple[float, ...]) -> Iterator[tuple[str, float, int]]:
    """(edit, its cost, next state) of each edit of a row."""
    yield "Delete", DELETE, state
    if fault not in (1, 2):
        more = TRUNCATED * (fault == 3)
        to = KEEPS.get(initial, {}).get(state)
        if to is not None:
            yield "Keep", more, to
        yield "Rerole", REROLE + more, FREE[state][0]


def before(initial: str, fault: int, after: tuple[float, ...]) -> tuple[float, ...]:
    """The vector before a row from that behind it."""
    return relaxed([min(c + after[to] for _, c, to in options(s, initial, fault, after)) for s in range(4)])


# ---------------------------------------------------------------- passes
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _marked(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(row, whether it equals the one before in conversation, turn, role and digest)."""
    last = None
    for r in rows:
        yield r, r[:5] == last
        last = r[:5]


def checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward over (conv_id, has turn, turn, role, digest, fault, later, n): (conv_id, at, vector before row at)."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["conv_id", "at", "costs"])
        out.clear()
        return b

    def step(row: tuple, twin: bool) -> None:
        """``twin``: the row before it is its equal."""
        nonlocal v, at
        v = before(row[3][:1], row[5] if row[5] == 1 else 2 if row[6] or twin else row[5], v)
        at -= 1
        if at and at % every == 0:
            out.append((row[0], at, list(v)))

    held, v, at, every = None, END, 0, 1
    for r in _rows(batches):
        if held is not None:
            step(held, held[:5] == r[:5])
        if held is None or held[0] != r[0]:
            v, at, every = END, r[7], math.isqrt(r[7] - 1) + 1
        held = r
        if len(out) >= ROWS_OUT:
            yield flush()
    if held is not None:
        step(held, False)
    if out:
        yield flush()


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (conv_id, has turn, turn, role, digest, fault, later, text, at, costs), a conversation's checkpoints first: its steps in order."""
    out: list[tuple] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal chars
        b = pa.RecordBatch.from_pylist([dict(zip(NAMES, x)) for x in out], schema=ARROW)
        out.clear()
        chars = 0
        return b

    def emit(edit: str, fault: int, cost: float, turn: int | None, was: str | None, role: str | None, text: str) -> None:
        nonlocal steps, chars
        out.append((conv, steps, edit, FAULTS[fault], int(cost), turn, was, role, text))
        steps += 1
        chars += len(text)

    def insert() -> None:
        nonlocal state
        state, role = FREE[state]
        emit("Insert", 0, INSERT, None, None, role, "")

    def walk(behind: tuple[float, ...]) -> None:
        """Emits the block's edits, given the vector behind it."""
        nonlocal state
        vectors = [behind]
        for _, role, _, fault in reversed(block):
            vectors.append(before(role[:1], fault, vectors[-1]))
        for turn, role, text, fault in block:
            here, after = vectors.pop(), vectors[-1]
            while True:
                tight = {e: (c, to) for e, c, to in options(state, role[:1], fault, after) if c + after[to] == here[state]}
                if "Delete" in tight:
                    emit("Delete", fault, DELETE, turn, role, None, text)
                elif INSERT + here[FREE[state][0]] == here[state]:
                    insert()
                    continue
                else:
                    edit = "Keep" if "Keep" in tight else "Rerole"
                    cost, to = tight[edit]
                    emit(edit, fault, cost, turn, role, role if edit == "Keep" else FREE[state][1], text)
                    state = to
                break
        block.clear()

    def close() -> None:
        walk(END)
        while END[state]:
            insert()

    conv, open_, steps, state, at = None, False, 0, START, 0
    block: list[tuple] = []
    marks: dict[int, tuple] = {}
    for r, twin in _marked(_rows(batches)):
        if not open_ or r[0] != conv:
            if open_:
                close()
            conv, open_, steps, state, at, marks = r[0], True, 0, START, 0, {}
        if r[9] is not None:
            marks[r[8]] = tuple(r[9])
            continue
        if at in marks:
            walk(marks[at])
        at += 1
        block.append((r[2], r[3], r[7], r[5] if r[5] == 1 else 2 if r[6] or twin else r[5]))
        if len(out) >= ROWS_OUT or chars >= CHARS_OUT:
            yield flush()
    if open_:
        close()
    if out:
        yield flush()


NAMES = [x.split()[0] for x in STEPS.split(", ")]
ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in STEPS.split(", ")])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit, in order: conv_id, step (from 0), edit, fault, cost, turn and role (``was``) of the row, its repaired role (null if deleted), text.

    A conversation's edits lie together and in order in one partition.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("fault", F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3))
    rows = stage(rows, "repair-rows")
    place = F.struct("has", "turn")
    seen = rows.where("fault <> 1").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    seen = small(stage(seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "repair-seen"), BROADCAST_ROWS)
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce((F.col("has") & ~F.col("first.has")) | (F.col("turn") > F.col("first.turn")), F.lit(False))
    rows = rows.select("conv_id", "has", "turn", "role", "digest", "fault", later.alias("later"), "text")
    long_ = small(rows.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > WHOLE), BROADCAST_ROWS)
    order = ["conv_id", "has", "turn", "role", "digest"]
    slim = rows.drop("text").join(long_, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    marks = slim.repartition("conv_id").sortWithinPartitions("conv_id", *(F.desc(c) for c in order[1:])).mapInArrow(checkpoints, "conv_id long, at long, costs array<long>")
    none = F.lit(None)
    marks = marks.select("conv_id", *(none.cast(t).alias(c) for c, t in (("has", "boolean"), ("turn", "long"), ("role", "string"), ("digest", "string"), ("fault", "int"), ("later", "boolean"), ("text", "string"))), "at", "costs")
    both = marks.unionByName(rows.withColumns({"at": none.cast("long"), "costs": none.cast("array<long>")}))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("has").asc_nulls_first(), *order[2:]).mapInArrow(forward, STEPS)


def summary(steps: DataFrame) -> DataFrame:
    """Per conversation of ``repair``'s result: counts, cost, the edits' initials and the SHA-256 of its repaired ``role:text`` lines; one pass over its edits as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        done: list[tuple] = []

        def close() -> None:
            count = faults.get
            gaps = high - low + 1 - turns if turns else 0
            done.append((conv, gaps, count("blank", 0), count("duplicate", 0), count("truncated", 0), illegal, cost, "".join(audit), sha.hexdigest()))

        conv, open_ = None, False
        for c, step, edit, fault, price, turn, was, role, text in _rows(batches):
            if step == 0:
                if open_:
                    close()
                conv, open_, faults, illegal, cost, audit, sha, first = c, True, {}, 0, 0, [], hashlib.sha256(), True
                low = high = last = None
                turns = 0
            audit.append(edit[0])
            cost += price
            if edit != "Insert":
                faults[fault] = faults.get(fault, 0) + 1
                illegal += last is not None and last + was[:1] not in ("su", "ua", "au")
                last = was[:1]
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
            if role is not None:
                sha.update((b"" if first else b"\n") + f"{role}:{text}".encode())
                first = False
            if len(done) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, x in zip(names, zip(*done))], names)
                done.clear()
        if open_:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, x in zip(names, zip(*done))], names)

    return steps.mapInArrow(run, SUMMARY)


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' repair: one row for every conv_id of the table, also where no row is left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    got = ids.join(summary(repair(damage(conversations))), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return got.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


#: crc32 of a string of ASCII characters.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: Backward over the rows with (cost, edits) per state, least cost and then least string; the repaired roles follow from the string.
ORACLE = (
    r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """
    + CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    + r""" % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS t FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), t) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM d),
f AS (SELECT *, CASE WHEN cut = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(cut, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, role[1:1] AS ini FROM o),
w AS (
  SELECT conv_id, n AS i, {'c': 0, 's': ''} AS v0, {'c': 4, 's': 'II'} AS vs, {'c': 2, 's': 'I'} AS vu, {'c': 0, 's': ''} AS va FROM f WHERE i = n
  UNION ALL
  SELECT conv_id, i - 1, least(v0, {'c': 2 + least(vu, {'c': 2 + va.c, 's': 'I' || va.s}).c, 's': 'I' || least(vu, {'c': 2 + va.c, 's': 'I' || va.s}).s}),
    least(vs, {'c': 2 + least(vu, {'c': 2 + va.c, 's': 'I' || va.s}).c, 's': 'I' || least(vu, {'c': 2 + va.c, 's': 'I' || va.s}).s}),
    least(vu, {'c': 2 + va.c, 's': 'I' || va.s}), least(va, {'c': 2 + vu.c, 's': 'I' || vu.s})
  FROM (SELECT w.conv_id, w.i,
      least({'c': 3 + v0.c, 's': 'D' || v0.s}, CASE WHEN fault IN (1, 2) THEN big WHEN ini = 's' THEN {'c': more + vs.c, 's': 'K' || vs.s} WHEN ini = 'u' THEN {'c': more + vu.c, 's': 'K' || vu.s} ELSE big END,
            CASE WHEN fault IN (1, 2) THEN big ELSE {'c': 2 + more + vu.c, 's': 'R' || vu.s} END) AS v0,
      least({'c': 3 + vs.c, 's': 'D' || vs.s}, CASE WHEN fault IN (1, 2) OR ini <> 'u' THEN big ELSE {'c': more + vu.c, 's': 'K' || vu.s} END,
            CASE WHEN fault IN (1, 2) THEN big ELSE {'c': 2 + more + vu.c, 's': 'R' || vu.s} END) AS vs,
      least({'c': 3 + vu.c, 's': 'D' || vu.s}, CASE WHEN fault IN (1, 2) OR ini <> 'a' THEN big ELSE {'c': more + va.c, 's': 'K' || va.s} END,
            CASE WHEN fault IN (1, 2) THEN big ELSE {'c': 2 + more + va.c, 's': 'R' || va.s} END) AS vu,
      least({'c': 3 + va.c, 's': 'D' || va.s}, CASE WHEN fault IN (1, 2) OR ini <> 'u' THEN big ELSE {'c': more + vu.c, 's': 'K' || vu.s} END,
            CASE WHEN fault IN (1, 2) THEN big ELSE {'c': 2 + more + vu.c, 's': 'R' || vu.s} END) AS va
    FROM w JOIN (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS more, {'c': 1000000, 's': ''} AS big FROM f) f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i)),
b AS (SELECT conv_id, v0.c AS cost, v0.s AS audit FROM w WHERE i = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM b WHERE audit <> ''),
e2 AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS e FROM e),
j AS (SELECT e2.conv_id, p, e2.e, edit, f.role, f.text, max(CASE WHEN edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e2.conv_id) AS sys
      FROM e2 LEFT JOIN f ON e2.conv_id IS NOT DISTINCT FROM f.conv_id AND e2.i = f.i AND edit <> 'I'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM j WHERE edit <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f) GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id
"""
)
