"""Ordered folds over keys of any size: partitions sorted by range are folded as streams, each with the state that the one before leaves.

A fold is an object with ``start`` (the state of a new key), ``step(state, row)`` (the next state and rows to emit) and ``finish(state)`` (rows to
emit at a key's end); states are flat tuples. Rows are sorted by key and order over range partitions, so a key with a third of all rows lies in many
of them. Where a key runs over a border, the state there is needed first: every such partition is folded from ``start``, and again only where the
state that comes in turns out different, until none does. Folds that forget their past soon (a gap, a changed label) settle at once;
the driver holds one state per partition border, and no task more than a batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.session import bounded, shared_path


class Fold(Protocol):
    start: tuple

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]: ...

    def finish(self, state: tuple) -> list[tuple]: ...


ROWS_OUT = 8192


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def sorted_parts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` sorted by key and order over range partitions, numbered by ``__part``, as a table in the shared folder."""
    path = shared_path(df.sparkSession, "sorted")
    df.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def segmented_scan(df: DataFrame, key: str, order: list[str], values: list[str], fold: Fold, out: str, index: str | None = None) -> DataFrame:
    """The rows (key, *out) that the fold emits over ``values`` of each key's rows in order; ``index`` adds their places, from 0 for each key.

    ``out`` is a schema of the emitted rows. Rows that tie in key and order must be alike in ``values``. A null key is a key of its own. An empty table gives no rows.
    """
    rows = sorted_parts(df.select(key, *dict.fromkeys([*order, *values])), key, order)
    key_type = rows.schema[key].dataType.simpleString()
    placed = rows.repartition("__part").sortWithinPartitions("__part", key, *order).select("__part", key, *values)
    span = rows.groupBy("__part").agg(F.min(F.struct(F.col(key).isNotNull(), key)).alias("lo"), F.max(F.struct(F.col(key).isNotNull(), key)).alias("hi")).orderBy("__part").collect()  # one row a partition
    joins = [i > 0 and tuple(span[i - 1]["hi"]) == tuple(r["lo"]) for i, r in enumerate(span)]
    cut = {r["__part"]: joins[i + 1] if i + 1 < len(span) else False for i, r in enumerate(span)}  # whether the last key goes on
    incoming: dict[int, tuple] = {r["__part"]: fold.start for r, j in zip(span, joins) if j}

    def run(borders: dict[int, tuple], goes_on: dict[int, bool], emit: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: list[tuple] = []
            part = now = state = None
            count = 0

            def leave(last: bool) -> None:
                """The end of a key within a part, or of the part."""
                nonlocal count
                if last and goes_on[part]:
                    if not emit:
                        done.append((part, *state))
                elif emit:
                    for x in fold.finish(state):
                        done.append((part, now, count, *x))
                        count += 1

            for p, k, *row in _rows(batches):
                if p != part or k != now:
                    if part is not None:
                        leave(p != part)
                    state = borders.get(p, fold.start) if p != part else fold.start
                    part, now, count = p, k, 0
                state, made = fold.step(state, tuple(row))
                if emit:
                    for x in made:
                        done.append((p, k, count, *x))
                        count += 1
                if len(done) >= ROWS_OUT:
                    yield batch(done)
                    done.clear()
            if part is not None:
                leave(True)
            if done:
                yield batch(done)

        types = _arrow(f"__part int, {key} {key_type}, __at long, {out}" if emit else STATES)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

        return work

    STATES = "__part int, " + ", ".join(f"s{i} long" for i in range(len(fold.start)))
    before = {b["__part"]: a["__part"] for a, b in zip(span, span[1:])}
    todo = sorted({before[p] for p in incoming})  # parts whose last state another one needs
    while todo:
        got = placed.where(F.col("__part").isin(todo)).mapInArrow(run(incoming, cut, False), STATES).collect()  # one row a part
        left = {r["__part"]: tuple(r)[1:] for r in got}
        changed = {p for p in incoming if before[p] in left and left[before[p]] != incoming[p]}
        incoming |= {p: left[before[p]] for p in changed}
        whole = {r["__part"] for r in span if tuple(r["lo"]) == tuple(r["hi"])}  # others' last states do not depend on what comes in
        todo = sorted(p for p in changed & whole if cut[p])
    made = placed.mapInArrow(run(incoming, cut, True), f"__part int, {key} {key_type}, __at long, {out}")
    if index is None:
        return made.drop("__part", "__at")
    if not incoming:
        return made.withColumnRenamed("__at", index).drop("__part")
    sums = made.where(F.col("__part").isin(sorted(set(before[p] for p in incoming) | set(incoming)))).groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    upto = W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = bounded(sums.withColumn("__start", F.sum("__n").over(upto)).where("__start is not null").drop("__n"))
    joined = made.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left")
    return joined.withColumn(index, F.col("__at") + F.coalesce("__start", F.lit(0))).drop("__part", "__at", "__k", "__p", "__start")


def _arrow(schema: str) -> pa.Schema:
    kinds: dict[str, Any] = {"int": pa.int32(), "integer": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.rsplit(" ", 1) for x in schema.split(", "))])


class Changes:
    """Emits each value that differs from the one before; the first always, unless it is ``first_dropped``.

    States are two numbers, so values travel through a hash: equal 64-bit hashes count as equal values.
    """

    start = (0, 0)

    def __init__(self, first_dropped: str | None = None):
        self.first_dropped = first_dropped

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        value, code = row
        if state == self.start:
            keep = value != self.first_dropped
        else:
            keep = state[1] != code
        return (1, code), [(value,)] if keep else []

    def finish(self, state: tuple) -> list[tuple]:
        return []


def collapse_rows(df: DataFrame, key: str, order: list[str], value: str, index: str = "idx") -> DataFrame:
    """(key, index, value): each key's values in order without consecutive repeats, one row each; a first value of "" is left out, as in ``collapse_repeats``."""
    coded = df.withColumn("__code", F.xxhash64(value))
    return segmented_scan(coded, key, order, [value, "__code"], Changes(""), f"{value} string", index)
