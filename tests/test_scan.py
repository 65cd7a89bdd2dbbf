import random

import pytest

from speechtab.operators import scan
from speechtab.operators import segments as S


def merged(rows, merge, least, blank):
    """The rule, segment by segment."""
    out, s, e = [], None, None
    for a, b in sorted(rows):
        if s is None:
            s, e = a, b
        elif e - s > merge:
            out.append((s, e))
            s, e = a, b
        elif a - e > blank:
            out += [(s, e)] if e - s > least else []
            s, e = a, b
        else:
            e = b
    return out + ([(s, e)] if s is not None and e - s > least else [])


def speech(rng, n, gap, at=0):
    rows = []
    for _ in range(n):
        at += rng.randrange(gap)
        rows.append((at, at + rng.randrange(1, 300)))
        at = rows[-1][1]
    return rows


@pytest.mark.parametrize("parts", ["3", "16"])
def test_merge_equals_the_rule_with_one_recording_over_many_partitions(spark, parts):
    """Without a gap over ``blank`` in the large one, the state at each border hangs on all rows before."""
    rng = random.Random(int(parts))
    data = {1: speech(rng, 3000, 40), 2: speech(rng, 300, 900), 3: speech(rng, 1, 5), None: speech(rng, 5, 50), 5: speech(rng, 2000, 2000)}
    df = spark.createDataFrame([(k, a, b, 0) for k, v in data.items() for a, b in v], "recording_id long, start_ms long, end_ms long, seg_idx int").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = S.merge_segments(df, 1000, 200, 500).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0]), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    want = [(k, i, *x) for k, v in data.items() for i, x in enumerate(merged(v, 1000, 200, 500))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert S.merge_segments(df.limit(0), 1000, 200, 500).count() == 0


def test_collapse_over_many_partitions(spark):
    rng = random.Random(4)
    data = {1: [rng.choice("ab") for _ in range(3000)], 2: ["", "x", "x", ""], 3: ["x"] * 400}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "user long, at long, label string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan.collapse_rows(df, "user", ["at"], "label").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for k, vs in data.items():
        kept = [v for i, v in enumerate(vs) if (i == 0 and v != "") or (i and v != vs[i - 1])]
        want += [(k, i, v) for i, v in enumerate(kept)]
    assert sorted((r["user"], r["idx"], r["label"]) for r in got) == sorted(want)
