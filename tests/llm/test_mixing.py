from collections import defaultdict

from speechtab.llm import mixing
from speechtab.llm.queries import op10_mixing


def test_equals_sql(same):
    same(op10_mixing, mixing.ORACLE)


def levels(sizes):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2 * sizes[s] for s in over}


def test_targets_and_cuts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = levels(dict(size))
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s]) and abs(taken[s] - target[s]) <= 1


def test_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "y"), (4, "w " * 50_000, "x"), (5, "q", "é"), (5, "q", "é"), (None, "t u", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as key", "4 as range")
    got = mixing.mix(docs).collect()
    assert len(got) == 7 and sum(r["size"] for r in got) == 50_007
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        b = by[r["source"]]
        b[0] += r["size"]
        b[1] += r["taken"]
        b[2] = r["target"]
    want = levels({s: b[0] for s, b in by.items()})
    assert all(abs(b[2] - want[s]) < 1e-6 and abs(b[1] - b[2]) <= 1 for s, b in by.items())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_id_or_with_one_id_are_taken_alike_on_reruns(spark):
    rows = [(None, f"w{i} x", "s", i) for i in range(40)] + [(7, f"v{i} y", "s", i) for i in range(40)] + [(8, "same text", "s", i % 3) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    taken = [sorted((str(r["row"]["doc_id"]), r["row"]["text"], r["row"]["n"], r["taken"]) for r in mixing.mix(docs.repartition(n, "n" if n == 7 else "text"), row=True).collect()) for n in (3, 7)]
    assert taken[0] == taken[1] and len({t for *_, t in taken[0]}) > 1
    keys = {r["key"] for r in mixing.sizes(docs.where("doc_id is null")).collect()}
    assert len(keys) == 40  # rows without an id do not share one range
