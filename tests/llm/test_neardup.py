import random

from speechtab.llm import neardup
from speechtab.llm.queries import op5_minhash_near_dedup


def shingles(text, width=2):
    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    w = [x for x in (text or "").translate(table).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width=2):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(min((x for j, x in rows if j == i and x is not None), default=None), width)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows, extra=False, width=2):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "1 as n_shingles", "2 as component_id", "3 as kept", "4 as band")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, width).collect()}
    want = brute(rows, width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_equals_sql(same):
    same(op5_minhash_near_dedup, neardup.ORACLE)


def test_chains_copies_and_odd_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows, now = [], list(base)
    for i in range(60):  # a chain: neighbours are close, its ends are not
        rows.append((100 + i, " ".join(now)))
        now = list(now)
        for _ in range(3):
            now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
    rows += [(300 + i, " ".join(base).upper()) for i in range(20)] + [(i, t) for i, t in enumerate([None, "", " \n\t", "one", "ONE", "one two", "One  Two", "é É", "É é", "a b c d e f", "a b c d e", "x y"])]
    rows += [(500 + i, " ".join(base[:60] + [f"y{rng.randrange(10**6)}" for _ in range(60)])) for i in range(40)]
    rng.shuffle(rows)
    check(spark, rows, extra=True)
    check(spark, rows, width=5)


def test_a_very_long_text_and_many_copies(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(9000)}" for _ in range(150_000)]
    near = [w if i % 40 else "x" for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " \n".join(near)), (3, "b" * 600_000), (4, "B" * 600_000)] + [(100 + i, "the same few words in each of these") for i in range(300)]
    check(spark, rows)


def test_open_buckets_lose_no_link(spark):
    rng = random.Random(5)
    rows = []
    for g in range(8):
        own = [f"g{g % 2}w{rng.randrange(60)}" for _ in range(40)]
        for i in range(15):
            v = list(own)
            for _ in range(rng.randrange(6)):
                v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
            rows.append((g * 100 + i, " ".join(v)))
    check(spark, rows)


def test_repeated_null_and_no_rows(spark):
    check(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (3, "q r")])
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 50), (50, 60)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and all(got[i] == 100 for i in range(101, 140)) and got[60] == got[200] == 50
