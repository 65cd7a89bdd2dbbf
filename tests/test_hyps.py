import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechtab.operators import batching as B
from speechtab.operators import cluster as K
from speechtab.operators import cuts as C
from speechtab.operators import hyps as H
from speechtab.operators import patterns

WORDS = st.lists(st.sampled_from("abcd"), max_size=9)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_edit_path(a, b):
    path = H.edit_path(a, b)
    assert [x for x, _ in path if x is not None] == a and [y for _, y in path if y is not None] == b
    assert sum(x != y for x, y in path) == distance(a, b)
    assert H.edit_path(a, a) == list(zip(a, a))


def table_path(ref, hyp):
    """The same path from the whole cost table, cell by cell."""
    m, n = len(ref), len(hyp)
    c = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            c[i][j] = min(c[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), c[i - 1][j] + 1, c[i][j - 1] + 1)
    out, i, j = [], m, n
    while i or j:
        if i and j and c[i][j] == c[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and c[i][j] == c[i - 1][j] + 1:
            i -= 1
            out.append((ref[i], None))
        else:
            j -= 1
            out.append((None, hyp[j]))
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_path_equals_that_of_the_whole_table(ref, hyp):
    assert H.edit_path(ref, hyp) == table_path(ref, hyp)


def test_a_long_pair_needs_little_memory():
    import random
    import tracemalloc

    rng = random.Random(2)
    ref = [str(rng.randrange(2000)) for _ in range(20_000)]
    hyp = [w for w in ref if rng.random() > 0.05] + ["end"]
    tracemalloc.start()
    path = H.edit_path(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and [x for x, _ in path if x] == ref and [y for _, y in path if y] == hyp
    assert sum(x != y for x, y in path) == len(ref) - len(hyp) + 2


def test_ties_prefer_substitution():
    assert H.edit_path(["a", "b"], ["b", "c"]) == [("a", "b"), ("b", "c")]
    assert H.edit_path([], ["x"]) == [(None, "x")] and H.edit_path(["x"], []) == [("x", None)]


def test_wer_is_a_corpus_ratio(spark):
    rows = [("s", "1", ["a"], ["b"]), ("s", "2", list("abcdefghi"), list("abcdefghi")), ("t", "1", [], ["x"]), ("t", "2", None, None)]
    a = H.align(spark.createDataFrame(rows, "setting string, cut_id string, ref array<string>, hyp array<string>"))
    w = {r["setting"]: (r["errors"], r["n_ref"], r["wer"]) for r in H.wer(a).collect()}
    assert w == {"s": (1, 10, 10.0), "t": (1, 0, None)}
    e = {(r["setting"], r["word"]): (r["correct"], r["substituted"], r["deleted"], r["inserted"]) for r in H.word_errors(a).collect()}
    assert e["s", "a"] == (1, 1, 0, 0) and e["t", "x"] == (0, 0, 0, 1)


def test_merge_is_log_sum_exp(spark):
    df = spark.createDataFrame([(1, [1, 2], -1000.0), (1, [1, 2], -1001.0), (1, [3], -5.0)], "utt_id long, ys array<int>, log_prob double")
    got = {tuple(r["ys"]): r["log_prob"] for r in H.merge_hyps(df).collect()}
    assert math.isclose(got[1, 2], -1000 + math.log(1 + math.exp(-1))) and got[3,] == -5.0


def test_batches_partition_the_input(spark):
    rng = random.Random(0)
    rows = [(f"c{i}", rng.choice([1.0, 3.0, 9.0, 50.0]) + rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "cut_id string, duration double")
    out = B.simple_batches(df, 20.0, ["cut_id"], lanes=5).collect()
    assert sorted(r["cut_id"] for r in out) == sorted(i for i, _ in rows)
    groups = {}
    for r in out:
        groups.setdefault(r["batch_id"], []).append(r["duration"])
    assert all(sum(v) <= 20 or len(v) == 1 for v in groups.values())
    full = B.bucket_batches(df, 4, 20.0, drop_last=False)
    assert full.count() == 400
    spread = full.groupBy("bucket").agg(F.min("duration").alias("lo"), F.max("duration").alias("hi")).orderBy("bucket").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(spread, spread[1:]))


def test_one_batch_a_bucket_is_lost_at_most(spark, monkeypatch):
    """Also where a bucket is folded in many lanes: their ends are folded together."""
    rng = random.Random(1)
    rows = [(f"c{i}", 1 + 9 * rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "cut_id string, duration double")
    for lane_rows in (1 << 16, 20):
        monkeypatch.setattr(B, "LANE_ROWS", lane_rows)
        whole, kept = (B.bucket_batches(df, 4, 30.0, drop_last=d).collect() for d in (False, True))
        assert sorted(r["cut_id"] for r in whole) == sorted(i for i, _ in rows)
        groups, ids = {}, {r["cut_id"] for r in kept}
        for r in whole:
            groups.setdefault((r["bucket"], r["batch_id"]), []).append((r["cut_id"], r["duration"]))
        assert all(sum(d for _, d in v) <= 30 for v in groups.values())
        lost = [k for k, v in groups.items() if v[0][0] not in ids]
        assert len({b for b, _ in lost}) == len(lost) <= 4 and all((i in ids) == (k not in lost) for k, v in groups.items() for i, _ in v)
        assert all(sum(d for _, d in groups[k]) + max(d for _, d in groups[k]) <= 30 for k in lost)
        # all but the ends of lanes are full: the next row did not fit
        assert len(groups) <= 600 * 5.6 / 20 * 1.5 + 4
    assert B.bucket_batches(df.limit(0), 4, 30.0).count() == 0 and B.simple_batches(df.limit(0), 30.0, ["cut_id"]).count() == 0


def test_null_durations_and_ties(spark):
    df = spark.createDataFrame([("a", None), ("b", 5.0), ("b", 5.0), ("c", 50.0), (None, 1.0)], "cut_id string, duration double")
    assert B.simple_batches(df, 20.0, ["cut_id"]).count() == 5 and B.bucket_batches(df, 2, 20.0, drop_last=False).count() == 5


def test_edge_padding_and_padding_mask(spark):
    df = spark.createDataFrame([("b", "x", 2, [[1.0], [2.0]], [1, 2, 3, 4]), ("b", "y", 4, [[3.0]] * 4, list(range(8)))], "batch_id string, cut_id string, num_frames long, feats array<array<double>>, labels array<int>")
    got = {r["cut_id"]: r for r in B.collate(df, pad=True, edge=True).collect()}
    assert got["x"]["feats"] == [[1.0], [1.0], [2.0], [2.0]] and got["x"]["mask"] == [False] * 4  # half before, half behind
    odd = spark.createDataFrame([([1, 2], 7), ([5], 4), ([], 3), (None, 3), ([1, 2, 3], 2)], "v array<int>, n long")
    assert [r[0] for r in odd.select(B.pad_edges(F.col("v"), F.col("n"))).collect()] == [[1, 1, 1, 2, 2, 2, 2], [5, 5, 5, 5], [], None, [1, 2, 3]]
    got = {r["cut_id"]: r for r in B.resample_labels(df.withColumn("size", F.lit(5)), 2.0, size="size").collect()}
    assert got["x"]["labels"] == [1, 3] and got["x"]["mask"] == [False, False, True, True, True] and got["y"]["mask"] == [False] * 4 + [True]


def test_collate_masks_and_labels(spark):
    rows = [("b", "x", 3, [[1.0], [2.0], [3.0]], [1, 2, 3, 4, 5, 6]), ("b", "y", 5, [[1.0]] * 5, list(range(10)))]
    df = spark.createDataFrame(rows, "batch_id string, cut_id string, num_frames long, feats array<array<double>>, labels array<int>")
    padded = {r["cut_id"]: r for r in B.collate(df, pad=True).collect()}
    assert padded["x"]["feats"] == [[1.0], [2.0], [3.0], [0.0], [0.0]] and padded["x"]["mask"] == [False] * 3 + [True] * 2
    cropped = B.collate(df, seed=1)
    r = {x["cut_id"]: x for x in B.collate_labels(cropped, 2.0, 10).collect()}
    assert len(r["y"]["feats"]) == 3 and r["y"]["labels"] == list(range(2 * r["y"]["start"], 2 * r["y"]["start"] + 6))
    half = B.resample_labels(df.withColumn("num_frames", F.lit(20)), 0.5).where("cut_id = 'x'").first()
    assert half["num_frames"] == 12 and half["labels"] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]


def covered(r):
    return B.positions(r["starts"], r["lengths"]).tolist()


def test_span_masks(spark):
    df = spark.createDataFrame([(f"c{i}", "b", 40 + 7 * i) for i in range(8)], "cut_id string, batch_id string, num_frames long")
    for kind, other, apart in (("static", 0, False), ("uniform", 2, False), ("normal", 3, False), ("poisson", 0, False), ("static", 0, True)):
        alone = {r["cut_id"]: covered(r) for r in B.span_masks(df.drop("batch_id"), 0.4, 6, 2, kind, float(other), apart).collect()}
        counts = [len(v) for v in alone.values()]
        for add in (False, True):
            rows = B.span_masks(df, 0.4, 6, 2, kind, float(other), apart, add=add).collect()
            target = max(counts) if add else min(counts)
            for r in rows:
                own = covered(r)
                assert own == sorted(set(own)) and (not own or 0 <= own[0] and own[-1] < r["num_frames"])
                assert len(own) == r["n_masked"] == min(target, r["num_frames"])  # thinned, or filled up, at random
                assert set(own) >= set(alone[r["cut_id"]]) if add else set(own) <= set(alone[r["cut_id"]])
                assert all(n > 0 for n in r["lengths"]) and all(a + n < b for a, n, b in zip(r["starts"], r["lengths"], r["starts"][1:]))  # runs are as long as can be
    again = [covered(r) for r in B.span_masks(df).orderBy("cut_id").collect()]
    assert again == [covered(r) for r in B.span_masks(df.repartition(3)).orderBy("cut_id").collect()]
    plan = B.specaug_plan(df).collect()
    assert all(0 <= r["start"] and r["start"] + r["length"] <= (80 if r["axis"] == "freq" else 100) for r in plan)


def test_span_masks_drop_out_and_compressed_time(spark):
    df = spark.createDataFrame([("a", "b", 101), ("c", "b", 62), ("d", "b", None), ("e", "e", 1)], "cut_id string, batch_id string, num_frames long")
    plain = {r["cut_id"]: r for r in B.span_masks(df, 0.5, 5).collect()}
    assert plain["d"]["n_masked"] == 0  # which empties its batch, as the fewest
    df = df.where("num_frames > 1")
    plain, holes = ({r["cut_id"]: covered(r) for r in B.span_masks(df, 0.5, 5, dropout=d).collect()} for d in (0.0, 0.3))
    assert all(set(holes[k]) < set(plain[k]) and len(holes[k]) == len(plain[k]) - round(len(plain[k]) * 0.3) for k in plain)
    third = df.withColumn("num_frames", F.ceil(F.col("num_frames") / 3).cast("long"))
    slow = {r["cut_id"]: covered(r) for r in B.span_masks(third, 0.5, 5, dropout=0.3).collect()}
    fast = {r["cut_id"]: r for r in B.span_masks(df, 0.5, 5, dropout=0.3, rate=3).collect()}
    for k, r in fast.items():  # the same plan on every third frame, each position three frames wide
        assert covered(r) == [x for m in slow[k] for x in range(3 * m, 3 * m + 3) if x < r["num_frames"]]
    assert B.span_masks(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.integers(0, 70), st.floats(0, 1))
def test_equalised_marks(marks, target, dropout):
    got = B.equalised(np.random.default_rng(1), np.array(sorted(marks), np.int64), 61, target, dropout)
    full = min(61, target)
    assert len(got) == full - int(np.rint(full * dropout)) and sorted(set(got.tolist())) == got.tolist() and all(0 <= x < 61 for x in got)
    starts, lengths = B.as_spans(got)
    assert B.positions(starts, lengths).tolist() == got.tolist()


def test_shrunk_masks(spark):
    rows = [([True] * 7 + [False] * 3, 3), ([False, True] * 5, 2), ([True, True, True, False, True, True, True], 2), ([True], 3), ([], 2), ([True], 0), (None, 2)]
    df = spark.createDataFrame(rows, "m array<boolean>, n int")

    def rule(m, n):
        if m is None or n == 0:
            return None if m is None else []
        m = m[: len(m) - len(m) % n]
        return [all(m[i * (len(m) // n) : (i + 1) * (len(m) // n)]) for i in range(n)]

    assert [r[0] for r in df.select(B.shrink_mask(F.col("m"), F.col("n"))).collect()] == [rule(m, n) for m, n in rows]


def test_concat_plan(spark):
    df = spark.createDataFrame([("b", "l", 10.0), ("b", "m", 5.0), ("b", "s", 4.0), ("b", "t", 4.0)], "batch_id string, cut_id string, duration double")
    got = {r["cut_id"]: (r["group"], r["offset"]) for r in B.concat_plan(df, 1.0, 1.0).collect()}
    assert got == {"l": (0, 0.0), "m": (1, 0.0), "s": (1, 6.0), "t": (2, 0.0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.sampled_from([1.0, 1.7, 3.0]))
def test_first_fit_equals_trying_each_group(durations, factor):
    durations = sorted((d / 4 for d in durations), reverse=True)
    room, ends, tree = factor * durations[0], [], B.FirstFit(len(durations))
    for d in durations:
        fits = lambda e, d=d: e + 1.0 + d <= room + 1e-9
        want = next((i for i, e in enumerate(ends) if fits(e)), None)
        assert tree.first(fits) == want
        end = d if want is None else ends[want] + 1.0 + d
        ends[len(ends) if want is None else want : len(ends) if want is None else want + 1] = [end]
        tree.put(tree.used if want is None else want, end)


def test_phrases_longest_first_without_overlap(spark):
    toks = spark.createDataFrame([("u", list("abcabd"), [0.9] * 5 + [0.1], [0, 0, 3, 0, 0, 0])], "utt_id string, ys array<string>, probs array<double>, trailing array<int>")
    ph = spark.createDataFrame([("ab", ["a", "b"]), ("abc", ["a", "b", "c"]), ("bd", ["b", "d"])], "phrase string, tokens array<string>")
    got = sorted((r["pos"], r["phrase"]) for r in C.spot_phrases(toks, ph).collect())
    assert got == [(0, "abc"), (3, "ab")]
    got = sorted((r["pos"], r["phrase"]) for r in C.spot_phrases(toks, ph, 0.5, 1).collect())
    assert got == [(0, "abc"), (4, "bd")]


def test_phrases_of_several_lengths_equal_a_loop(spark):
    rng = random.Random(6)
    docs = [(i, [rng.choice("abc") for _ in range(rng.randrange(30))]) for i in range(40)] + [(99, None), (98, [])]
    phrases = [("".join(p), list(p)) for p in ({tuple(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(2)})] + [("none", []), ("null", None)]
    want = []
    for i, ys in docs:
        at = 0
        while at < len(ys or []):
            fit = [p for p, t in phrases if t and ys[at : at + len(t)] == t]
            if fit:
                want.append((i, at, max(fit, key=len)))
            at += max(map(len, fit), default=1)
    toks = spark.createDataFrame(docs, "utt_id long, ys array<string>")
    got = C.spot_phrases(toks, spark.createDataFrame(phrases, "phrase string, tokens array<string>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert C.spot_phrases(toks, spark.createDataFrame([], "phrase string, tokens array<string>")).count() == 0


def test_needles_of_any_number(spark, monkeypatch):
    df = spark.createDataFrame([("/a/x", 1), ("/b/y", 2), (None, 3), ("/b/y", 2), ("", 4), ("z" * 2000 + "/q" + "z" * 2000, 5), ("/é𝄞/w", 6)], "source_path string, needle long")
    needles = spark.createDataFrame([("/a",), (None,), ("/q",), ("/q",), ("𝄞/",)], "needle string")
    for size in (1 << 20, 3):  # one automaton, and several
        monkeypatch.setattr(patterns, "PART_SYMBOLS", size)
        assert sorted(r["needle"] for r in C.exclude_source(df, needles).collect()) == [2, 2, 3, 4]
    assert C.exclude_source(df, needles.limit(0)).count() == 7 and C.exclude_source(df.limit(0), needles).count() == 0
    assert [r["needle"] for r in C.exclude_source(df, spark.createDataFrame([("",)], "needle string")).collect()] == [3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=5), max_size=8, unique=True), st.lists(st.text("abc", max_size=40), max_size=5), st.sampled_from([3, 7, 512]))
def test_automaton_equals_comparing_everywhere(words, texts, piece):
    old, patterns.PIECE = patterns.PIECE, piece
    try:
        machine = patterns.Automaton([patterns.code_points([w])[0] for w in words])
        got = sorted(zip(*(x.tolist() for x in machine.find(*patterns.code_points(texts)))))
    finally:
        patterns.PIECE = old
    assert got == sorted((i, at, k) for i, t in enumerate(texts) for k, w in enumerate(words) for at in range(len(t)) if t.startswith(w, at))


def test_scored_phrases_equal_a_loop(spark, monkeypatch):
    """Probabilities, blanks, own thresholds, several names for the same tokens; by one automaton and by several."""
    rng = random.Random(9)
    docs = [(i, ys, [rng.randrange(65) / 64 for _ in ys], [rng.randrange(4) for _ in ys]) for i in range(50) for ys in [[rng.randrange(3) for _ in range(rng.randrange(40))]]] + [(97, [0, None, 1], [1.0, 1.0, None], [3, None, 3]), (98, None, None, None)]
    table = [(f"{p}-{k}", list(p), t) for p in {tuple(rng.randrange(3) for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(2)} for k, t in enumerate((0.6, None, 0.25)[: rng.randrange(1, 4)])] + [("x", [0, None], None), (None, [1], None)]
    want = []
    for i, ys, probs, trailing in docs:
        at = 0
        while at < len(ys or []):
            fit = []
            for name, t, least in table:
                n = len(t)
                if name and None not in t and ys[at : at + n] == t and None not in probs[at : at + n] and sum(probs[at : at + n]) / n >= (0.5 if least is None else least) and (at + n == len(ys) or (trailing[at + n - 1] or 0) > 1):
                    fit.append((-n, name))
            if fit:
                want.append((i, at, min(fit)[1]))
            at += -min(fit)[0] if fit else 1
    toks = spark.createDataFrame(docs, "utt_id long, ys array<int>, probs array<double>, trailing array<int>")
    ph = spark.createDataFrame(table, "phrase string, tokens array<int>, threshold double")
    for size in (1 << 20, 4):
        monkeypatch.setattr(patterns, "PART_SYMBOLS", size)
        assert sorted(map(tuple, C.spot_phrases(toks, ph, 0.5, 1).collect())) == sorted(want) and want


def test_amplitudes_and_common_ids(spark):
    rows = [("a", 1.0, 16000, 1, [], [0.5, -1.0]), ("b", 1.0, 16000, 1, [], [0.5, -10.5]), ("f", 1.0, 16000, 1, [], [1.5, -10.0]), ("c", 1.0, 16000, 1, [], [float("nan")]), ("d", 1.0, 16000, 1, [], []), ("e", 1.0, 16000, 1, [], None)]
    cuts = spark.createDataFrame(rows, "cut_id string, duration double, sampling_rate int, channels int, supervisions array<struct<start:double,duration:double>>, samples array<double>")
    assert sorted((r["rule"], r["id"]) for r in C.validate(cuts).collect()) == [("amplitude", i) for i in "bcde"]
    ids = [spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2, 3, 3, None], [3, 2, 2], [3, 9])]
    assert [r["id"] for r in C.common_ids(ids).collect()] == [3, 3]


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (50, 3)) for c in (0, 5, 9)])
    df = spark.createDataFrame([("c", i, [float(v) for v in r]) for i, r in enumerate(x)], "cut_id string, t int, feat array<float>")
    few, some = (K.fit_kmeans(df, k, seed=1, max_iter=20) for k in (2, 3))
    assert some[1] < few[1]
    x = x.astype(np.float32).astype(float)  # as the table holds them
    start, want = [[0.1] * 3, [0.2] * 3, [9.0] * 3, [99.0] * 3], np.array([[0.1] * 3, [0.2] * 3, [9.0] * 3, [99.0] * 3])
    for _ in range(4):
        own = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([x[own == i].mean(0) if (own == i).any() else want[i] for i in range(4)])
    centres, inertia = K.fit_kmeans(df.repartition(5), start=start, max_iter=4)
    assert np.allclose(centres, want) and abs(inertia - ((x[:, None] - want) ** 2).sum(2).min(1).mean()) < 1e-9  # the far centre has no frames and stays
    assert K.fit_kmeans(df.limit(0), start=start, max_iter=4) == (start, 0.0)
    labels = K.labels_per_cut(K.assign_kmeans(df, some[0])).first()["labels"].split()
    assert all(len(set(labels[i : i + 50])) == 1 for i in (0, 50, 100)) and len(set(labels)) == 3
    tie = K.assign_kmeans(df.limit(1), [[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]]).first()["label"]
    assert tie == 0


def test_log_mel_finds_a_tone():
    t = np.arange(16000) / 16000
    m = K.log_mel(np.sin(2 * np.pi * 1000 * t) * 0.5)
    assert m.shape == (100, 80) and len(set(m.argmax(1)[5:-5].tolist())) <= 2
    assert K.log_mel(np.zeros(0)).shape == (0, 80)


def test_noise_plan(spark):
    cuts = spark.range(2000).select(F.col("id").cast("string").alias("cut_id"))
    plan = C.noise_mix_plan(cuts, cuts.limit(10)).collect()
    share = sum(r["noise_id"] is not None for r in plan) / 2000
    assert len(plan) == 2000 and 0.45 < share < 0.55 and all(10 <= r["snr"] <= 20 for r in plan if r["noise_id"])
    assert all(r["noise_id"] is None for r in C.noise_mix_plan(cuts, cuts.limit(0)).collect())


def test_span_masks_query_keeps_every_document(spark, tmp_path):
    from speechtab.plans import hyps as plans

    rows = [(i, n, "en", "s") for i, n in enumerate([None, 0, 1, 2, 3, 9, 15, 30, *range(600, 1000, 2)])]
    docs = spark.createDataFrame(rows, "doc_id long, n_chars long, lang string, source string").withColumn("text", F.expr("repeat('a', cast(n_chars as int))"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.span_masks(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r["cut_id"] for r in got}) == len(rows)
    kept = {int(r["cut_id"].split("-")[1]): r["n"] for r in got}
    assert all(kept[i] == 0 for i in range(2)) and sum(kept[i] > 100 for i in range(8, len(rows))) > 150  # one short row does not empty the long ones


def test_refine_kmeans_with_empty_partitions(spark):
    """Tasks without rows send no sums."""
    from speechtab.operators import cluster as K

    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "feat array<float>").repartition(6)
    centres, inertia = K.refine_kmeans(df, [[0.0, 0.0], [5.0, 5.0]], 3)
    assert centres == [[1.0, 2.0], [3.0, 4.0]] and inertia == 0


def test_log_softmax_grows_with_its_items(spark):
    """Largest item and total are worked out once an array: at 4,096 items, once an item took minutes."""
    import time

    df = spark.range(8, numPartitions=4).select(F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: (i % 7).cast("double") + F.col("id")).alias("v"))
    t = time.perf_counter()
    rows = df.select("v", H.log_softmax(F.col("v"), 2.0).alias("p"), H.log_softmax(F.lit(None).cast("array<double>")).alias("none")).collect()
    assert time.perf_counter() - t < 20
    for r in rows:
        z = math.log(sum(math.exp(x / 2) for x in r["v"]))
        assert all(math.isclose(p, x / 2 - z, abs_tol=1e-9) for p, x in zip(r["p"], r["v"])) and r["none"] is None


def test_bucket_edges_are_exact(spark):
    """More distinct lengths than an approximate quantile keeps."""
    df = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 100.0).alias("duration"))
    values = sorted(r[0] for r in df.collect())
    assert B.quantile_edges(df, "duration", 7) == [values[-(-30_000 * i // 7) - 1] for i in range(1, 7)]
    assert B.quantile_edges(df.limit(0), "duration", 7) == [] == B.quantile_edges(df.limit(5), "duration", 1)


def test_one_lane_in_many_parts_is_one_fold(spark, monkeypatch):
    """Batches of a lane that lies in many parts are those of a loop over it, with zeros, nulls, long rows and even lengths."""
    for kind, lane_rows in ((0, 7), (1, 7), (2, 3), (3, 5)):
        rng = random.Random(kind)
        draw = [lambda: rng.choice([0.1, 0.7, 3.3, 9.9, 25.0]) * rng.random(), lambda: rng.choice([None, 0.0, 0.0, 12.5, 30.0, 1.1]), lambda: 1.0, lambda: rng.choice([0.0, 0.0, 0.0, 40.0])][kind]
        rows = [(f"c{i:04}", draw()) for i in range(300)]
        monkeypatch.setattr(B, "LANE_ROWS", lane_rows)
        got = {r["cut_id"]: r["batch_id"] for r in B.simple_batches(spark.createDataFrame(rows, "cut_id string, duration double"), 20.0, ["cut_id"]).collect()}
        total, number, want = 0.0, 0, {}
        for i, d in rows:
            if total > 0 and total + (d or 0.0) > 20.0:
                total, number = 0.0, number + 1
            total += d or 0.0
            want[i] = f"0-{number}"
        assert got == want and number > 3


def test_rescoring_keeps_a_row_an_utterance(spark):
    """Settings become rows after the best hypotheses are known, not before."""
    df = spark.createDataFrame([(1, 1, -2.0, -1.0, -3.0), (1, 2, -2.0, -1.0, -3.0), (2, 1, -5.0, 0.0, -1.0), (2, 2, -4.0, -9.0, -1.0)], "utt_id long, hyp long, am double, lm double, ng double")
    for form in ("lm", "lodr", "ngram_rnn"):
        plan = H.rescore_grid(df, form)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.index("Generate") < text.index("Aggregate")  # the root comes first
        assert {(r["utt_id"], r["hyp"]) for r in plan.collect()} >= {(1, 1)} and plan.where("utt_id = 1 and hyp = 2").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.none() | st.lists(st.sampled_from("abc") | st.none(), max_size=12), st.none() | st.lists(st.sampled_from("abc") | st.none(), max_size=12)), max_size=30), st.sampled_from([(1 << 23, 1000), (100, 6)]))
def test_pairs_aligned_together_keep_their_paths(pairs, bounds):
    """In one group, in several, and the long ones each by itself."""
    import pyarrow as pa

    old, (H.CELLS, H.LONG) = (H.CELLS, H.LONG), bounds
    try:
        counts, left, right = H._aligned(*(pa.array([p[side] for p in pairs], pa.list_(pa.string())) for side in (0, 1)))
    finally:
        H.CELLS, H.LONG = old
    for k, (ref, hyp) in enumerate(pairs):
        path = H.edit_path(ref or [], hyp or [])
        assert list(zip(left[k].as_py(), right[k].as_py())) == path
        gone, new, same = sum(y is None for _, y in path), sum(x is None for x, _ in path), sum(x == y for x, y in path)
        assert [int(c[k]) for c in counts] == [len(path) - new, same, len(path) - same - gone - new, gone, new]


def test_many_pairs_need_little_memory():
    """As many as are aligned at once."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    ref = [[str(rng.randrange(900)) for _ in range(rng.randrange(150, 250))] for _ in range(H.SLICE)]
    hyp = [[w for w in v if rng.random() > 0.1] for v in ref]
    lists = [pa.array(v, pa.list_(pa.string())) for v in (ref, hyp)]
    tracemalloc.start()
    H._aligned(*lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_rows_whose_frames_meet_keep_their_features(spark, monkeypatch):
    """Rows without frames, of several rates, and longer than what is transformed at once; samples as bytes give the same."""
    monkeypatch.setattr(K, "FRAMES", 7)
    rng = random.Random(5)
    rows = [(str(i), rng.choice([8000, 16000]), None if i == 3 else bytes(rng.randrange(128) for _ in range(n))) for i, n in enumerate([500, 0, 79, 900, 3000, 80, 1500, 240, 2000])]
    decode = lambda v: (np.frombuffer(v, np.uint8) - 64.0) / 64.0
    plain = [(c, r, None if v is None else decode(v).tolist()) for c, r, v in rows]
    want = {(c, t): f.tolist() for c, r, v in plain for t, f in enumerate(K.log_mel(np.array(v or []), r))}
    byte = K.frame_features(spark.createDataFrame(rows, "cut_id string, sampling_rate int, samples binary").coalesce(1), decode=decode)
    array = K.frame_features(spark.createDataFrame(plain, "cut_id string, sampling_rate int, samples array<float>").coalesce(1))
    for df in (byte, array):
        got = {(r["cut_id"], r["t"]): r["feat"] for r in df.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
