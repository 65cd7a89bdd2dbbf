import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from speechtab.llm import lmscore


def brute(rows):
    """(n, loss_target, loss_background) of rows (text, target, background), each scored without its own counts."""
    split = [(t or "").lower().split() for t, *_ in rows]
    width = len({w for ws in split for w in ws})
    models = []
    for m in (1, 2):
        held = [ws for ws, r in zip(split, rows) if r[m]]
        models.append((Counter(w for ws in held for w in ws), Counter(p for ws in held for p in zip([None, *ws], ws))))
    out = []
    for ws, r in zip(split, rows):
        losses = []
        for m, (uni, bi) in zip((1, 2), models):
            u, b = Counter(uni), Counter(bi)
            if r[m]:
                u.subtract(ws)
                b.subtract(zip([None, *ws], ws))
            total, starts = sum(u.values()), sum(n for (h, _), n in b.items() if h is None)
            loss = 0.0
            for h, w in zip([None, *ws], ws):
                p = (u[w] + 1) / (total + width + 1)
                loss -= math.log2((b[h, w] + lmscore.MU * p) / ((starts if h is None else u[h]) + lmscore.MU))
            losses.append(loss / len(ws) if ws else None)
        out.append((len(ws), *losses))
    return out


def equal(got, want):
    assert got["n_tokens"] == want[0]
    for c, x in zip(("loss_target", "loss_background"), want[1:]):
        assert got[c] is None if x is None else math.isclose(got[c], x, rel_tol=1e-9), (got, want)
    assert (got["score"] is None) == (want[0] == 0)


ROWS = ["the cat sat on the mat", "The cat ate the rat", "junk junk words junk", None, "", "the cat sat on the junk", "the mat sat", "a b c d e f g", " \n ", "lone"]


def test_equals_brute_force(spark):
    flags = [(i, t, i % 3 == 0, i % 4 != 1) for i, t in enumerate(ROWS)]
    docs = spark.createDataFrame(flags, "doc_id long, text string, target boolean, background boolean").selectExpr("*", "1 as key", "2 as n", "3 as `group`")
    got = {r["doc_id"]: r for r in lmscore.score(docs).collect()}
    assert len(got) == len(ROWS)
    for i, want in enumerate(brute([x[1:] for x in flags])):
        equal(got[i], want)


@pytest.mark.parametrize("group, ranges, fan_out", [(40, 30, 256), (40, 30, 3), (1 << 20, 2_000_000, 256)])
def test_any_grouping_gives_the_same(spark, group, ranges, fan_out):
    """By one level of ranges and by several; many small groups and ranges, long texts in pieces (their own counts are left out piece by piece, so here they are in no model)."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(30))), i % 5 == 0, True) for i in range(120)]
    rows += [(500, " ".join(f"w{rng.randrange(60)}" for _ in range(500)), False, False), (501, rows[3][1], False, True), (501, rows[3][1], False, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean, background boolean").repartition(3)
    assert (lmscore.grouped(docs, group).count() > 30) == (group == 40)
    got = sorted(lmscore.score(docs, group, ranges, fan_out).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    assert len(got) == len(rows)
    for r, want in zip(got, brute([x[1:] for x in rows])):
        equal(r, want)


def test_copies_score_apart_and_target_like_others(spark):
    """Leaving one out: a text that occurs twice is likely under the background; good documents gain nothing by being labelled."""
    rng = random.Random(5)
    style = lambda k: " ".join(f"{k}{rng.randrange(40)}" for _ in range(60))
    rows = [(i, style("good") if i % 2 else style("bad")) for i in range(200)] + [(900, "q1 q2 q3 q4 q5 q6 q7 q8"), (901, "q1 q2 q3 q4 q5 q6 q7 q8"), (902, "z1 z2 z3 z4 z5 z6 z7 z8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 101, 2)] + [(1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, labels).collect()}
    mean = lambda ids: np.mean([got[i]["score"] for i in ids])
    inside, outside, bad = mean(range(1, 100, 2)), mean(range(101, 200, 2)), mean(range(0, 200, 2))
    assert abs(inside - outside) < 0.1 and bad - outside > 2
    assert got[902]["loss_background"] - got[900]["loss_background"] > 3


def test_good_documents_score_lower(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = lmscore.cross_entropy_difference(docs, labels).join(labels, "doc_id").where("score is not null").collect()
    mean = lambda q: sum(r["score"] for r in rows if r["quality"] == q) / sum(r["quality"] == q for r in rows)
    assert mean(1) < mean(0)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "a"), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"] is None) for r in lmscore.cross_entropy_difference(docs, labels).collect())
    assert got == [("1", 2, False), ("1", 2, False), ("2", 0, True), ("None", 1, False)]
    assert lmscore.cross_entropy_difference(docs.limit(0), labels).count() == 0


def test_every_word_and_bigram_counts(spark):
    """Nothing stops counting: 45,000 words, each in two texts, and bigrams of one occurrence."""
    rows = [(i, " ".join(f"w{(i * 300 + k) % 45_000}" for k in range(300)), i % 2 == 0, True) for i in range(300)] + [(300, "w7 w7 w8 w3 w44990 w7 new", False, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean, background boolean").repartition(7)
    got = {r["doc_id"]: r for r in lmscore.score(docs).collect()}
    for i, want in zip((0, 1, 150, 300), [brute([x[1:] for x in rows])[k] for k in (0, 1, 150, 300)]):
        equal(got[i], want)


def test_words_of_long_texts_in_pieces():
    """Cut at blanks; a word longer than a piece stays whole."""
    from speechtab.llm import common

    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "Cd", "é" * 9, "x" * 300_000]) + "\n" * rng.randrange(2) for _ in range(40)) + " tail" * 120_000
    (lo, hi, ids, counts), = common.words(pa.array([text]))
    one = {w: next(common.words(pa.array([w])))[2][0] for w in set(text.split())}
    assert (lo, hi) == (0, 1) and counts.tolist() == [len(ids)] and ids.tolist() == [one[w] for w in text.split()]


def test_packed_arrays():
    for x in (np.zeros(0, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64), np.arange(5, dtype=np.uint32)):
        assert (lmscore.unpack(lmscore.pack(x), x.dtype.type) == x).all()


def test_rows_grow_with_the_tokens_and_not_with_groups_times_ranges(spark, monkeypatch):
    """Ids of a row stay, as the table grows: each level sends at most ``fan_out`` rows a run, and a run holds a range's worth of ids."""
    sent = {}

    def counted(df, name, plain=lmscore.stage):
        out = plain(df, name)
        if name == "lm-runs":
            sent["runs"] = sent.get("runs", 0) + out.where("group = -1").count()
            sent["rows"] = sent.get("rows", 0) + out.where("group >= 0").count()
            sent["levels"] = sent.get("levels", 0) + 1
        return out

    monkeypatch.setattr(lmscore, "stage", counted)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(100_000)]
    seen = []
    for n in (60, 240):
        docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(100)), i % 5 == 0, True) for i in range(n)], "doc_id long, text string, target boolean, background boolean").repartition(4)
        sent.clear()
        assert lmscore.score(docs, 400, 500, 4).where("score is not null").count() == n
        seen.append(dict(sent))
    few, many = ({k: v[k] / v["levels"] for k in ("rows", "runs")} for v in seen)
    assert 2.5 < many["rows"] / few["rows"] < 6 and 2.5 < many["runs"] / few["runs"] < 6  # of a level: four times the tokens, but sixteen times groups x ranges
    assert seen[1]["levels"] <= seen[0]["levels"] + 1
