import hashlib
import math
import random
import re

import numpy as np

from speechtab.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return "".join(c for c in t if c in "0123456789")


def brute(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("ab@..-+1 0 234567 ()%é") for _ in range(rng.randrange(120)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("00255.1.1.256 000000000255.1.1.1") == brute("00255.1.1.256 000000000255.1.1.1")


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "-" * 300_000, "1." * 100_000, "@a.b" * 50_000, "a" * 100_000 + " at " * 50_000, "AB12" * 50_000, "Mr " * 50_000, "1-" * 100_000):
        pii.base_spans(t)
        list(pii.candidates(t, []))


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    quality = [0.95, 0.9, 0.55, 0.8]
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) * 2 - 1 for q in quality], 1)
    votes[rng.random(votes.shape) < 0.3] = 0
    p, share, right = pii.reliabilities(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.9 and abs(share - 0.4) < 0.05
    assert np.argmin(right) == 2 and np.argmax(right) == 0 and abs(right[0] - 0.95) < 0.05


def loop_em(votes):
    """The same estimates, one candidate at a time."""
    m = len(votes[0])
    right = [pii.PRIOR_RIGHT] * m
    for _ in range(pii.EM_ROUNDS):
        p = []
        for v in votes:
            odds = sum(x * math.log(right[j] / (1 - right[j])) for j, x in enumerate(v))
            p.append(1 / (1 + math.exp(-max(-50, min(50, odds)))))
        for j in range(m):
            cast = sum(v[j] != 0 for v in votes)
            agree = sum(q if v[j] > 0 else 1 - q for v, q in zip(votes, p) if v[j])
            right[j] = (agree + pii.PRIOR_VOTES * pii.PRIOR_RIGHT) / (cast + pii.PRIOR_VOTES)
    return p, right


TEXTS = [
    "card 7536784127813050 or, elsewhere and later in the text, 5543404633219280", "call (555) 123-4567 now", "ssn 123-45-6789, then 1234567890", "page 10.20.30.40 of 999.1.2.3",
    "Dear Mrs Clara Jones and Dr. John Miller of 12 Oak Street", "write joe.bloggs [at] example [dot] com or x.y(at)z(dot)qq", "born 1980-02-03, printed 2020-02-03 and 03/04/2021",
    "iban DE89370400440532013000 beside XX00370400440532013000", "order 111111111111 item 5500005555555559", "id=123456789012345678", "", "no data at all",
] * 6


def test_votes_em_and_classifier_equal_loops(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = [(v, f) for t in TEXTS for *_, v, f in pii.candidates(t, [])]
    assert sum(r["n"] for r in pii.tally(docs).collect()) == len(found) > 100
    p, right = loop_em([v for v, _ in found])
    rows = sorted(pii.tally(docs).collect())
    votes = np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in rows])
    got, _, got_right = pii.reliabilities(votes, np.array([r["n"] for r in rows], float))
    assert np.allclose(got_right, right)
    of = {tuple(v): x for v, x in zip(votes.tolist(), got)}
    assert all(math.isclose(of[v], x, abs_tol=1e-9) for (v, _), x in zip(found, p))
    w, n = np.zeros(pii.FEATURES + 1), len(found)
    for _ in range(4000):  # plain gradient descent on the same penalised loss
        g = 1e-4 * w
        for (_, f), q in zip(found, p):
            x = np.append(f, 1.0)
            g = g + (1 / (1 + math.exp(-(x @ w))) - q) * x / n
        w = w - 2.0 * g
    score = lambda f, w: 1 / (1 + math.exp(-(np.append(f, 1.0) @ w)))
    assert all(abs(score(f, w) - score(f, pii.fit(docs))) < 0.02 for f in {f for _, f in found})


def test_both_classes_have_mass_and_unchecked_numbers_stay_out(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    p, share, _ = pii.reliabilities(*(lambda rows: (np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in rows]), np.array([r["n"] for r in rows], float)))(sorted(pii.tally(docs).collect())))
    assert 0.2 < share < 0.9 and p.min() < 0.2 and p.max() > 0.9
    w = pii.fit(docs)
    named = lambda t: [t[s:e] for k, s, e in pii.all_spans(t, w) if k == 4]
    assert named(TEXTS[0]) == [] and named(TEXTS[1]) == ["(555) 123-4567"] and named(TEXTS[2]) == ["123-45-6789"]
    assert named(TEXTS[4]) == ["Mrs Clara Jones", "Dr. John Miller", "12 Oak Street"] and named(TEXTS[5])[0] == "joe.bloggs [at] example [dot] com"
    assert not {"2020-02-03", "03/04/2021"} & set(named(TEXTS[6])) and named(TEXTS[7]) == ["DE89370400440532013000"] and named(TEXTS[8]) == named(TEXTS[9]) == []


def test_the_corpus_splits_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    w = pii.fit(docs)
    assert pii.all_spans("thst 5543404633219280 anou", w) == [] and pii.luhn("7536784127813050")
    assert [k for k, *_ in pii.all_spans("çan 7536784127813050 4845168114407329 è", w)] == [4, 4]  # valid, but the base match takes both as one


def test_query_and_redaction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.as_text(want).encode()).hexdigest()
        assert set(pii.as_text(want).split(",")) <= set(r["spans"].split(","))
    clean = pii.redact(docs)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        if not any(c in texts[r["doc_id"]] for c in "0123456789@"):
            assert r["text"] == texts[r["doc_id"]]
        assert not EMAIL.search(r["text"])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "mail a.b@c.de now", "s"), (3, "mail a.b@c.de now", "s")], "doc_id long, text string, spans string")
    got = [(r["doc_id"], r["n_email"], r["spans"]) for r in pii.find_pii(docs).orderBy("doc_id").collect()]
    assert got == [(1, 0, ""), (2, 0, ""), (3, 1, "email:5:13"), (3, 1, "email:5:13")]
    assert {r["text"] for r in pii.redact(docs).collect()} == {None, "", "mail <EMAIL> now"}
    assert pii.find_pii(docs.limit(0)).count() == 0
