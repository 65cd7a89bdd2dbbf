import random

import numpy as np
import pyarrow as pa

from speechtab.llm import toxicity


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    caught = [r["predicted"] for r in got if r["toxic"]]
    assert len(got) > 500 and right > 0.97 and sum(caught) / len(caught) > 0.8  # some toxic rows hold no toxic word


def test_pairs_are_learnt_beyond_the_sum():
    rng = np.random.default_rng(1)
    rows = [(a, b) for _ in range(600) for a in (0, 1) for b in (0, 1)]
    doc, term = [], []
    for i, (a, b) in enumerate(rows):
        own = {10 + a, 20 + b, 100 + int(rng.integers(50))}
        doc += [i] * len(own)
        term += sorted(own)
    y = np.array([a ^ b for a, b in rows], float)
    doc, term = np.array(doc), np.array(term)
    epochs, toxicity.EPOCHS = toxicity.EPOCHS, 60
    try:
        model = toxicity.train(doc, term, y)
    finally:
        toxicity.EPOCHS = epochs
    z = toxicity.raw_scores(doc, term, len(y), *model)
    assert ((z > 0) == (y == 1)).mean() > 0.95


def test_scores_equal_a_double_loop():
    rng = np.random.default_rng(4)
    docs = [sorted(set(rng.integers(0, 40, rng.integers(0, 12)).tolist())) for _ in range(30)]
    w, v = rng.normal(size=toxicity.DIM), rng.normal(size=(toxicity.DIM, toxicity.RANK))
    doc, term = (np.array(x, np.int64) for x in zip(*[(i, t) for i, ts in enumerate(docs) for t in ts]))
    got = toxicity.raw_scores(doc, term, len(docs), 0.3, w, v)
    for i, ts in enumerate(docs):
        z = 0.3 + sum(w[t] for t in ts)
        for a in range(len(ts)):
            for b in range(a + 1, len(ts)):
                z += float(v[ts[a]] @ v[ts[b]]) / len(ts)
        assert abs(got[i] - z) < 1e-9


def test_one_text_of_a_repeated_id_is_learnt_from(spark):
    rows = [(i, f"word{chr(97 + i % 7)} other") for i in range(60)] + [(i, f"zzz{chr(97 + i % 5)}") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert models[0][0] == models[1][0] and (models[0][1] == models[1][1]).all() and (models[0][2] == models[1][2]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "idiot", 5), (3, "idiot " * 50_000, 5), (3, "idiot", 5)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (1, None), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == rows[0]["score"] for r in rows if r["doc_id"] in (1, 2))
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(docs, none).columns == docs.columns


def test_terms_fold_case_and_ignore_marks():
    parts = list(toxicity.terms(pa.array(["Idiot!! 12 idiot", "idiot", None])))
    doc, term = parts[0][2], parts[0][3]
    assert doc.tolist() == [0, 1] and term[0] == term[1]


def test_terms_neutral_alone_are_learnt_as_pairs(spark):
    """Through fit() and score(), beside terms that tell the label by themselves."""
    draw, rows = random.Random(5), []
    for i in range(3200):
        a, b, bad = draw.randrange(2), draw.randrange(2), draw.random() < 0.15
        ws = ["left" + "pq"[a], "right" + "pq"[b], *("f" + chr(97 + k % 26) + chr(97 + k // 26) for k in draw.choices(range(300), k=10))]
        rows.append((i, " ".join(ws + ["bad" + chr(97 + k) for k in draw.sample(range(12), 3 * bad)]), int(bad or a != b)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(d.drop("toxic"), d.drop("text")).where("held_out").collect()
    y = {i: label for i, _, label in rows}
    assert len(got) > 600 and sum((r["score"] > 0.5) == y[r["doc_id"]] for r in got) / len(got) > 0.95


def test_trains_on_20_000_rows(spark):
    """A term of three of 20,000 labelled documents has a value wherever they fall in the hash order."""
    assert toxicity.TRAIN_ROWS == 20_000
    d = spark.range(30_000).where("crc32(cast(cast(id as string) as binary)) % 4 != 2").limit(20_000).selectExpr("id as doc_id", "'word' as text", "cast(id % 2 as int) as toxic").cache()
    late = {r["doc_id"] for r in d.selectExpr("doc_id", "xxhash64(doc_id) as o").orderBy("o").tail(6)}
    docs = d.select("doc_id", "toxic").rdd.map(lambda r: (r[0], "rare word" if r[0] in late else "word", 1 if r[0] in late else 0)).toDF("doc_id long, text string, toxic int")
    _, w, _ = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    rare = next(toxicity.terms(pa.array(["rare"])))[3][0]
    assert w[rare] > 0
