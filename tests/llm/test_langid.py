import math

import numpy as np
import pyarrow as pa
import pytest

from speechtab.llm import langid


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs)
    return docs, model, langid.identify(docs, model)


def test_held_out_accuracy_by_language(scored):
    docs, _, got = scored
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").select("lang", "lang_pred", "score").collect()
    for lang in ("de", "en", "es", "fr"):
        own = [r["lang_pred"] == lang for r in rows if r["lang"] == lang]
        assert len(own) > 150 and sum(own) / len(own) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain(text, langs, weights):
    """Decision for one text by loops over its bytes."""
    b = text.encode()
    fold = [x + 32 if 65 <= x < 91 else x if 97 <= x < 123 or x >= 128 else 32 for x in b]
    total, count = np.zeros(weights.shape[1]), 0
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(fold) - n + 1):
            g = 0
            for x in fold[i : i + n]:
                g = (g * 257 + x) % 2**32
            total += weights[((g + n - 1) * 0x9E3779B1 % 2**32) >> 17].astype(np.float64)
            count += 1
    z = langid.SCALE * total / max(1, count) + weights[langid.DIM]
    machines = dict(zip(langid.pairs(langs), z))

    def among(names):
        def mean(n):
            p = [1 / (1 + math.exp(-langid.SLOPE * (machines[n, o] if n < o else -machines[o, n]))) for o in names if o != n]
            return sum(p) / len(p) if p else 1.0

        def rank(n):
            m = [machines[n, o] if n < o else -machines[o, n] for o in names if o != n]
            return -sum(x > 0 for x in m), -sum(m), n

        best = min(names, key=rank)
        return best, mean(best)

    fam, p = among(sorted({langid.family(x) for x in langs}))
    lang, q = among([x for x in sorted(langs) if langid.family(x) == fam])
    return lang, p * q


def test_scores_equal_loops_over_bytes(spark, scored, monkeypatch):
    _, (langs, weights), _ = scored
    texts = ["The thing of ereas.", "Die einheit ß und", "la éè de ñ", "a", "Été 12", "x" * 700, "ouéle " * 300 + "das ist"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [plain(t, langs, weights) for t in texts]
    for got in (langid.identify(df, (langs, weights)).orderBy("doc_id").collect(),):
        assert [(r["lang_pred"], round(r["score"], 9)) for r in got] == [(x, round(p, 9)) for x, p in want]
    monkeypatch.setattr(langid, "SLICE_BYTES", 64)  # long texts in pieces give the same
    lang, score = langid.decide(langid.margins(pa.array(texts), weights), langs)
    assert [(langs[k], round(p, 9)) for k, p in zip(lang, score)] == [(x, round(p, 9)) for x, p in want]


def test_family_first_then_language():
    langs = ["de", "en", "es", "fr", "qx"]
    assert langid.pairs(langs) == [("germanic", "qx"), ("germanic", "romance"), ("qx", "romance"), ("de", "en"), ("es", "fr")]
    z = np.array([[1.0, 1.0, -1.0, -2.0, 5.0], [-1.0, 1.0, 1.0, 0.0, 0.0]])  # the margin of es and fr does not count in a Germanic text
    lang, score = langid.decide(z, langs)
    assert [langs[k] for k in lang] == ["en", "qx"] and score[1] == pytest.approx(1 / (1 + math.exp(-2)))


def test_held_out_rows_and_ids_are_never_learnt(spark):
    import zlib

    rows = [(i, "the thing and that" if i % 2 else "der die und das", "en" if i % 2 else "de") for i in range(200)]
    swapped = [(i, t, ("de" if v == "en" else "en") if zlib.crc32(str(i).encode()) % 5 == 0 else v) for i, t, v in rows]
    models = [langid.fit(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)) for r, n in ((rows, 3), (swapped, 6))]
    assert models[0][0] == models[1][0] == ["de", "en"] and (models[0][1] == models[1][1]).all()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(1, "the thing", "en", 0), (1, "the thing", "en", 0), (2, None, "en", 0), (3, "", "de", 0), (4, "12 --- 34", "de", 0), (None, "der die", "de", 0), (6, "der die das", "de", 0), (7, "x", None, 0), (8, "die und " * 100_000, "de", 0), (11, "the end", "en", 0)]
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (2, 3, 4)} == {i: ("und", 0.0) for i in (2, 3, 4)}
    assert next(r for r in got if r["doc_id"] == 8)["lang_pred"] == "de" and not next(r for r in got if r["doc_id"] is None)["held_out"]
    empty = spark.createDataFrame([], schema)
    assert langid.identify(empty).collect() == []
    unlabelled = langid.identify(spark.createDataFrame([(1, "the", None, 0)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]
    single = langid.identify(spark.createDataFrame([(i, "the", "en", 0) for i in range(9)], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in single} == {("en", 1.0)}
