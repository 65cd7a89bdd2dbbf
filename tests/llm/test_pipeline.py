import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from speechtab.llm import mixing, neardup, pii, toxicity


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["toxicity"](spark, docs, sf_dir).cache()
    scored = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == scored

    unique = steps["near_duplicates"](spark, kept, sf_dir).cache()
    want = {r["doc_id"] for r in neardup.near_duplicates(kept, 5).where("kept").collect()}
    assert unique.columns == columns and {r["doc_id"] for r in unique.collect()} == want

    clean = steps["pii"](spark, unique, sf_dir).cache()
    assert clean.columns == columns and clean.count() == unique.count()
    assert all(not any(k < 4 for k, *_ in pii.base_spans(r["text"])) for r in clean.collect() if r["text"])

    mixed = steps["mixing"](spark, clean, sf_dir).cache()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(clean).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert mixed.columns == columns and got == {i: n for i, n in taken.items() if n}

    tokens = steps["bpe"](spark, mixed, sf_dir)
    assert tokens.count() == mixed.count()


def test_odd_rows_and_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (3, "a b c", "en", "s", 5), (None, "x y", "en", "t", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            rows = step(spark, rows, sf_dir)
        rows.count()


def test_repeated_rows_leave_once(spark, sf_dir):
    docs = spark.createDataFrame([(3, "a b c", "s"), (3, "a b c", "s"), (3, None, "s"), (4, "a b c", "t"), (None, "x", "t")], "doc_id long, text string, source string")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir).collect()
    assert sorted(map(tuple, out), key=str) == [(3, "a b c", "s"), (None, "x", "t")]


def test_clashing_names_and_rows_without_an_id(spark, sf_dir):
    """Further columns of any name go through every stage; the mix counts rows as they are."""
    names = ["size", "taken", "words", "row", "key", "source_size", "target", "score", "band", "kept", "rep", "range", "ids", "id", "part", "salt", "a.b"]
    rows = [(i, "one two three four five", "s", 23) for i in range(12)] + [(None, "six seven", "s", 9), (None, None, None, None), (3, "other text of that id", "t", 21), (3, "other text of that id", "t", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.selectExpr("*", *(f"'x' as `{n}`" for n in names))
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == docs.columns and out.where("size <> 'x' or `a.b` <> 'x'").count() == 0
        out.count()
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf_dir).collect()
    want = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(len(r["text"].split()) for r in mixed) == want and any(r["doc_id"] is None for r in mixed)
