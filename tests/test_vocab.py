import random

import pytest

from speechtab.operators import vocab as O
from speechtab.plans import texts


@pytest.mark.parametrize("head", [0, 3, 1 << 19])
def test_arrays_become_ids_and_texts_again(spark, monkeypatch, head):
    """Whether all, some or no symbols travel to the tasks."""
    monkeypatch.setattr(O, "HEAD", head)
    rng = random.Random(1)
    symbols = ["<unk>", *(f"▁w{i}" for i in range(12))]
    lists = [[f"▁w{min(rng.randrange(15), rng.randrange(15))}" for _ in range(rng.randrange(9))] for _ in range(60)] + [None, [], ["▁w1", None], ["▁none"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "key long, tokens array<string>").repartition(3)
    table = spark.createDataFrame(list(zip(symbols, range(13))), "symbol string, id long")
    ids = O.to_ids(rows, table, token="tokens")
    got = {r["key"]: r["id"] for r in ids.collect()}
    assert got == {k: v and [symbols.index(w) if w in symbols else 0 for w in v] for k, v in enumerate(lists)}
    odd = ids.withColumnRenamed("id", "ids").unionByName(spark.createDataFrame([(99, [99, None]), (98, [2, 99, 1])], "key long, ids array<long>"))
    back = {r["key"]: r["text"] for r in O.detokenize(odd, table).collect()}
    assert back == {k: "".join(symbols[i] for i in v).replace("▁", " ").strip(" ") for k, v in got.items() if v} | {98: "w1 w0"}


def test_queries_move_no_single_tokens(spark, sf_dir):
    assert "Exchange" not in texts.to_ids(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_number_merge(spark, tmp_path):
    rows = [(1, "a b\nc"), (1, "d"), (2, "a"), (None, "x\ny z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {1_000_000: [["a", "d", "b"], ["d", "a", "b"]], 1_000_001: [["c"]], 2_000_000: [["a"]], None: [["x", "y", "z"], ["y", "x", "z"]]}
    got = texts.detokenize(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r["text"].split() in want[r["key"]] for r in got)
    ids = {r["symbol"]: r["id"] for r in texts.topk_vocab(spark, str(tmp_path)).collect()}
    got = texts.to_ids(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r["ids"].split() in [[str(ids[w]) for w in v] for v in want[r["line"]]] for r in got)
