import io
import math
import struct
import wave

import pytest
from pyspark.sql import functions as F

from speechtab.functions import text as X
from speechtab.operators import lm as L
from speechtab.sources import arpa, manifests as M, wav


def test_manifest_round_trip_and_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": "c1", "duration": 2.5, "supervisions": [{"id": "s", "text": "x y"}], "custom": {"k": "v"}}\nnot json\n')
    df = M.read_manifest(spark, str(tmp_path / "in"), "cuts", partitions=3)
    assert df.where("corrupt is not null").count() == 1
    M.write_manifest(df.where("corrupt is null"), str(tmp_path / "out"))
    back = M.read_manifest(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1 and back[0]["custom"] == {"k": "v"}
    assert M.cuts_to_text(df.where("corrupt is null")).first()["value"] == "x y"


def test_shards_by_pool_and_suffix(spark, tmp_path):
    for pool, name in (("ssl_a", "x_cuts_a_k1.00000000.jsonl"), ("ssl_a", "x_cuts_a_k1.00000001.jsonl"), ("ssl_a", "x_cuts_a_k2.00000000.jsonl"), ("ssl_b", "x_cuts_b_k1.00000000.jsonl"), ("ssl_b", "x_cuts_b_k1.raw.jsonl"), ("dev", "x_cuts_dev_k1.00000000.jsonl")):
        (tmp_path / pool).mkdir(exist_ok=True)
        import gzip

        with gzip.open(tmp_path / pool / f"{name}.gz", "wt") as f:
            f.write('{"id": "%s"}\n' % name)
    df = M.read_shards(spark, str(tmp_path), "ssl_", "_k1")
    assert sorted((r["pool"], r["shard"]) for r in df.collect()) == [("ssl_a", "00000000"), ("ssl_a", "00000001"), ("ssl_b", "00000000")]
    order = [r["shard_order"] for r in M.shuffle_shards(df, 142).orderBy("id").collect()]
    assert order == [r["shard_order"] for r in M.shuffle_shards(df.repartition(5), 142).orderBy("id").collect()]


def test_transcripts(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/a.trans.txt").write_text("u1 HELLO  there you\nu2\nu3\tx\n")
    (tmp_path / "d/e/b.txt").write_text("no\n")
    good, bad = M.read_transcripts(spark, str(tmp_path))
    assert sorted((r["utt_id"], r["text"], r["dir"][-4:]) for r in good.collect()) == [("u1", "HELLO  there you", "/d/e"), ("u3", "x", "/d/e")]
    assert [r["value"] for r in bad.collect()] == ["u2"]


def riff(*parts, size=None):
    body = b"".join(struct.pack("<4sI", k, len(d) if n is None else n) + d + b"\0" * (len(d) % 2) for k, d, n in parts)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body) if size is None else size, b"WAVE") + body


def test_audio_index(spark, tmp_path):
    (tmp_path / "spk").mkdir()
    with wave.open(str(tmp_path / "spk/one.two.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(struct.pack("<8000h", *range(8000)))
    form = (b"fmt ", struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16), None)
    extensible = (b"fmt ", struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 4, 1, b"x" * 14), None)
    files = {
        "far back": riff(form, (b"LIST", b"m" * 1_000_001, None), (b"data", b"\0" * 400, None)),
        "extensible": riff(extensible, (b"data", b"\0" * 10, None)),
        "cut": (tmp_path / "spk/one.two.wav").read_bytes()[:1000],
        "float": riff((b"fmt ", struct.pack("<HHIIHH", 3, 1, 8000, 32000, 4, 32), None), (b"data", b"", None)),
        "early": riff((b"data", b"", None), form),
        "no samples": riff(form),
        "short format": riff((b"fmt ", b"12", None)),
        "long": b"RF64" + riff((b"ds64", struct.pack("<QQQI", 0, 40, 20, 0), None), form, (b"data", b"\0" * 40, 0xFFFFFFFF))[4:],
        "text": b"no audio",
        "empty": b"",
    }
    for name, data in files.items():
        (tmp_path / "spk" / f"{name}.wav").write_bytes(data)
    (tmp_path / "spk/._hidden.wav").write_bytes(b"")
    good, bad = M.audio_index(spark, str(tmp_path))
    got = {r["id"]: (r["sampling_rate"], r["channels"], r["num_samples"], r["duration"]) for r in good.collect()}
    assert got == {"spk-one.two": (16000, 1, 8000, 0.5), "spk-far back": (8000, 2, 100, 0.0125), "spk-extensible": (8000, 1, 5, 5 / 8000), "spk-long": (8000, 2, 10, 10 / 8000)}
    errors = {r["path"].rpartition("/")[2][:-4]: r["error"] for r in bad.collect()}
    assert errors == {"cut": "truncated", "float": "no PCM", "early": "samples before their format", "no samples": "no samples", "short format": "truncated", "text": "no WAVE file", "empty": "no WAVE file"}


def test_a_header_far_back_is_read_by_seeking():
    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            data = super().read(n)
            self.total += len(data)
            return data

    data = wav.head_bytes(8000, 1, 8, 4, "c" * 3_000_000) + b"abcd"
    f = Counting(data)
    assert wav.read_header(f, len(data)) == (8000, 1, 8, 4, len(data) - 4, 4) and f.total < 200


def test_audio_round_trip(spark, tmp_path):
    rows = [("a/x", 8000, 1, 8, b"abc", None), ("a/y z", 16000, 2, 16, b"\0\1\2\3" * 5, "é" * 100_000), ("b/ü", 8000, 1, 8, b"", ""), ("n", 8000, 1, 8, None, "c")]
    df = spark.createDataFrame(rows, "id string, sampling_rate int, channels int, bits int, data binary, comment string").repartition(3)
    M.write_audio(df, str(tmp_path / "w"))
    M.write_audio(df.where("id = 'n'"), str(tmp_path / "w"))  # again: the same file
    assert M.prepared(spark, str(tmp_path / "w")) and not list((tmp_path / "w").rglob("._*"))
    back = spark.read.format("wav").option("content", "true").option("filesPerPartition", 2).load(str(tmp_path / "w"))
    assert back.rdd.getNumPartitions() == 2
    got = {r["path"].removeprefix(f"{tmp_path}/w/").removesuffix(".wav"): (r["sampling_rate"], r["channels"], r["bits"], bytes(r["data"]), r["error"]) for r in back.collect()}
    assert got == {i: (rate, ch, bits, data or b"", None) for i, rate, ch, bits, data, _ in rows}
    with wave.open(str(tmp_path / "w/a/y z.wav")) as w:
        assert (w.getnchannels(), w.getframerate(), w.readframes(9)) == (2, 16000, b"\0\1\2\3" * 5)
    M.write_audio(df.where("id = 'n'"), str(tmp_path / "w"), "overwrite")
    assert [r["num_samples"] for r in M.audio_index(spark, str(tmp_path / "w"))[0].collect()] == [0]
    with pytest.raises(Exception, match="needs columns"):
        M.write_audio(df.drop("bits"), str(tmp_path / "v"))
    (tmp_path / "none").mkdir()
    assert M.audio_index(spark, str(tmp_path / "none"))[0].collect() == []


def test_named_shards_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"i{k}", f"ssl_p{k % 3}", f"{k % 2:08d}") for k in range(30)], "id string, pool string, shard string")
    M.write_named_shards(df, str(tmp_path), suffix="_k7")
    assert (tmp_path / "ssl_p1/x_cuts_p1_k7.00000001.jsonl.gz").exists() and not (tmp_path / "_writing").exists()
    assert sorted(map(tuple, M.read_shards(spark, str(tmp_path), "ssl_", "_k7").select("id", "pool", "shard").collect())) == sorted(map(tuple, df.collect()))


def test_first_of_several_models(spark, tmp_path):
    one = "\\data\\\nngram 1=1\n\n\\1-grams:\n-1.0\ta\n\n\\end\\\n"
    (tmp_path / "two.arpa").write_text(one + one.replace("-1.0\ta", "-2.0\tb"))
    assert [(r["w"], r["log_p"]) for r in arpa.read_arpa(spark, str(tmp_path / "two.arpa")).collect()] == [("a", -1.0)]


def test_split_and_write(spark, tmp_path):
    df = M.split_manifest(spark.range(1050).select(F.col("id").cast("string").alias("id")), 200, [F.col("id").cast("int")])
    assert {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()} == {f"{i:08d}": 200 if i < 5 else 50 for i in range(6)}
    M.write_shards(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1050
    assert M.write_if_absent(df, str(tmp_path / "p")) and not M.write_if_absent(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1050


def test_symbols_lexicon_and_results(spark, tmp_path):
    M.write_symbols(spark.createDataFrame([("b", 1), ("a", 0)], "symbol string, id long").coalesce(1), str(tmp_path / "sym"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sym")).collect()] == ["a 0", "b 1"]
    M.write_lexicon(spark.createDataFrame([(1, "w", ["x", "y"])], "ord long, word string, tokens array<string>"), str(tmp_path / "lex"))
    assert spark.read.text(str(tmp_path / "lex")).first()[0] == "w x y"
    res = spark.createDataFrame([("s1", "c1", ["a", "b"], ["a", "c"]), ("s2", "c1", ["a", "b"], ["a", "b"])], "setting string, cut_id string, ref array<string>, hyp array<string>")
    M.write_results(res, str(tmp_path / "res"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "res/wer-summary")).collect()] == ["settings\tWER", "s2\t0.0", "s1\t50.0"]
    lines = [r[0] for r in spark.read.text(str(tmp_path / "res/errs/setting=s1")).collect()]
    assert lines == ["%WER = 50.0", "Errors: 0 insertions, 0 deletions, 1 substitutions, over 2 reference words (1 correct)", "c1:\ta (b->c)", "1 b -> c", "b\t0\t1\t0\t0", "a\t1\t0\t0\t0"]
    odd = spark.createDataFrame([("s", "2", ["x"], None), ("s", "1", None, ["y", "y"]), ("t", "1", None, None)], "setting string, cut_id string, ref array<string>, hyp array<string>")
    M.write_results(odd, str(tmp_path / "odd"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "odd/errs/setting=s")).collect()]
    assert lines[2:] == ["1:\t(*->y) (*->y)", "2:\t(x->*)", "1 x", "2 y", "y\t0\t0\t0\t2", "x\t0\t0\t1\t0"]
    assert [r[0] for r in spark.read.text(str(tmp_path / "odd/wer-summary")).collect()] == ["settings\tWER", "t\t-", "s\t300.0"]
    assert spark.read.text(str(tmp_path / "res/recogs/setting=s1")).count() == 2


def test_arpa_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(["a", "b"],), (["a"],)], "words array<string>")
    lm = L.kn_model(lines, 2)
    arpa.write_arpa(lm, str(tmp_path / "lm"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "lm"), wholetext=False).collect()]
    assert text[0] == "\\data\\" and "ngram 1=4" in text and text[-1] == "\\end\\" and text.index("\\1-grams:") < text.index("\\2-grams:")
    back = {(r["n"], tuple(r["hist"]), r["w"]): (r["log_p"], r["log_bo"]) for r in arpa.read_arpa(spark, str(tmp_path / "lm")).collect()}
    want = {(r["n"], tuple(r["hist"]), r["w"]): (r["log_p"], r["log_bo"]) for r in lm.collect()}
    assert set(back) == set(want)
    assert all(math.isclose(back[k][0], want[k][0], abs_tol=1e-7) and (back[k][1] is None) == (want[k][1] is None) for k in want)


@pytest.mark.parametrize("raw, want", [
    ("..straße (a (b) c) Ｆｕｌｌ x-y?!..", "STRASSE C) FULL X Y"), ("a.b, c", "A B C"), ("...", ""), (None, None),
])
def test_normalize_text(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(X.normalize_text(F.col("t"))).first()[0] == want


def test_small_functions(spark):
    df = spark.createDataFrame([(["", "a", "a", "b", "a"], "x y", "noblank", "/d/sp-1/u.tar.wav")], "v array<string>, a string, b string, p string")
    r = df.select(X.collapse_repeats(F.col("v")).alias("c"), X.after_first_field(F.col("a")).alias("a"), X.after_first_field(F.col("b")).alias("b"), X.derive_id(F.col("p")).alias("i"), X.speaker_of(X.derive_id(F.col("p"))).alias("s")).first()
    assert (r["c"], r["a"], r["b"], r["i"], r["s"]) == (["a", "b", "a"], "y", "noblank", "sp-1-u.tar", "sp")
    with pytest.raises(Exception, match="outside the prefix"):
        df.select(X.remap_prefix(F.col("p"), "/other", "/n")).collect()


def test_only_texts_that_may_change_are_composed(spark):
    import re
    import unicodedata

    stable = [chr(c) for c in range(0x0132) if not re.match("[^\x00-\x7f\u00c0-\u0131]", chr(c))]
    assert len(stable) > 230 and unicodedata.normalize("NFKC", "".join(stable)) == "".join(stable) and unicodedata.normalize("NFKC", "".join(stable[::-1])) == "".join(stable[::-1])
    texts = ["plain", "Stra\u00dfe \u00e9\u00f1", "e\u0301 x", "\uff21 \u00a0 \ufb01", "\u1112\u1161\u11ab", "\u00b2", "𝐀", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.composed(F.col("t"))).collect()]
    assert got == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_packed_arpa_is_the_same_file(spark, tmp_path):
    """Also: what is sorted holds an n-gram's words once and no finished lines."""
    import gzip

    lm = spark.createDataFrame([(1, [], "a", -1.0, None), (1, [], "b", -99.5, -0.25), (1, [], "c", None, 0.0), (2, ["b"], "a", -0.125, None)], "n int, hist array<string>, w string, log_p double, log_bo double")
    arpa.write_arpa(lm, str(tmp_path / "plain"))
    arpa.write_arpa(lm, str(tmp_path / "packed"), compression="gzip")
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "plain").glob("part-*")))
    packed = b"".join(p.read_bytes() for p in sorted((tmp_path / "packed").glob("part-*.gz")))
    assert gzip.decompress(packed) == plain
    assert plain.decode() == "\\data\\\nngram 1=3\nngram 2=1\n\n\\1-grams:\n-1.0000000\ta\n-99.0000000\tb\t-0.2500000\n-99.0000000\tc\t0.0000000\n\n\\2-grams:\n-0.1250000\tb a\n\n\\end\\\n"
    rows = lambda path: sorted(map(str, arpa.read_arpa(spark, str(path)).collect()))
    assert rows(tmp_path / "packed") == rows(tmp_path / "plain") and len(rows(tmp_path / "plain")) == 4
    assert all(r["head"] is None and r["key"] in ("a", "b", "c", "b a") for r in arpa._lines(lm).where("p is not null").collect())
