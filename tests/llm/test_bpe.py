import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from speechtab.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Codec(open(PATH, encoding="utf-8").read())
ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", " \n\t  a  b　  c", "don't I'LL we'll", "ab" * 5000, "\x00\x1c\x1f \x85z", "🙂👩‍👩‍👧 ٣٤", "a" * 1000 + " " * 1000 + "1234567890" * 30, "x²½Ⅷ_y_ __ 1_2", "é" * 300]


def agrees(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text).tolist() == ids
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", categories=["L", "N", "P", "S", "Z", "Cc"]), max_size=200) | st.text(alphabet="aeinst' .,0²\n_é", max_size=300))
def test_any_text(text):
    agrees(text)


def test_long_words_merge_alike():
    rng = np.random.default_rng(0)
    for n in (1, 2, 95, 96, 97, 400):
        word = bytes(rng.choice(list(b"aeinstrolhd"), n))
        short = OWN.merge_short([word])[0] if n > 1 else None
        if short is not None:
            assert short == OWN.merge_long(word)


def test_ranks_of_the_other_form():
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "the ranks of both files give the same pieces of transformation"
    assert [OWN.bytes_of[i] for i in OWN.encode(text)] == [other.decode_single_token_bytes(i) for i in other.encode_ordinary(text)]


def test_decode_refuses_unknown_ids():
    with pytest.raises(KeyError):
        OWN.decode([60_000])


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate([None, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    encoded = bpe.encode(docs, PATH)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()}
    digests = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert back[i] == (t or "") and digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
