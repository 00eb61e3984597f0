import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import bpe
from ledgerlark.llm.registry import tokenizer_file

PATH = tokenizer_file()
ODD = "a\x1c\x1d b \x85\xa0   ᠎﻿̧́eİIΣσ.,_-×÷'sSlLrRveſŸßÀﬁ½²ª\U0001f600가क़Ω\n\t\x00019<|"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, cache=200)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=ODD, max_size=40), st.sampled_from(["<|endoftext|>", "x<|startoftext|>y", "İ<|endoftext|>İ"])))
def test_equals_the_library(codec, text):
    got = np.frombuffer(codec.encode_texts([text])[0], "<u4").tolist()
    want = codec.model.encode(text, add_special_tokens=False)
    assert got == want.ids and codec.decode(got) == codec.model.decode(want.ids, skip_special_tokens=False)


def test_transducer_accepts_exactly_its_words():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode(): np.array([i, i + 1][: 1 + i % 2], "<u4").tobytes() for i in range(400)}
    t = bpe.Transducer.build(words)
    others = [b"", b"zz", b"a" * 9, "é".encode()[:1]]
    assert t.find([*words, *others]) == [*words.values(), *[words.get(o) for o in others]]
    assert len(t.final) < sum(len(w) for w in words)  # suffixes are shared


def test_empty_transducer():
    assert bpe.Transducer.build({}).find([b"a"]) == [None]


def test_saved_automaton_is_mapped(tmp_path):
    t = bpe.Transducer.build({b"ab": b"\1\0\0\0", b"b": b"\2\0\0\0"})
    t.save(f"file://{tmp_path}/lex")
    back = bpe.Transducer.load(f"file://{tmp_path}/lex")
    assert isinstance(back.arcs, np.memmap) and back.find([b"ab", b"b", b"a"]) == [b"\1\0\0\0", b"\2\0\0\0", None]


def test_encode_decode_round_trip(odd, odd_rows, codec):
    lex = bpe.compile_lexicon(odd, PATH, limit=5)
    enc = bpe.encode(odd, PATH, lex)
    assert enc.count() == len(odd_rows)
    texts = {}
    for r in odd_rows:
        texts.setdefault(r[0], set()).add(tuple(codec.model.encode(r[1] or "", add_special_tokens=False).ids))
    for r in enc.collect():
        assert tuple(r["ids"]) in texts[r["doc_id"]]
    dec = bpe.decode(enc, PATH).where("doc_id = 65").first()["text"]
    assert dec == codec.model.decode(codec.model.encode("a b", add_special_tokens=False).ids, skip_special_tokens=False)


def test_round_trip_digests(odd, codec):
    from hashlib import sha256

    r = bpe.round_trip(odd.where("doc_id = 63"), PATH).first()
    e = codec.model.encode(odd.where("doc_id = 63").first()["text"], add_special_tokens=False)
    assert r["n_tokens"] == len(e.ids) and r["ids_sha256"] == sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
    assert r["decoded_sha256"] == sha256(codec.model.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_words_stay_within_the_limit(odd, none):
    assert 0 < len(bpe.frequent_words(odd, limit=8)) <= 8
    assert bpe.frequent_words(none) == []
    assert bpe.round_trip(none, PATH, bpe.compile_lexicon(none, PATH)).count() == 0


def test_whole_table_equals_the_library(spark, codec):
    """The query over all documents of a size, with its own lexicon."""
    from hashlib import sha256

    from ledgerlark.llm import registry

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:4] for r in registry.op1_bpe_round_trip(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc, text in rows:
        ids = codec.model.encode(text or "", add_special_tokens=False).ids
        want[doc] = len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(codec.model.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got == want and len(rows) == len(want)
