import random

import pytest

from tesserae.llm import encoding as E

S = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def texts():
    rnd = random.Random(2)
    alphabet = "abz AB's't're've'll'd'm\n\t\r   　​́éß中日123½²٣!?…'\"𝒳🙂<|endoftext|>\x85\x1c᠎﻿"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    return [None, "", " ", "  ", "'", "'s", "''s", " 's", "x'", "x'l", "x're'", "I'll've been", "a\n'd", "a  b", "a \n b ", "\n\n", "<|endoftext|>", "= " * 4000, "a" * 20000, " " * 3000 + "x", *made]


def test_equals_library(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(texts())]
    got = {r.doc_id: r.ids for r in E.encode(spark.createDataFrame(rows, S)).collect()}
    want = library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)
    assert [k for k, _, _ in rows if got[k] != want[k].ids] == []


def test_round_trip_and_offsets(spark):
    rows = [(k, t, "clash") for k, t in enumerate(texts())]
    enc = E.encode(spark.createDataFrame(rows, S), offsets=True).cache()
    back = {r.doc_id: r.text for r in E.decode(enc).collect()}
    assert all(back[k] == (t or "") for k, t, _ in rows)
    names = {r: b for b, r in E.read_ranks(open(E.RANKS, "rb").read()).items()}
    for r in enc.collect():
        data = (rows[r.doc_id][1] or "").encode()
        assert len(r.offsets) == len(r.ids)
        assert all(data[o : o + len(names[i])] == names[i] for i, o in zip(r.ids, r.offsets))


def test_small_chunks_agree(monkeypatch):
    enc = E.Encoder(E.read_ranks(open(E.RANKS, "rb").read()), E.class_table())
    t = texts()[:400]
    ids, count = enc(t)
    monkeypatch.setattr(E, "CHUNK", 50)
    parts = [enc(t[a:b]) for a, b in E._chunks(t)]
    assert sum((p[0].tolist() for p in parts), []) == ids.tolist()
    assert sum((p[1].tolist() for p in parts), []) == count.tolist()


def test_empty_table(spark):
    assert E.encode(spark.createDataFrame([], S)).collect() == []
