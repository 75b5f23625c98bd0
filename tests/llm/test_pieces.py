import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from sentibar.llm import pieces as P

from .helpers import frame, prose


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


ODD = [None, "", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a   b ", "\n", "\n\n a\tb \n", "▁", "a▁b",
       "a ▁ b", "▁▁x ", "<s> </s> <unk> <0x41>", "日本語 テキスト", "\U0001f600 a\U0001f600", "a b",
       "é" * 50, "x" * 5000, " " * 300, "a" + " " * 77 + "b" + " " * 33, "\0 a\0", "\x01\x02 \x7f"]


def want(sp, text):
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    return ids, sp.decode(ids)


def test_equals_the_library_on_odd_texts(sp):
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" ▁ab\n\0é") for _ in range(rng.randint(0, 30)))
                                      for _ in range(3000)]
    for limit in (10, 200_000):
        codec = P.ChunkCodec(P.model_path(), limit)
        for i in range(0, len(texts), 500):
            for t, ids, dec in zip(texts[i:i + 500], *codec.encode_decode(texts[i:i + 500])):
                assert (np.frombuffer(ids, "<u4").tolist(), dec) == want(sp, t), repr(t)


def test_registered_query(spark, sp):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in P.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids, dec = want(sp, r["text"])
        g = got[r["doc_id"]]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(dec.encode()).hexdigest())


def test_frame_cases(spark, sp):
    t = ODD + [prose(random.Random(2), 20000)] * 2
    ids = list(range(len(t) - 2)) + [None, 0]
    got = P.encode_decode(frame(spark, t, extra=True, ids=ids), P.model_path()).collect()
    assert sorted((bytes(r.ids), r.decoded) for r in got) == sorted(
        (np.array(want(sp, x)[0], "<u4").tobytes(), want(sp, x)[1]) for x in t)
    assert P.encode_decode(frame(spark, t).limit(0), P.model_path()).count() == 0
