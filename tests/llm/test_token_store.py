import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sentibar.llm import token_store as T

from .helpers import frame, prose


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(T.model_path())
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n\n c ", "it's we'll 'd", "<|endoftext|> x<|endoftext|>",
       "a b", "a  b", "日本 語", "\U0001f600 \U0001f600", "é  é", "x" * 3000, "1 22  333 . ,,", "\t\ta",
       "a\x1c b", "\x85 c d", "tail \n", " ", "!" * 70]


def test_chunks_equal_the_library(tok):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n\ta'sb1.é \x1c") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for limit in (5, 200_000):
        e = T.ChunkEncoder(T.model_path(), limit)
        for i in range(0, len(texts), 250):
            for t, got in zip(texts[i:i + 250], e.encode(texts[i:i + 250])):
                assert np.frombuffer(got, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_blocks_round_trip(block):
    rng = np.random.default_rng(block)
    cases = [np.zeros(0, int), np.array([0]), np.array([65535] * 300), np.arange(0, 65536, 97), np.zeros(2000, int),
             rng.integers(0, 65536, 3000), np.tile(rng.integers(0, 50000, 11), 200), rng.integers(0, 3, 5000),
             np.minimum(rng.geometric(0.01, 9000) * 7, 50256)]
    for ids in cases:
        assert (T.decode_blocks(T.encode_blocks(ids, block)) == ids).all()


def test_prediction_shrinks_repeats_and_checksums_guard_blocks():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50000, 50), 400)
    raw = bytearray(T.encode_blocks(ids))
    assert len(raw) < len(ids) / 4
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        T.decode_blocks(bytes(raw))


def want(rows, tok):
    out, start = [], 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_in_id_order(spark, tok):
    rng = random.Random(3)
    t = ODD + [None, prose(rng, 5000)] + [prose(rng, rng.randint(0, 200)) for _ in range(60)]
    ids = list(range(-10, len(t) - 10))
    rng.shuffle(ids)
    for options in ({}, {"segment": 300, "block": 64}):
        got = T.op5_frame(frame(spark, t, extra=True, ids=ids).repartition(4), **options).collect()
        assert sorted(tuple(r) for r in got) == want(sorted(zip(ids, t), key=lambda r: r[0]), tok)


def test_registered_query(spark, tok):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    got = T.op5_token_files(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == want(sorted((r["doc_id"], r["text"]) for r in rows), tok)


def test_null_and_equal_ids_and_empty_table(spark):
    df = frame(spark, ["a b", "a b", None, "c"], ids=[None, 1, 1, None])
    got = sorted((r.start, r.n_tokens) for r in T.op5_frame(df).collect())
    assert [s for s, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1]]
    assert T.op5_frame(df.limit(0)).count() == 0


def test_hot_ids_are_cut_over_partitions(spark, tok):
    rng = random.Random(9)
    texts = [prose(rng, 5) for _ in range(400)] + ["same text"] * 300 + [prose(rng, 20000)]
    ids = [None] * 200 + [7] * 501
    files = T.write_tokens(frame(spark, texts, ids=ids).repartition(4), T.model_path())
    assert files.select("part").distinct().count() >= 4
    got = sorted((r.start, r.n_tokens) for r in T.op5_frame(frame(spark, texts, ids=ids)).collect())
    assert [s for s, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1]]
    assert sum(n for _, n in got) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts)


def test_words_go_to_the_library_once_whatever_follows_them(monkeypatch):
    e, sent = T.ChunkEncoder(T.model_path()), []
    library = e.library
    monkeypatch.setattr(e, "library", lambda chunks: sent.extend(chunks) or library(chunks))
    words = ["thaner", "été", "oueau", "ndin"]
    e.encode([f"x {a}{m} {b}" for a in words for b in words for m in (",", ".", "!", ";")])
    assert sorted(sent) == sorted(["x", ",", ".", "!", ";", *[" " + w for w in words]])
    plain = [w for w in words if w.isascii()]
    e.encode([f"{a}\n{b}? {a}" for a in plain for b in plain])
    assert sorted(sent[9:]) == sorted(["\n", "?", *plain])


def test_a_full_table_starts_again_with_the_chunks_at_hand(tok):
    e = T.ChunkEncoder(T.model_path(), 3)
    for t in ("a b c d e", "e f, g\nh", "a b c d e f g h"):
        assert np.frombuffer(e.encode([t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(e.known) == 8 and len(e.at) == 9 and e.at[-1] == len(e.ids)


def test_blocks_share_the_frequencies_of_their_segment():
    rng = np.random.default_rng(4)
    chance = 1 / (np.arange(20000) + 10.0)
    chance /= chance.sum()
    ids = rng.permutation(50000)[:20000][rng.choice(20000, 200000, p=chance)]
    raw = T.encode_blocks(ids)
    assert (T.decode_blocks(raw) == ids).all()
    assert 8 * len(raw) / len(ids) < 1.07 * -(chance * np.log2(chance)).sum()


def test_carries_and_rare_ids_round_trip():
    rng = np.random.default_rng(8)
    for _ in range(20):
        ids = np.where(rng.random(3000) < 0.02, rng.integers(0, 65536, 3000), rng.integers(0, 2, 3000))
        assert (T.decode_blocks(T.encode_blocks(ids, 50)) == ids).all()
