import hashlib

import numpy as np
import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline as C
from sentibar.llm import decontam, pieces

from .helpers import frame
from .test_quality import plain as plain_quality
from .test_simhash import plain_components, plain_fp


def cut_repeats(rows, k=13):
    """Whole-text version of the substring stage: a removed word goes with the
    white space after it."""
    import re

    first, out = {}, []
    split = [(i, [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t.encode())], t.encode()) for i, t in rows]
    for i, spans, raw in split:
        w = [raw[a:b] for a, b in spans]
        for x in range(len(w) - k + 1):
            g = b" ".join(w[x:x + k])
            first[g] = min(first.get(g, i), i)
    for i, spans, raw in split:
        w = [raw[a:b] for a, b in spans]
        gone = {y for x in range(len(w) - k + 1) if first[b" ".join(w[x:x + k])] < i for y in range(x, x + k)}
        ends = [a for a, _ in spans[1:]] + [len(raw)]
        text = raw[:spans[0][0]] if spans else raw
        for x, ((a, _), e) in enumerate(zip(spans, ends)):
            if x not in gone:
                text += raw[a:e]
        out.append((i, text.decode()))
    return out


def test_run_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    rows = [(i, t) for i, t in rows if plain_quality(t)[-1]]
    comp = plain_components([i for i, _ in rows], [plain_fp(t) for _, t in rows])
    rows = [(i, t) for (i, t), c in zip(rows, comp) if i == c]
    rows = cut_repeats(rows)
    items = [decontam.Items([b["item_id"]], [b["text"]], decontam.TILE)
             for b in pq.read_table(f"{d}/benchmark.parquet").to_pylist()]
    rows = [(i, t) for i, t in rows if not any(decontam.matched(x, [t], decontam.COVERAGE) for x in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = {}
    for i, t in rows:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        want[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), raw)
    got = C.run(spark, d).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == want


def test_stages_keep_the_columns_of_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = C.read(spark, d, "documents").limit(60).selectExpr("*", "'x' AS seen", "1 AS component")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = out


def test_stages_on_empty_and_null_rows(spark):
    d = "/root/testdata/sf0.001"
    for docs in (frame(spark, ["a"]).limit(0), frame(spark, [None, "", None], ids=[None, 1, 1])):
        for _, stage in C.STAGES:
            stage(spark, docs, d).collect()
