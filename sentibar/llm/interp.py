"""Deleted-interpolation language model (operator 10).

    P(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1)

with the bucket ``b`` = floor(log2(c(h) + 1)) of the context's frequency and
one set of weights a bucket.  The weights maximise, by expectation-
maximisation, the likelihood of the training tokens under deleted counts:
each token is held out in turn, so its own occurrence is taken off ``c(h, w)``,
``c(h)``, ``c(w)`` and ``N``.

Counts cover the whole corpus and no table of words or bigrams is broadcast.
Documents are packed into batches of about ``BATCH_BYTES`` once, in the shared
folder.  A batch sends its distinct unigram and bigram hashes, cut by hash
range into shards, with its own training counts; a shard adds up all batches
and sends each batch the totals of the keys it asked for, in the batch's
order.  A key travels once a batch, so the most frequent word is no hotter
than any other.  Batches then meet their totals again and score themselves.

Words are compared by 64-bit hashes.  Defined cases: null and empty texts have
only the end token; a null id is scored but not learned from and not held out;
repeated rows count each time; without training tokens every probability is
uniform; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import parts_for, pick, quoted, read, saved
from .langid import fold

U = np.uint64
BATCH_BYTES = 6 << 20
SHARD_BYTES = 64 << 20      # text whose keys meet in two shards, at most
END = U(0xE17A1465B9C4D3F1)       # the end token, and the context before a text
BUCKETS = 64
GRID = 8                          # steps per factor of two in the EM histogram
LOWER = bytes(range(256)).lower()

BATCH = "batch long, ids binary, learn binary, known binary, sizes binary, texts binary"


def packed(docs: DataFrame) -> DataFrame:
    """``docs(id, learn, text)`` -> one row a batch; texts are compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            ids, valid, learn, sizes, texts = zip(*held)
            raw = b"".join(texts)
            yield pa.record_batch([
                pa.array([(part << 32) | nth], pa.int64()),
                *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (ids, learn, valid, sizes)),
                pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())],
                names=["batch", "ids", "learn", "known", "sizes", "texts"])

        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            ids = batch.column("id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            learn = batch.column("learn").fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, text, off in W.slices(data, at):
                held.append((number[lo:hi], known[lo:hi], learn[lo:hi], np.diff(off), text.tobytes()))
                size += len(text) + 64 * (hi - lo)
                if size >= BATCH_BYTES:
                    yield from flush()
                    held, size, nth = [], 0, nth + 1
        if held:
            yield from flush()

    return docs.select("id", "learn", "text").mapInArrow(run, BATCH)


def tokens(sizes: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token per text, the hashes of (context, word), the
    contexts, and the index of each text's first token."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(raw.translate(LOWER), np.uint8)
    found, count = [], []
    for _, _, part, off in W.slices(data, at):
        start, end, first = W.words(part, off)
        found.append(W.span_hash(part, start, end))
        count.append(np.diff(first))
    count = np.concatenate(count) if count else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(count + 1)))
    word = np.full(first[-1], END)
    is_end = np.zeros(len(word), bool)
    is_end[first[1:] - 1] = True
    word[~is_end] = np.concatenate(found) if found else word[:0]
    before = np.concatenate(([END], word[:-1]))   # a text's first context is the end before it
    return word, W.mix(before * U(0xA24BAED4963EE407) + word), before, first


class Keys:
    """The distinct hashes of a batch in order, unigrams and bigrams apart."""

    def __init__(self, row):
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.learn = np.frombuffer(row["learn"], bool)
        self.known = np.frombuffer(row["known"], bool)
        self.ids = np.frombuffer(row["ids"], np.int64)
        raw = pa.decompress(row["texts"], decompressed_size=int(self.sizes.sum()), codec="zstd", asbytes=True) \
            if self.sizes.sum() else b""
        word, pair, before, self.first = tokens(self.sizes, raw)
        self.uni, at = np.unique(word, return_inverse=True)
        self.of_word = at.astype(np.int32)
        self.of_context = np.searchsorted(self.uni, before).astype(np.int32)   # END is always there
        del word, before, at
        self.bi, at = np.unique(pair, return_inverse=True)
        self.of_pair = at.astype(np.int32)
        self.token_learns = np.repeat(self.learn, np.diff(self.first))

    def own_counts(self) -> list[np.ndarray]:
        return [np.bincount(at[self.token_learns], minlength=len(keys))
                for keys, at in ((self.uni, self.of_word), (self.bi, self.of_pair))]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a row may hold megabytes."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def pack_counts(n: np.ndarray) -> bytes:
    """Counts below 255 in a byte each, the others after them."""
    big = n >= 255
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[big].astype("<i8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as byte planes of their gaps: high planes are mostly zero."""
    gaps = np.diff(keys, prepend=U(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U))


def squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def shard_bits(parts: int) -> int:
    return max(1, int(np.ceil(np.log2(2 * parts))))


def corpus_counts(batches: DataFrame) -> DataFrame:
    """For every batch, order and shard the totals of the batch's keys:
    ``(batch, ngram, shard, n, counts)``; and a row with batch -1 a shard with
    its training tokens and distinct words (order 1) as two longs."""
    # a shard of an order is held by one task: their number follows the text
    parts = max(parts_for(batches), -(-batches.count() * BATCH_BYTES // SHARD_BYTES))
    bits = shard_bits(parts)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in rows_of(batch):
                k = Keys(row)
                for order, keys, own in zip((1, 2), (k.uni, k.bi), k.own_counts()):
                    cut = np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(64 - bits))
                    spans = [(s, x, y) for s, (x, y) in enumerate(zip(cut, np.append(cut[1:], len(keys)))) if y > x]
                    yield pa.record_batch([
                        pa.array([s for s, _, _ in spans], pa.int32()),
                        pa.array([order] * len(spans), pa.int32()),
                        pa.array([row["batch"]] * len(spans), pa.int64()),
                        pa.array([y - x for _, x, y in spans], pa.int32()),
                        pa.array([squeeze(pack_keys(keys[x:y])) for _, x, y in spans], pa.binary()),
                        pa.array([pack_counts(own[x:y]) for _, x, y in spans], pa.binary())],
                        names=["shard", "ngram", "batch", "n", "hashes", "own"])

    def total(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and order; one such group at a time."""
        now, group = None, []

        def reply():
            keys = [unpack_keys(pa.decompress(r["hashes"], decompressed_size=8 * r["n"], codec="zstd", asbytes=True), r["n"])
                    for r in group]
            own = [unpack_counts(r["own"], r["n"]) for r in group]
            known, back = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate(own), minlength=len(known)).astype(np.int64)
            ends = np.cumsum([r["n"] for r in group])
            out = [squeeze(pack_counts(sums[back[e - r["n"]:e]])) for e, r in zip(ends, group)]
            sizes = [r["n"] for r in group]
            ids = [r["batch"] for r in group]
            if now[1] == 1:
                ids.append(-1)
                sizes.append(0)
                out.append(np.array([sums.sum(), (sums > 0).sum()], "<i8").tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([now[1]] * len(ids), pa.int32()),
                                   pa.array([now[0]] * len(ids), pa.int32()), pa.array(sizes, pa.int32()),
                                   pa.array(out, pa.binary())], names=["batch", "ngram", "shard", "n", "counts"])

        for batch in rows:
            for row in rows_of(batch):
                if (row["shard"], row["ngram"]) != now:
                    if group:
                        yield from reply()
                    now, group = (row["shard"], row["ngram"]), []
                group.append(row)
        if group:
            yield from reply()

    asked = batches.mapInArrow(ask, "shard int, ngram int, batch long, n int, hashes binary, own binary")
    return (asked.repartition(parts, "shard").sortWithinPartitions("shard", "ngram")
            .mapInArrow(total, "batch long, ngram int, shard int, n int, counts binary"))


def with_counts(batches: DataFrame, counts: DataFrame) -> DataFrame:
    """Each batch with the totals of its keys in the order of its keys."""
    per = (counts.where("batch >= 0").groupBy("batch")
           .agg(F.sort_array(F.collect_list(F.struct("ngram", "shard", "n", "counts"))).alias("totals")))
    return batches.join(per, "batch")


def token_counts(row) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's keys and, per token, c(h, w), c(h) and c(w)."""
    k = Keys(row)
    got = {1: [], 2: []}
    for t in row["totals"]:
        raw = pa.decompress(t["counts"], decompressed_size=size_of(t["counts"]), codec="zstd", asbytes=True)
        got[t["ngram"]].append(unpack_counts(raw, t["n"]))
    uni, bi = np.concatenate(got[1]), np.concatenate(got[2])
    return k, bi[k.of_pair], uni[k.of_context], uni[k.of_word]


def size_of(frame: bytes) -> int:
    """Content size from a zstd frame header."""
    import zstandard

    return zstandard.frame_content_size(frame)


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(c + 1.0).astype(np.int64), BUCKETS - 1)


def steps(p: np.ndarray) -> np.ndarray:
    """A probability on the logarithmic grid; -1 for zero."""
    out = np.full(len(p), -1, np.int64)
    some = p > 0
    out[some] = np.rint(-GRID * np.log2(p[some])).astype(np.int64)
    return out


def deleted_histogram(joined: DataFrame, n: int) -> DataFrame:
    """Training tokens by context bucket and by the grid steps of their deleted
    bigram and unigram shares: a bounded number of cells."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in rows_of(batch):
                k, c12, c1, c2 = token_counts(row)
                on = k.token_learns
                if not on.any():
                    continue
                c12, c1, c2 = c12[on] - 1, c1[on] - 1, c2[on] - 1
                p2 = steps(c12 / np.maximum(c1, 1))
                p1 = steps(c2 / max(1, n - 1))
                cell, count = np.unique((bucket_of(c1) << 32) | ((p2 + 1) << 16) | (p1 + 1), return_counts=True)
                yield pa.record_batch([pa.array(cell), pa.array(count)], names=["cell", "n"])

    return joined.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, n: np.ndarray, vocab: int, rounds: int = 200) -> np.ndarray:
    """EM over the histogram: weights (bigram, unigram, uniform) of each bucket.
    A bucket without tokens takes those of the nearest lower bucket."""
    bucket = cells >> 32
    p2, p1 = ((cells >> s & 0xFFFF) - 1 for s in (16, 0))
    p = np.stack([np.where(x >= 0, np.exp2(-x / GRID), 0.0) for x in (p2, p1)] +
                 [np.full(len(cells), 1 / (vocab + 1))], axis=1)
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(1))[:, None]
        mass = np.stack([np.bincount(bucket, part[:, j], BUCKETS) for j in range(3)], axis=1)
        seen = mass.sum(1) > 0
        new = weights.copy()
        new[seen] = mass[seen] / mass[seen].sum(1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    weights = np.maximum(weights, 1e-6)                 # nothing is impossible
    weights[0, 0] = 0.0                                 # an unseen context predicts nothing
    weights /= weights.sum(1, keepdims=True)
    seen = np.bincount(bucket, n, BUCKETS) > 0
    for b in range(2, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    return weights


def scores(joined: DataFrame, weights: np.ndarray, n: int, vocab: int) -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` of every document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in rows_of(batch):
                k, c12, c1, c2 = token_counts(row)
                w = weights[bucket_of(c1)]
                p = w[:, 0] * (c12 / np.maximum(c1, 1)) + w[:, 1] * (c2 / max(1, n)) + w[:, 2] / (vocab + 1)
                base = np.log10((c2 + 0.5) / (n + 0.5 * (vocab + 1)))
                start = k.first[:-1]
                cols = [np.diff(k.first), W.per_doc(c2 > 0, k.first),
                        np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)]
                yield pa.record_batch([pa.array(k.ids, mask=~k.known), *map(pa.array, cols)],
                                      names=["id", "n_tokens", "n_known", "base_score", "score"])

    return joined.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of the rows where the column ``learn`` is
    true: ``(id, n_tokens, n_known, train_tokens, base_score, score)``."""
    src = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"), learn.alias("learn"))
    batches = saved(packed(src), "lm-batches")
    counts = saved(corpus_counts(batches), "lm-counts")
    sums = [np.frombuffer(r.counts, "<i8") for r in counts.where("batch < 0").select("counts").collect()]  # one a shard
    n, vocab = (int(sum(s[i] for s in sums)) for i in (0, 1))
    joined = saved(with_counts(batches, counts), "lm-joined")
    cells = deleted_histogram(joined, n).toArrow()
    weights = learn_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy().astype(float), vocab)
    return scores(joined, weights, n, vocab).withColumn("train_tokens", F.lit(n).cast("long"))


def op10_frame(docs: DataFrame) -> DataFrame:
    out = score_documents(docs, fold(F.col("doc_id")) != 1)
    return out.select(F.col("id").alias("doc_id"),
                      F.coalesce(fold(F.col("id")) == 1, F.lit(False)).alias("held_out"),
                      "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_interpolated_lm(spark, sf_dir):
    return op10_frame(read(spark, sf_dir, "documents"))
