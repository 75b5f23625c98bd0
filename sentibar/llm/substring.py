"""Substring dedup with a count-min prefilter (operator 7).

A window is ``k`` consecutive words of one document.  A word goes if a window
that covers it also starts in a document with a smaller id, judged on the
input.

Pass 1 counts all windows in a count-min sketch with two rows.  A task writes
the buckets it touched, per chunk of 65536 buckets, as compressed sparse
counts; the chunks of all tasks are merged by one shuffle (about one byte a
window and row) to one bit a bucket: two or more windows.  A sketch only
overestimates, so a window without both bits occurs once.

Pass 2 tests each window against the bits (broadcast; their size is
``2 * 2**width / 8`` bytes with ``width <= MAX_WIDTH``).  Windows estimated
repeated are grouped exactly.  A task first groups its own: only the smallest
id of each window is a claim that must travel, everything above it is covered
already, so a window that a third of all documents share costs one row a task
and no group is hot.  Beyond ``MAX_WIDTH`` the sketch keeps its size and its
estimates grow: more windows reach the exact grouping, none is lost.

Windows are compared by a 64-bit hash of their word sequence.  Defined cases:
null and empty texts have no words; a row with a null id neither covers nor
loses anything; rows with equal ids do not cover each other; an empty table
gives an empty result; extra columns pass through the row-keeping form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import own_name, parts_for, pick, quoted, read, saved

U = np.uint64
CHUNK_BITS = 16
MIN_WIDTH, MAX_WIDTH = 20, 29     # log2 of the buckets of a sketch row
BYTES_PER_BUCKET = 4              # of text; about 1.5 windows to 2 buckets
DOC_BUCKET = 8 << 20              # bytes of text to a bucket of documents
FLUSH = 2 << 20                   # windows held by a task
ROW_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def windows(data: np.ndarray, at: np.ndarray, k: int):
    """Hash, document and first word of each window; the words themselves."""
    start, end, first = words = W.words(data, at)
    pos, doc = W.gram_docs(first, k)
    if not len(pos):
        return np.zeros(0, U), doc, pos, words
    return W.gram_hash(W.span_hash(data, start, end), k)[pos], doc, pos, words


def bucket(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return (h * U(ROW_FACTORS[row])) >> U(64 - width)


def sketch(src: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """``(row, chunk, bits)``: the buckets of two or more hashes, one bit each;
    only chunks with such a bucket.  ``hashes`` maps the bytes and offsets of
    some texts to the hashes to count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            for row in range(len(ROW_FACTORS)):
                b = np.sort(bucket(h, row, width))
                new = np.concatenate(([True], b[1:] != b[:-1]))
                many = np.diff(np.append(np.flatnonzero(new), len(b))) > 1
                b = b[new]
                chunk = (b >> U(CHUNK_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
                low = (b & U((1 << CHUNK_BITS) - 1)).astype(np.uint16)
                packed = []
                for x, y in zip(cut, np.append(cut[1:], len(b))):
                    # sorted offsets as gaps, and which of them were seen twice here
                    gaps = np.diff(low[x:y], prepend=np.uint16(0)).astype("<u2")
                    planes = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 2).T
                    packed.append(planes.tobytes() + np.packbits(many[x:y]).tobytes())
                sizes = (np.append(cut[1:], len(b)) - cut).astype(np.int32)
                yield pa.record_batch([
                    pa.array(np.full(len(cut), row, np.int32)), pa.array(chunk[cut]), pa.array(sizes),
                    pa.array([pa.compress(p, codec="zstd", asbytes=True) for p in packed], pa.binary())],
                    names=["row", "chunk", "n", "seen"])

        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            for _, _, part, off in W.slices(data, at):
                h = hashes(part, off)
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, twice = None, None, None

        def done():
            if key is not None and twice.any():
                yield pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                                       pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
                                      names=["row", "chunk", "bits"])

        for batch in batches:
            for row, chunk, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (row, chunk) != key:
                    yield from done()
                    key = (row, chunk)
                    seen, twice = (np.zeros(1 << CHUNK_BITS, bool) for _ in range(2))
                raw = np.frombuffer(pa.decompress(packed, decompressed_size=2 * n + -(-n // 8), codec="zstd"), np.uint8)
                gaps = raw[:n].astype(np.int64) + (raw[n:2 * n].astype(np.int64) << 8)
                low = np.cumsum(gaps)
                twice[low] |= seen[low] | np.unpackbits(raw[2 * n:], count=n).astype(bool)
                seen[low] = True
        yield from done()

    return (src.select("text").mapInArrow(count, "row int, chunk long, n int, seen binary")
            .repartition(parts_for(src), "row", "chunk").sortWithinPartitions("row", "chunk")
            .mapInArrow(merge, "row int, chunk long, bits binary"))


def repeated_bits(src: DataFrame, hashes, width: int) -> list[np.ndarray]:
    """The merged sketch as one bit array a row: ``2**width / 8`` bytes each."""
    size = 1 << max(0, CHUNK_BITS - 3)
    out = [np.zeros(max(1 << width, 1 << CHUNK_BITS) >> 3, np.uint8) for _ in ROW_FACTORS]
    for r in sketch(src, hashes, width).collect():      # at most as many bytes as the arrays
        out[r.row][r.chunk * size:(r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def estimated_repeated(h: np.ndarray, rows: list[np.ndarray], width: int) -> np.ndarray:
    """True where every sketch row estimates two or more."""
    keep = np.ones(len(h), bool)
    for row, have in enumerate(rows):
        b = bucket(h, row, width)
        keep &= (have[(b >> U(3)).astype(np.int64)] >> (b & U(7)).astype(np.uint8)) & 1 == 1
    return keep


def covered_windows(src: DataFrame, k: int, width: int, buckets: int) -> DataFrame:
    """``(bucket, ids, seen)``: packed pairs of a document and the hash of one of
    its windows that also starts in a document with a smaller id; several rows a
    bucket of documents (the id modulo ``buckets``)."""
    bits = src.sparkSession.sparkContext.broadcast(
        repeated_bits(src, lambda data, at: windows(data, at, k)[0], width))

    parts = parts_for(src)

    def pack(ids: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        """Covered windows as one row per bucket of documents."""
        bucket_of = np.mod(ids, buckets)
        order = np.lexsort((ids, bucket_of))
        ids, h, bucket_of = ids[order], h[order], bucket_of[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket_of[1:] != bucket_of[:-1])))
        spans = list(zip(cut, np.append(cut[1:], len(ids))))
        return pa.record_batch([
            pa.array(W.mix(bucket_of[cut].astype(U)).view(np.int64)), pa.array(bucket_of[cut]),
            pa.array([ids[x:y].tobytes() for x, y in spans], pa.binary()),
            pa.array([h[x:y].tobytes() for x, y in spans], pa.binary())], names=["h", "id", "ids", "seen"])

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = bits.value
        held, n = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            d = np.concatenate([x[1] for x in held])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
            own = first.copy()
            other = (d > least) & np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
            hs, ds = h[own], d[own]
            for lo in range(0, len(hs), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                none = pa.nulls(len(hs[part]), pa.binary())
                yield pa.record_batch([pa.array(hs[part].view(np.int64)), pa.array(ds[part]), none, none],
                                      names=["h", "id", "ids", "seen"])
            if other.any():
                yield pack(d[other], h[other])

        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for lo, hi, part, off in W.slices(data, at):
                h, doc, _, _ = windows(part, off, k)
                keep = estimated_repeated(h, rows, width)
                h, doc = h[keep], doc[keep]
                if len(h):
                    held.append((h, ids[lo:hi][doc]))
                    n += len(h)
                if n >= FLUSH // 2:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hash, then id: all but the first id are covered."""
        last, least, held, n = None, None, [], 0

        def flush():
            yield pack(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])).select(
                ["id", "ids", "seen"])

        for batch in batches:
            packed = batch.column("seen").is_valid().to_numpy(zero_copy_only=False)
            if packed.any():
                yield batch.filter(pa.array(packed)).select(["id", "ids", "seen"])
            h = batch.column("h").to_numpy()[~packed]
            d = batch.column("id").to_numpy()[~packed]
            if not len(h):
                continue
            first = np.concatenate(([h[0] != last], h[1:] != h[:-1]))
            at = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
            low = np.where(at >= 0, d[np.maximum(at, 0)], least if least is not None else 0)
            over = d > low
            if over.any():
                held.append((d[over], h[over].view(U)))
                n += int(over.sum())
            last, least = h[-1], low[-1]
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    claims = src.where("id IS NOT NULL").mapInArrow(claim, "h long, id long, ids binary, seen binary")
    return (claims.repartition(parts, "h").sortWithinPartitions("h", "id")
            .mapInArrow(settle, "id long, ids binary, seen binary")
            .select(F.col("id").alias("bucket"), "ids", "seen"))


def buckets_for(df: DataFrame, size: int) -> int:
    """A prime of four times the partitions or more, and of ``size`` bytes of
    text over ``DOC_BUCKET``: buckets stay small at any number of partitions, and
    ids in steps spread over all of them."""
    n = max(4 * parts_for(df), size // DOC_BUCKET) | 1
    while any(n % d == 0 for d in range(3, int(n ** 0.5) + 1, 2)):
        n += 2
    return n


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0


def width_for(size: int) -> int:
    """log2 of the sketch's buckets a row, from the bytes of all texts."""
    return min(MAX_WIDTH, max(MIN_WIDTH, int(np.ceil(np.log2(max(1, size / BYTES_PER_BUCKET))))))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13,
                 counts: bool = False) -> DataFrame:
    """``docs`` with the covered words taken out of ``text_col``: each goes with
    the white space after it, all other bytes stay.  ``counts`` appends
    ``n_words`` and ``n_removed``.

    Documents meet their covered windows in tasks sorted by bucket, windows
    first: a task holds the windows of one bucket, and documents stream past."""
    src = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    size = text_bytes(src)
    n = buckets_for(src, size)
    seen = covered_windows(src, k, width_for(size), n)
    at_id, at_text, width = docs.columns.index(id_col), docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType(list(docs.schema.fields))
    if counts:
        schema = schema.add("n_words", "long").add("n_removed", "long")
    key, of, had = (own_name(docs, x) for x in ("bucket", "ids", "seen"))
    at = quoted(id_col).cast("long")
    none = F.lit(None).cast("binary")
    rows = docs.where(at.isNotNull()).withColumns({key: F.pmod(at, F.lit(n)), of: none, had: none})
    windows_of = seen.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields],
                             F.col("bucket").alias(key), F.col("ids").alias(of), F.col("seen").alias(had))
    mixed = (rows.union(windows_of).repartition(parts_for(src), key)
             .sortWithinPartitions(quoted(key), quoted(of).isNull()))

    def cut(batch: pa.RecordBatch, ids: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents without the covered windows ``h`` of ``ids`` (sorted)."""
        data, off = W.text_buffer(batch.column(at_text))
        number = pc.cast(batch.column(at_id), pa.int64())
        valid = number.is_valid().to_numpy(zero_copy_only=False)
        number = number.fill_null(0).to_numpy()
        first, last = np.searchsorted(ids, number), np.searchsorted(ids, number, side="right")
        first[~valid] = last[~valid]
        for lo, hi, part, at in W.slices(data, off):
            old = batch.column(at_text).slice(lo, hi - lo)
            text, n_words, removed = _cut_slice(part, at, old, k, h, first[lo:hi], last[lo:hi])
            cols = [batch.column(j).slice(lo, hi - lo) for j in range(width)]
            cols[at_text] = text
            if counts:
                cols += [pa.array(n_words), pa.array(removed)]
            yield pa.record_batch(cols, names=schema.names)

    empty = np.zeros(0, np.int64), np.zeros(0, U)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, (ids, h) = None, [], empty
        for batch in batches:
            bucket_of = batch.column(width).to_numpy()
            is_doc = batch.column(width + 1).is_null().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((bucket_of[1:] != bucket_of[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for x, y in zip([0, *edge], [*edge, len(bucket_of)]):
                if x == y:
                    continue
                if bucket_of[x] != now:
                    now, held, (ids, h) = bucket_of[x], [], empty
                run = batch.slice(x, y - x)
                if not is_doc[x]:
                    held += zip(run.column(width + 1).to_pylist(), run.column(width + 2).to_pylist())
                    continue
                if held:
                    ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in held])
                    h = np.concatenate([np.frombuffer(w, U) for _, w in held])
                    held = []
                    order = np.lexsort((h, ids))
                    ids, h = ids[order], h[order]
                    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])))
                    ids, h = ids[new], h[new]
                yield from cut(run, ids, h)

    def unmet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch, *empty)

    # rows without an id have nothing to lose: they stay where they are
    return mixed.mapInArrow(meet, schema).union(docs.where(at.isNull()).mapInArrow(unmet, schema))


def _cut_slice(part: np.ndarray, at: np.ndarray, old: pa.Array, k: int, h: np.ndarray, first: np.ndarray,
               last: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without their covered words (``h[first:last]`` per document), words
    and removed words."""
    touched = np.flatnonzero(last > first)
    if not len(touched):
        n_words = np.diff(W.words(part, at)[2]).astype(np.int64)
        return old, n_words, np.zeros(len(at) - 1, np.int64)
    g, doc, pos, (start, _, begin) = windows(part, at, k)
    hit = np.zeros(len(g), bool)
    bound = np.searchsorted(doc, np.arange(len(at)))
    for i in touched:
        hit[bound[i]:bound[i + 1]] = np.isin(g[bound[i]:bound[i + 1]], h[first[i]:last[i]])
    gone = W.cover(pos[hit], k, len(start))
    removed = W.per_doc(gone, begin)
    # a word goes with the bytes up to the next word or the text's end
    word_doc = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    to = np.minimum(np.append(start[1:], len(part)), at[1:][word_doc])
    change = np.zeros(len(part) + 1, np.int32)
    np.add.at(change, start[gone], 1)
    np.subtract.at(change, to[gone], 1)
    stay = np.cumsum(change[:-1]) == 0
    end = np.concatenate(([0], np.cumsum(W.per_doc(stay, at))))
    raw = part[stay].tobytes()
    texts = [raw[x:y].decode() if r else o
             for x, y, r, o in zip(end[:-1], end[1:], removed, old.to_pylist())]
    return pa.array(texts, old.type), np.diff(begin).astype(np.int64), removed


def op7_frame(docs: DataFrame) -> DataFrame:
    cut = drop_repeats(docs.select("doc_id", "text"), counts=True)
    spaced = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")
    return cut.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.trim(F.coalesce(spaced, F.lit(""))).cast("binary"), 256).alias("kept_sha256"))


def op7_substring_dedup(spark, sf_dir):
    return op7_frame(read(spark, sf_dir, "documents"))


#: DuckDB twin of ``op7_substring_dedup``: windows as texts of their words.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS g FROM pos),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM hit),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
