"""Benchmark decontamination by greedy string tiling (operator 4).

Words are lower-cased and ASCII punctuation separates them.  Documents and
benchmark items meet on shared seeds of ``tile`` words.  A pair whose seeds
could cover enough of the item is tiled: the longest common run of unmarked
words is found with Karp-Rabin hashes, every non-overlapping occurrence of
that length is marked, and so on down to ``tile`` words.  Marked shares do
not care for order, so reordered passages are caught.  A document is
contaminated by an item if its tiles cover ``coverage`` of the item's words.

Items are a stated query set against all documents.  They are sent to the
tasks in groups of about ``GROUP_BYTES`` of text (each a checked broadcast),
one pass over the documents a group; of several groups each result is written
and its broadcast destroyed before the next is read.  Documents are never
shuffled.  Of several equally long matches the first in the item, then in the
document, is marked.

Defined cases: an item with fewer than ``tile`` words matches as a whole; an
item without words matches nothing; null texts have no words; items equal in
id and text count once; repeated documents give repeated rows; empty tables give an empty result; extra
columns are ignored (or pass through the row-keeping form).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import pick, read, saved

TILE = 5
COVERAGE = 0.6
GROUP_BYTES = 16 << 20
U = np.uint64

#: ASCII punctuation becomes a space; letters, digits and bytes beyond ASCII stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the index of each text's first word."""
    raw = [(t or "").lower().encode().translate(PLAIN) for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, first = W.words(data, at)
    return W.span_hash(data, start, end), first


class Items:
    """Seed index of a group of benchmark items."""

    def __init__(self, ids: list, texts: list[str], tile: int):
        self.ids, self.tile = ids, tile
        hashes, first = token_hashes(texts)
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        self.by_length = {}
        for size in sorted({min(tile, len(w)) for w in self.words} - {0}):
            seed, item, pos = [], [], []
            for i, w in enumerate(self.words):
                if min(tile, len(w)) == size:
                    g = W.gram_hash(w, size)
                    seed.append(g)
                    item.append(np.full(len(g), i))
                    pos.append(np.arange(len(g)))
            seed, item, pos = map(np.concatenate, (seed, item, pos))
            order = np.argsort(seed, kind="stable")
            seed, item, pos = seed[order], item[order], pos[order]
            cut = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
            bits = np.zeros(1 << 20, bool)
            bits[(seed & U(0xFFFFF)).astype(np.int64)] = True
            slot = np.cumsum(np.isin(np.arange(len(seed)), cut)) - 1
            own = np.unique(item * len(seed) + slot)
            who, start = np.unique(own // len(seed), return_index=True)
            seeds_of = dict(zip(who.tolist(), np.split(own % len(seed), start[1:])))
            self.by_length[size] = (seed[cut], np.append(cut, len(seed)), item, pos, bits, seeds_of)

    def hits(self, hashes: np.ndarray, first: np.ndarray):
        """Per seed length: (length, document, document position, seed number) of
        every document seed that some item has, by document and position."""
        for size, (seed, _, _, _, bits, _) in self.by_length.items():
            at, doc = W.gram_docs(first, size)
            if not len(at):
                continue
            g = W.gram_hash(hashes, size)[at]
            maybe = np.flatnonzero(bits[(g & U(0xFFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(seed, g[maybe]), len(seed) - 1)
            same = seed[slot] == g[maybe]
            if same.any():
                yield size, doc[maybe[same]], at[maybe[same]], slot[same]

    def entries(self, size: int, doc: np.ndarray, slot: np.ndarray):
        """(document, item, item position) of the distinct seeds that each
        document shares: a seed's repeats in the document do not multiply."""
        seed, cut, item, pos, _, _ = self.by_length[size]
        once = np.unique(doc * len(seed) + slot)
        doc, slot = once // len(seed), once % len(seed)
        size_of = cut[slot + 1] - cut[slot]
        each = np.repeat(np.arange(len(once)), size_of)
        entry = np.arange(len(each)) - (np.cumsum(size_of) - size_of)[each] + cut[slot][each]
        return doc[each], item[entry], pos[entry]


def seeds_cover(doc, item, pos, size: int):
    """Pairs (document, item) and how many item words their seeds cover: no
    tiling can cover more."""
    order = np.lexsort((pos, item, doc))
    doc, item, pos = doc[order], item[order], pos[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    step = np.full(len(pos), size, np.int64)
    later = np.flatnonzero(~new)
    step[later] = np.minimum(size, pos[later] - pos[later - 1])
    cut = np.flatnonzero(new)
    return doc[cut], item[cut], np.add.reduceat(step, cut)


def windows_of(hashes: np.ndarray, free: np.ndarray, length: int):
    """Starts and Karp-Rabin hashes of the runs of ``length`` unmarked words."""
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[length:] == taken[:-length]) if len(free) >= length else np.zeros(0, np.int64)
    n = len(hashes)
    prefix = np.zeros(n + 1, U)
    np.cumsum(hashes * W.powers(W.BASE, n), out=prefix[1:])
    return at, (prefix[at + length] - prefix[at]) * W.powers(W.BASE_INV, n + 1)[at]


def tiling(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length) of each tile.

    A common run of some length has one of every smaller length, so the longest
    is found by bisection; equal hashes are checked against the words."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles, high = [], min(len(item), len(doc))
    while high >= least:
        low, top = least - 1, high
        while low < top:
            mid = (low + top + 1) // 2
            if np.isin(windows_of(item, free_i, mid)[1], windows_of(doc, free_d, mid)[1]).any():
                low = mid
            else:
                top = mid - 1
        if low < least:
            break
        at_i, h_i = windows_of(item, free_i, low)
        at_d, h_d = windows_of(doc, free_d, low)
        shared = np.isin(h_d, h_i)
        places: dict[int, list[int]] = {}
        for a, h in zip(at_d[shared][::-1].tolist(), h_d[shared][::-1].tolist()):
            places.setdefault(h, []).append(a)
        marked = False
        for a, h in zip(at_i.tolist(), h_i.tolist()):
            if not free_i[a:a + low].all():
                continue
            spots = places.get(h, [])
            # a place that is taken stays taken: it leaves the list for good
            while spots and not free_d[spots[-1]:spots[-1] + low].all():
                spots.pop()
            for b in reversed(spots):
                if free_d[b:b + low].all() and (item[a:a + low] == doc[b:b + low]).all():
                    free_i[a:a + low] = free_d[b:b + low] = False
                    tiles.append((a, b, low))
                    marked = True
                    break
        high = low if marked else low - 1
    return tiles


def matched(items: Items, texts: list[str | None], coverage: float) -> list[tuple]:
    """(document index, item index, covered share, tiles, longest tile)."""
    hashes, first = token_hashes(texts)
    lengths = np.array([len(w) for w in items.words])
    out = []
    for size, doc, at, slot in items.hits(hashes, first):
        pair_doc, pair_item, bound = seeds_cover(*items.entries(size, doc, slot), size)
        enough = bound >= coverage * lengths[pair_item]
        for d, i in zip(pair_doc[enough].tolist(), pair_item[enough].tolist()):
            lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
            own = at[lo:hi][np.isin(slot[lo:hi], items.by_length[size][5][i])]
            # words outside every shared seed are in no tile: keep the rest, with gaps
            spots = np.unique(np.add.outer(own, np.arange(size)).ravel())
            part = hashes[spots]
            gap = np.flatnonzero(np.diff(spots) > 1) + 1
            part = np.insert(part, gap, W.mix(np.arange(1, len(gap) + 1, dtype=U)))
            tiles = tiling(items.words[i], part, size)
            share = sum(t[2] for t in tiles) / len(items.words[i])
            if share >= coverage:
                out.append((d, i, share, len(tiles), max(t[2] for t in tiles)))
    return out


def item_groups(bench: DataFrame, id_col: str, text_col: str, tile: int,
                group_bytes: int | None) -> tuple[int, Iterator[Items]]:
    """Number of groups of about ``group_bytes`` of text, and the items of each,
    read when it is their turn."""
    src = pick(bench, id=id_col, text=text_col).where("text IS NOT NULL")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / (group_bytes or GROUP_BYTES)))

    def groups() -> Iterator[Items]:
        for g in range(n):
            rows = src.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == g).distinct().collect()
            yield Items([r.id for r in rows], [r.text for r in rows], tile)

    return n, groups()


def contaminated_pairs(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", tile: int = TILE,
                       coverage: float = COVERAGE, group_bytes: int | None = None) -> DataFrame:
    """``(id, item, coverage, n_tiles, longest_tile)`` of every contaminated pair."""
    src = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    bench = bench.withColumn(item_col, F.col(item_col).cast("long"))
    sc = src.sparkSession.sparkContext
    out = None
    n, groups = item_groups(bench, item_col, item_text_col, tile, group_bytes)
    for group in groups:
        sent = sc.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                col, ids = batch.column("text"), batch.column("id")
                _, at = W.text_buffer(col)
                for lo, hi, _, _ in W.slices(at, at, 1 << 20):
                    found = matched(items, col.slice(lo, hi - lo).to_pylist(), coverage)
                    if found:
                        d, i, share, n, longest = map(list, zip(*found))
                        yield pa.record_batch([
                            ids.take(pa.array([lo + x for x in d])),
                            pa.array([items.ids[x] for x in i], pa.int64()), pa.array(share, pa.float64()),
                            pa.array(n, pa.int64()), pa.array(longest, pa.int64())],
                            names=["id", "item", "coverage", "n_tiles", "longest_tile"])

        part = src.mapInArrow(run, "id long, item long, coverage double, n_tiles long, longest_tile long")
        if n > 1:   # one group's items at a time: its result is written, then they go
            part = saved(part, "contaminated")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", tile: int = TILE, coverage: float = COVERAGE,
                      group_bytes: int | None = None) -> DataFrame:
    """``docs`` without the rows that an item contaminates, all columns as they were."""
    at_text = docs.columns.index(text_col)
    sc = docs.sparkSession.sparkContext
    n, groups = item_groups(bench, item_col, item_text_col, tile, group_bytes)
    for group in groups:
        sent = sc.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(at_text)
                clean = np.ones(len(col), bool)
                _, at = W.text_buffer(col)
                for lo, hi, _, _ in W.slices(at, at, 1 << 20):
                    for d, *_ in matched(sent.value, col.slice(lo, hi - lo).to_pylist(), coverage):
                        clean[lo + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = saved(docs, "decontaminated")
            sent.destroy()
    return docs


def op4_decontamination(spark, sf_dir):
    pairs = contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage",
                        "n_tiles", "longest_tile", F.lit(True).alias("contaminated"))
