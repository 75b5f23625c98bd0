"""Ranked lexical search by NRA, no random access (operator 12).

Every item of a query table ranks all documents by a sum of term impacts.  One
pass turns each document into its term count and the occurrences of query
terms; from these rows come the collection's counts.  A second pass over the
rows builds, for each shard of documents (up to ``SHARD`` postings of one
Arrow batch), posting lists sorted by falling impact, and answers each item by
sequential reads alone: all its lists are read to the same, doubling depth.  A
document's score lies between the impacts read so far and those plus the next
unread impact of every list in which it has not been seen.  Documents whose
upper end falls below the k-th best lower end leave; reading goes on until the
two ends meet for all that are left, so membership, ties and scores are final.
The shards' best k are merged by a ranked window, whose group limit runs below
the exchange.  A hot term or document never meets in one task: lists are cut
by document.

Only query terms are broadcast.  Their bytes are summed first; beyond
``VOCABULARY_BYTES`` the items are dealt to groups, and each group's result is
written and its broadcast destroyed before the next group starts.

Defined cases: a null or empty text has no term, is not counted and never
returned; rows that repeat are documents of their own; query rows that share
an id (null included) are one item with the terms of all; null document ids
come last among equal scores; an item without terms, or an empty table, gives
no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import pick, read, saved

SHARD = 1 << 20
VOCABULARY_BYTES = 16 << 20
FIRST_DEPTH = 128

#: Letters to small letters, other ASCII but digits to the space; bytes of
#: longer characters stay.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(item, term)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            for j in range(batch.num_rows):
                own = sorted(set(terms(data[at[j]:at[j + 1]].tobytes())))
                yield pa.record_batch([pa.array(batch.column("id").slice(j, 1).to_pylist() * len(own),
                                                batch.column("id").type),
                                       pa.array(own, pa.binary())], names=["item", "term"])

    src = pick(items, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"item {kind}, term binary").distinct()


def occurrences(docs: DataFrame, vocabulary) -> DataFrame:
    """``(id, n, term, tf)``: per document the number of its terms, and the
    numbers and counts of those that the broadcast vocabulary holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}.get
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            for lo, hi, part, cut in W.slices(data, at):
                raw, n, size, term, tf = part.tobytes(), [], [0], [], []
                for j in range(hi - lo):
                    own = terms(raw[cut[j]:cut[j + 1]])
                    found = Counter(map(number, own))
                    found.pop(None, None)
                    n.append(len(own))
                    term.extend(found.keys())
                    tf.extend(found.values())
                    size.append(len(term))
                size = pa.array(size, pa.int32())
                yield pa.record_batch(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(size, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(size, pa.array(tf, pa.int64()))],
                    names=["id", "n", "term", "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, term array<int>, tf array<long>")


class Shard:
    """Impact-sorted posting lists of some documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.size = doc[order], impact[order], size
        self.term, self.start = np.unique(term[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def search(self, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that can be among the best ``k``: all of those,
        and those that tie with the last.  ``wanted`` are term numbers."""
        at = np.searchsorted(self.term, wanted)
        at = at[np.isin(wanted, self.term)]
        lo, hi = self.start[at], self.end[at]
        lower = np.zeros(self.size, dtype=np.int64)
        open_ = np.ones(self.size, dtype=bool)
        depth, had = FIRST_DEPTH, lo
        read_doc, read_list = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            upto = np.minimum(lo + depth, hi)
            block = ranges(had, upto)
            owner = np.repeat(np.arange(len(lo)), upto - had)
            doc = self.doc[block]
            live = open_[doc]
            block, owner, doc = block[live], owner[live], doc[live]
            np.add.at(lower, doc, self.impact[block])
            read_doc, read_list = np.append(read_doc, doc), np.append(read_list, owner)
            had, depth = upto, depth * 4
            # what an unread entry of each list can be at most
            bound = np.where(had < hi, self.impact[np.minimum(had, hi - 1)], 0)
            slack = np.full(self.size, bound.sum())
            np.subtract.at(slack, read_doc, bound[read_list])
            floor = max(int(np.partition(lower, -k)[-k]), 1) if self.size >= k else 1
            open_ &= lower + slack >= floor
            left = np.flatnonzero(open_)
            if not slack[left].any():
                return left, lower[left]
            live = open_[read_doc]
            read_doc, read_list = read_doc[live], read_list[live]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All of ``start[i] .. end[i] - 1``, one after the other."""
    count = end - start
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def best_of_shards(rows: DataFrame, query, item_type: str, total: int, length: int, k: int,
                   shard: int) -> DataFrame:
    """``(item, id, score)``: each shard's best ``k`` documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wanted, weight = query.value
        for batch in batches:
            at = np.append(0, np.cumsum(pc.list_value_length(batch.column("term")).to_numpy()))
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
            n = batch.column("n").to_numpy()
            for lo, hi, own, cut in W.slices(term, at, shard):
                many = tf[at[lo]:at[hi]]
                doc = np.repeat(np.arange(hi - lo), np.diff(cut))
                m = 10 + (90 * n[lo:hi] * total) // length
                impact = weight[own] * ((1_000_000_000 * many) // (1000 * many + 8 * m[doc]))
                use = impact > 0
                lists = Shard(doc[use], own[use], impact[use], hi - lo)
                item, place, score = [], [], []
                for j, numbers in enumerate(wanted):
                    found, value = lists.search(numbers, k)
                    # all that tie with the last stay: the ids decide in the merge
                    if len(found) > k:
                        keep = value >= np.partition(value, -k)[-k]
                        found, value = found[keep], value[keep]
                    item.append(np.full(len(found), j))
                    place.append(found)
                    score.append(value)
                place = pa.array(np.concatenate(place) if place else [], pa.int64())
                yield pa.record_batch(
                    [keys.take(pa.array(np.concatenate(item) if item else [], pa.int64())),
                     batch.column("id").slice(lo, hi - lo).take(place),
                     pa.array(np.concatenate(score) if score else [], pa.int64())],
                    names=["item", "id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item {item_type}, id {kind}, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  vocabulary_bytes: int = VOCABULARY_BYTES, shard: int = SHARD) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    src = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    wanted = saved(item_terms(items, item_col, item_text), "ranked-items")
    item_type = wanted.schema["item"].dataType.simpleString()
    size = wanted.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    groups = -(-size // vocabulary_bytes)
    results = None
    for g in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).toArrow()
        if not own.num_rows:
            continue
        part = saved(best(one_group(spark, src, own, item_type, k, shard), k), "ranked-best")
        results = part if results is None else results.unionByName(part)
    if results is None:
        kind = src.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"item {item_type}, rank int, id {kind}, score long")
    return results.select("item", "rank", "id", "score")


def one_group(spark, src: DataFrame, own: pa.Table, item_type: str, k: int, shard: int) -> DataFrame:
    sc = spark.sparkContext
    vocabulary = sorted(set(own.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(vocabulary)}
    lists: dict = {}
    for item, term in zip(own.column("item").to_pylist(), own.column("term").to_pylist()):
        lists.setdefault(item, []).append(number[term])
    shared = sc.broadcast(vocabulary)
    rows = saved(occurrences(src, shared), "ranked-rows")
    total, length = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    counts = rows.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()
    df[counts.column("term").to_numpy()] = counts.column("count").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()],
                      dtype=np.int64)
    query = sc.broadcast((pa.array(lists, own.schema.field("item").type),
                          [np.array(sorted(v), dtype=np.int64) for v in lists.values()], weight))
    out = saved(best_of_shards(rows, query, item_type, total or 0, max(length or 0, 1), k, shard), "ranked-shards")
    shared.destroy()
    query.destroy()
    return out


def op12_lexical_search(spark, sf_dir):
    found = ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL = r"""
WITH items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
whole AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs),
seen AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM items)
  GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM seen, whole GROUP BY term, n_docs),
parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM seen JOIN weights USING (term), whole),
scores AS (
  SELECT item_id, r, doc_id, sum(part)::BIGINT AS score
  FROM items JOIN parts USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
