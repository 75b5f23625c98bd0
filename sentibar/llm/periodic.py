"""Periodic run detection with a dictionary of basic factors (operator 13).

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical), at least ``max(min_length, 2 * q)`` words long, that no
neighbouring word extends.  The dictionary names, for every power of two
``L``, the word sequences of length ``L`` that occur again in their document:
the name of a sequence is the rank of the pair of names of its halves, so
names are exact and no hash decides anything.  A run of period ``L <= q < 2L``
repeats the sequence at its start ``q`` words later, so per ``L`` the successor
occurrences within ``2L`` words propose every period; equally spaced successors
at most ``L / 2`` apart form one arithmetic progression, of which the first
element stands for all.  Proposals that follow each other are one; each is
extended to both sides by descending the dictionary, and of equal stretches
the smallest period stays.

Documents never meet: the work is one Arrow pass in slices of about 1 MB (or
one document), without a shuffle.  Sequences that do not occur again leave the
dictionary, so plain prose costs about three sorts of its words.

Defined cases: a null or empty text has no word and no run, and collapses to
the empty text; repeated rows give repeated results; ids may be null; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import pick, read

RUNS = "array<struct<start:long,length:long,period:long>>"


def again(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` whose key occurs again, by (key, position), and dense
    names of their keys from 1.  ``at`` ascends."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    same = keys[1:] == keys[:-1]
    repeated = np.zeros(len(keys), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    keys, at = keys[repeated], at[repeated]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return at, np.cumsum(first)


def basic_factors(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per power of two, up to the longest sequence that occurs twice: the
    positions by (name, position), their names, and the name at every position
    (0: the sequence there does not occur again)."""
    n, size, levels = len(symbols), 1, []
    pos, name = again(symbols, np.arange(n))
    while len(pos):
        full = np.zeros(n, dtype=np.int64)
        full[pos] = name
        levels.append((pos, name, full))
        left = np.flatnonzero((full[:max(n - size, 0)] > 0) & (full[size:] > 0))
        pos, name = again(full[left] * (n + 1) + full[left + size], left)
        size *= 2
    return levels


def proposals(pos: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods (``size`` to ``2 * size - 1``) at which the
    sequence of ``size`` words occurs again."""
    m = len(pos)
    gap = np.full(m, np.iinfo(np.int64).max // 2)  # to the successor, if there is one
    linked = name[1:] == name[:-1]
    gap[:-1][linked] = np.diff(pos)[linked]
    # the last entry of the progression that goes on from each entry with its gap
    cut = np.ones(m, dtype=bool)
    cut[:-1] = gap[1:] != gap[:-1]
    ends = np.flatnonzero(cut)
    last = ends[np.searchsorted(ends, np.arange(m))] + 1
    begin = np.flatnonzero(gap < 2 * size)
    at, out = begin, []
    while len(begin):
        step = gap[at]
        near = pos[begin] + 2 * size > pos[at] + step
        begin, at, step = begin[near], at[near], step[near]
        period = pos[at] + step - pos[begin]
        fit = period >= size
        out.append((pos[begin[fit]], period[fit]))
        at = np.where(step <= size // 2, last[at], at + 1)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def find_runs(symbols: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    levels = basic_factors(symbols)
    found = [proposals(pos, name, 1 << k) for k, (pos, name, _) in enumerate(levels)]
    if not sum(len(i) for i, _ in found):
        return np.zeros((0, 3), np.int64)
    i, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((i, p))
    i, p = i[order], p[order]
    head = np.ones(len(i), dtype=bool)
    head[1:] = (p[1:] != p[:-1]) | (i[1:] > i[:-1] + 1)
    i, p = i[head], p[head]
    left, right = i.copy(), i + p
    for k in reversed(range(len(levels))):
        names, size = levels[k][2], 1 << k
        ok = right + size <= len(symbols)
        a, b = names[(right - p)[ok]], names[right[ok]]
        ok[ok] = (a > 0) & (a == b)
        right[ok] += size
        ok = left >= size
        a, b = names[left[ok] - size], names[(left + p)[ok] - size]
        ok[ok] = (a > 0) & (a == b)
        left[ok] -= size
    length = right - left
    keep = length >= np.maximum(min_length, 2 * p)
    rows = np.stack([left[keep], length[keep], p[keep]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[bytes], min_length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of all texts (starts count from each text), how many precede each
    text (one entry more than texts), and the texts without repeated periods."""
    cut = [t.split() for t in texts]
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in cut for w in ws], dtype=np.int64)
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(ws) for ws in cut], out=first[1:])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    runs = find_runs(doc * max(len(known), 1) + ids, min_length)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(change, runs[:, 0] + runs[:, 1], 1)
    kept = np.cumsum(change)[:-1] == 0
    whole = W.per_doc(~kept, first) == 0
    plain = [b" ".join(ws if whole[d] else [ws[j] for j in np.flatnonzero(kept[first[d]:first[d + 1]])])
             for d, ws in enumerate(cut)]
    offsets = np.searchsorted(runs[:, 0], first)
    runs[:, 0] -= np.repeat(first[:-1], np.diff(offsets))
    return runs, offsets, plain


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = 12) -> DataFrame:
    """``(id, runs, collapsed)``: the runs by start, then period, and
    the words that no run contains after its first period, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            for lo, hi, part, cut in W.slices(data, at):
                raw = part.tobytes()
                texts = [raw[cut[j]:cut[j + 1]] for j in range(hi - lo)]
                runs, offsets, plain = runs_of_texts(texts, min_length)
                items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T],
                                                   names=["start", "length", "period"])
                yield pa.record_batch(
                    [batch.column("id").slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
                     pa.array(plain, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    src = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`periodic_runs`; the longest run is the one
    of the smallest start, then period, among equally long ones."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listing = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.withColumn("top", longest.cast("struct<length:long,start:long,period:long>"))
    return top.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_cycles(docs: DataFrame) -> DataFrame:
    """The query's input: in one document of ten, by the crc32 of its id, all
    words from one place on cycle.  Documents without an id or word stay."""
    return (docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
            .selectExpr("doc_id", "text", "h div 10 AS g", r"""
                CASE WHEN h % 10 = 0 THEN filter(split(text, '[ \\x09-\\x0D]+'), w -> w != '') END AS ws""")
            .selectExpr("*", "coalesce(size(ws), 0) AS n")
            .selectExpr("*", "CASE WHEN n > 0 THEN g % n END AS a")
            .selectExpr("*", "1 + (n - a) div (3 + g % 8) AS p")
            .selectExpr("doc_id", """
                CASE WHEN n > 0 THEN array_join(transform(ws, (w, i) ->
                    CASE WHEN i < a THEN w ELSE ws[int(a + (i - a) % p)] END), ' ')
                ELSE text END AS text"""))


def op13_periodic_runs(spark, sf_dir):
    return run_digests(periodic_runs(with_cycles(read(spark, sf_dir, "documents").select("doc_id", "text"))))
