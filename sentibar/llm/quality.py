"""Quality rules as a short-circuit cascade (operator 6).

A rule is a test on one statistic of a text.  The cascade rejects a document
at its first failing rule and does not evaluate the later ones, so the order
decides the cost and never the verdict.  The order comes from a sample: each
rule's cost per document and share of rejections are measured there, and
rules run by rejections per second, highest first.  The sample
(``SAMPLE_BYTES`` of ``SAMPLE_PARTS`` partitions) only orders rules; every document is judged on its
whole text.

Defined cases: a null or empty text has no words and is rejected (too few
words); rows with equal or null ids are judged each on their own; an empty
table gives an empty result; extra columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import pick, quoted

SAMPLE_BYTES, SAMPLE_PARTS = 1 << 18, 64   # texts of each of these input partitions order the rules
U = np.uint64

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class View:
    """The texts of some documents with statistics computed on first use.
    Every statistic has one entry per document."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1

    def take(self, keep: np.ndarray) -> "View":
        if keep.all():
            return self
        size = np.diff(self.at)
        return View(self.data[np.repeat(keep, size)],
                    np.concatenate(([0], np.cumsum(size[keep]))))

    @cached_property
    def words(self):
        return W.words(self.data, self.at)

    @cached_property
    def hashes(self) -> np.ndarray:
        start, end, _ = self.words
        return W.span_hash(self.data, start, end)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        inside = ~W.IS_SPACE[self.data] & ((self.data & 0xC0) != 0x80)
        return W.per_doc(inside, self.at)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return W.per_doc(SYMBOL[self.data], self.at)

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        """Words with an ASCII letter or a character beyond ASCII."""
        start, end, first = self.words
        total = np.concatenate(([0], np.cumsum(LETTER[self.data], dtype=np.int64)))
        return W.per_doc(total[end] > total[start], first)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those equal to an earlier line of the document)."""
        start, end = W.runs(self.data != 10, self.at)
        doc = np.searchsorted(self.at, start, side="right") - 1
        word_start = self.words[0]
        has = np.searchsorted(word_start, start) < np.searchsorted(word_start, end)
        key = W.mix(W.span_hash(self.data, start, end) + doc.astype(U) * U(W.BASE))[has]
        doc = doc[has]
        _, at = np.unique(key, return_index=True)
        count = np.bincount(doc, minlength=self.n)
        return count, count - np.bincount(doc[at], minlength=self.n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        first = self.words[2]
        pos, doc = W.gram_docs(first, 3)
        if not len(pos):
            return np.zeros(self.n, np.int64)
        key = W.mix(W.gram_hash(self.hashes, 3)[pos] + doc.astype(U) * U(W.BASE))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        return W.per_doc(W.cover(pos[count[back] > 1], 3, len(self.hashes)), first)

    @cached_property
    def top_word(self) -> np.ndarray:
        """Occurrences of each document's most frequent word."""
        first = self.words[2]
        doc = np.repeat(np.arange(self.n), np.diff(first))
        top = np.zeros(self.n, np.int64)
        if len(doc):
            key = W.mix(self.hashes + doc.astype(U) * U(W.BASE))
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            np.maximum.at(top, doc[at], count)
        return top


@dataclass(frozen=True)
class Rule:
    """``fails(view)`` is true for each document that the rule rejects."""

    name: str
    fails: Callable[[View], np.ndarray]


#: The two rules of the base verdict.
BASE_RULES = (
    Rule("few_words", lambda v: v.n_words < 50),
    Rule("repeated_windows", lambda v: 100 * v.n_repeat_words > 50 * v.n_words),
)
#: Further rules.  Limits are whole-number ratios, so SQL states them exactly.
MORE_RULES = (
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("short_words", lambda v: v.word_chars < 2 * v.n_words),
    Rule("long_words", lambda v: v.word_chars > 12 * v.n_words),
    Rule("few_letter_words", lambda v: 10 * v.n_letter_words < 8 * v.n_words),
    Rule("duplicate_lines", lambda v: 2 * v.n_dup_lines > v.n_lines),
    Rule("one_word", lambda v: 4 * v.top_word > v.n_words),
)


def cascade(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """Indices of the documents no rule rejects; a rejected document leaves the view."""
    alive = np.arange(view.n)
    for rule in rules:
        if not len(alive):
            break
        passed = ~rule.fails(view)
        alive, view = alive[passed], view.take(passed)
    return alive


def verdict(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    kept = np.zeros(view.n, dtype=bool)
    kept[cascade(view, rules)] = True
    return kept


def order_rules(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_bytes: int = SAMPLE_BYTES,
                sample_parts: int = SAMPLE_PARTS) -> tuple[Rule, ...]:
    """Rules by rejections per second on a sample: the first ``sample_bytes`` of
    texts (one document at least) of up to ``sample_parts`` input partitions,
    evenly over the table.  Only those partitions are opened, and reading stops
    when the sample is full.  Tasks time each rule on a fresh view, so a rule
    pays for the statistics that it needs; only sums reach the driver."""

    def timed(rows):
        texts, size = [], 0
        for (text,) in rows:
            texts.append(text)
            size += len(text or "") + 1
            if size >= sample_bytes:
                break
        cost, rejected = [0.0] * len(rules), [0] * len(rules)
        data, at = W.text_buffer(pa.array(texts, pa.string()))
        for _, _, part, off in W.slices(data, at):
            for i, rule in enumerate(rules):
                t0 = time.perf_counter()
                rejected[i] += int(rule.fails(View(part, off)).sum())
                cost[i] += time.perf_counter() - t0
        return [(cost, rejected)]

    # the one thing a DataFrame does not offer: a few partitions, and no more of them than is needed
    rows = docs.select(quoted(text_col)).rdd
    n = rows.getNumPartitions()
    some = sorted({i * n // min(n, sample_parts) for i in range(min(n, sample_parts))})
    sums = docs.sparkSession.sparkContext.runJob(rows, timed, some)
    cost, rejected = ([sum(part[j][i] for part in sums) for i in range(len(rules))] for j in (0, 1))
    rate = [(r + 0.5) / (c + 1e-9) for r, c in zip(rejected, cost)]
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate[i], rules[i].name)))


STATS_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
                " n_repeat_words long, base_failed boolean, kept boolean, n_lines long,"
                " n_letter_words long")
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base statistics, the base verdict and ``kept``.

    Base statistics are needed for every document, so only the further rules
    are cascaded here, over the documents that pass the base."""
    rules = order_rules(docs, text_col, MORE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            ids = batch.column("id")
            for lo, hi, part, off in W.slices(data, at):
                view = View(part, off)
                failed = (view.n_words < 50) | (100 * view.n_repeat_words > 50 * view.n_words)
                kept = np.zeros(view.n, dtype=bool)
                good = np.flatnonzero(~failed)
                kept[good[cascade(view.take(~failed), rules)]] = True
                stats = [np.asarray(getattr(view, s), dtype=np.int64) for s in STAT_NAMES]
                yield pa.record_batch([
                    ids.slice(lo, hi - lo), *map(pa.array, stats), pa.array(failed),
                    pa.array(kept), pa.array(view.n_lines.astype(np.int64)),
                    pa.array(view.n_letter_words.astype(np.int64))],
                    names=[c.split()[0] for c in STATS_SCHEMA.split(",")])

    src = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return src.mapInArrow(run, STATS_SCHEMA)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, all columns as they were.
    The whole rule set runs as one cascade; a rejected document costs no more."""
    rules = order_rules(docs, text_col, BASE_RULES + MORE_RULES)
    at_col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffer(batch.column(at_col))
            kept = [verdict(View(part, off), rules) for _, _, part, off in W.slices(data, at)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark, sf_dir):
    from .common import read

    return quality_report(read(spark, sf_dir, "documents"))


#: DuckDB twin of ``op6_quality_rules``: every statistic and rule stated again in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i,
    CASE WHEN lead(w, 2) OVER p IS NOT NULL THEN concat(w, chr(10), lead(w) OVER p, chr(10), lead(w, 2) OVER p) END AS g
  FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
trin AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS r FROM tri),
rep AS (SELECT doc_id, count(*) FILTER (r) AS n FROM (
    SELECT doc_id, bool_or(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r
    FROM trin) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM pos GROUP BY 1, 2) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(ln.n_lines, 0) AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
    coalesce(top.top, 0) AS top
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 10 * n_letter_words < 8 * n_words OR 2 * n_dup_lines > n_lines OR 4 * top > n_words) AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_letter_words AS BIGINT) AS n_letter_words
FROM b
"""
