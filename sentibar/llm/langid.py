"""Language identification by prediction by partial matching (operator 8).

Per language, a byte context tree of order ``ORDER`` = 2: every context of
zero to two bytes with the counts of the bytes that follow it.  A byte's
probability is its share in the longest seen context; an unseen byte costs
that context's escape (method C: as many escapes as distinct followers) and
goes on in the next shorter one, at last to 1/256.  Statistics are frozen
after training, so a text's code length is a sum of table entries, and the
language with the shortest code wins.

Counts cover all training documents: a task counts its grams with sorted
arrays and one shuffle adds them up.  A model has at most 2**24 grams a
language (all three-byte strings); where the tables of all languages pass
``MODEL_BYTES``, texts are scored by one group of languages after the other.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is every text if nothing could be learned; equal code lengths go to the
alphabetically first language; a null id is not learned from and not held
out; repeated rows count and score each time; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import pick, read, saved

ORDER = 2
START = 10                      # texts are taken to follow two newlines
MODEL_BYTES = 256 << 20        # code-length tables that are broadcast at a time
HELD = 8 << 20                  # distinct grams held by a task before it writes them

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def history(data: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries one and two places before each byte; ``start`` before a text."""
    one, two = np.empty_like(data), np.empty_like(data)
    one[1:], two[2:] = data[:-1], data[:-2]
    full = at[:-1][np.diff(at) > 0]
    long = at[:-1][np.diff(at) > 1]
    one[full] = start
    two[full] = start
    two[long + 1] = start
    return one, two


def gram_counts(docs: DataFrame) -> DataFrame:
    """``docs(lang, text)`` -> ``(lang, gram, n)`` of three-byte grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (gram, n) in total.items():
                for lo in range(0, len(gram), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.record_batch([pa.array([lang] * len(gram[part])), pa.array(gram[part].astype(np.int64)),
                                           pa.array(n[part])], names=["lang", "gram", "n"])
            total.clear()

        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            code = batch.column("lang").dictionary_encode()
            names, which = code.dictionary.to_pylist(), code.indices.to_numpy()
            for lo, hi, part, off in W.slices(data, at):
                one, two = history(part, off, START)
                gram = (two.astype(np.uint32) << 16) | (one.astype(np.uint32) << 8) | part
                owner = np.repeat(which[lo:hi], np.diff(off))
                for lang in np.unique(which[lo:hi]):
                    g, n = np.unique(gram[owner == lang], return_counts=True)
                    old = total.get(names[lang])
                    if old is not None:
                        g = np.concatenate((old[0], g))
                        n = np.concatenate((old[1], n))
                        order = np.argsort(g, kind="stable")
                        g, n = g[order], n[order]
                        cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else []
                        g, n = (g[cut], np.add.reduceat(n, cut)) if len(g) else (g, n)
                    total[names[lang]] = (g, n)
            if sum(len(g) for g, _ in total.values()) > HELD:
                yield from flush()
        yield from flush()

    return (docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """Frozen code lengths: ``bits[lang][two before, one before, byte]`` over the
    classes of bytes seen in training and one class for all others."""

    def __init__(self, langs: list[str], seen: list[int], grams: pa.Table):
        self.langs = langs
        self.of_byte = np.full(256, len(seen), np.int32)
        self.of_byte[seen] = np.arange(len(seen))
        m = self.size = len(seen) + 1
        self.bits = np.empty((len(langs), m * m * m), np.float32)
        names = grams.column("lang").combine_chunks().dictionary_encode()
        which = names.indices.to_numpy()
        gram, count = grams.column("gram").to_numpy(), grams.column("n").to_numpy()
        for i, lang in enumerate(langs):
            own = which == names.dictionary.to_pylist().index(lang)
            g, n3 = gram[own], np.zeros((m, m, m))
            n3[self.of_byte[g >> 16], self.of_byte[g >> 8 & 255], self.of_byte[g & 255]] = count[own]
            p = np.full(m, 1 / 256)
            for n in (n3.sum((0, 1)), n3.sum(0), n3):
                p = self.blend(n, p)
            self.bits[i] = -np.log2(p).ravel()

    @staticmethod
    def blend(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Method C: counts ``n`` of followers (last axis) over a shorter context."""
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, kinds / whole, 1.0)
        return np.where(n > 0, n / whole, escape * shorter)

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text in each language: ``(texts, languages)``."""
        kind = self.of_byte[data]
        one, two = history(kind, at, self.of_byte[START])
        index = (two * self.size + one) * self.size + kind
        out = np.zeros((len(at) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(at) > 0)
        for i in range(len(self.langs) if len(full) else 0):
            out[full, i] = np.add.reduceat(self.bits[i][index], at[full], dtype=np.float64)
        return out


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = W.per_doc(ASCII_LETTER[data], at) > 0
    wide = W.per_doc(data >= 128, at) > 0
    for i in np.flatnonzero(wide & ~found):
        found[i] = any(c.isalpha() for c in data[at[i]:at[i + 1]].tobytes().decode())
    return found


@dataclass(frozen=True)
class Trained:
    """Stored counts of all languages.  Code-length tables are made from them for
    as many languages at a time as ``model_bytes`` hold."""

    counts: DataFrame
    langs: list[str]
    seen: list[int]
    model_bytes: int

    def groups(self) -> list[list[str]]:
        each = max(1, self.model_bytes // (4 * (len(self.seen) + 1) ** 3))
        return [self.langs[i:i + each] for i in range(0, len(self.langs), each)]

    def model(self, langs: list[str]) -> Model:
        """The tables of some languages (at most 2**24 grams each, as Arrow columns)."""
        return Model(langs, self.seen, self.counts.where(F.col("lang").isin(langs)).toArrow())


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", model_bytes: int = MODEL_BYTES) -> Trained:
    """Statistics of every row with a language."""
    rows = pick(docs, lang=lang_col, text=text_col).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = saved(gram_counts(rows), "lang-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    bytes_of = F.explode(F.expr("CAST(array(shiftright(gram, 16), shiftright(gram, 8) & 255, gram & 255) AS ARRAY<INT>)"))
    seen = sorted(r[0] for r in counts.select(bytes_of.alias("b")).distinct().collect())   # 256 at most
    return Trained(counts, langs, seen, model_bytes)


STATE = "id long, text string, known boolean, best double, lang string, mass double"


def predict(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)``; the score is the share of the winner among
    the languages' probabilities of the text.

    One pass for each group of languages carries a text's shortest code, its
    language, and the sum of all probabilities over the winner's.  Of several
    groups each pass is written and its broadcast destroyed before the next."""
    sc = docs.sparkSession.sparkContext
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    state = src.selectExpr("id", "text", "CAST(NULL AS BOOLEAN) AS known", "CAST('Infinity' AS DOUBLE) AS best",
                           "CAST(NULL AS STRING) AS lang", "0D AS mass")
    groups = trained.groups()
    for g, langs in enumerate(groups):
        sent = sc.broadcast(trained.model(langs))
        last = g == len(groups) - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            m = sent.value
            names = pa.array(m.langs)
            for batch in batches:
                col = batch.column("text")
                data, at = W.text_buffer(col)
                best, mass = batch.column("best").to_numpy(), batch.column("mass").to_numpy()
                for lo, hi, part, off in W.slices(data, at):
                    bits = m.code_lengths(part, off)
                    own, old = bits.min(1), best[lo:hi]
                    least = np.minimum(own, old)
                    total = np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
                    with np.errstate(invalid="ignore"):
                        before = np.where(np.isinf(old), 0, mass[lo:hi] * np.exp2(least - old))
                    wins = pa.array(own < old)
                    lang = pc.if_else(wins, names.take(pa.array(bits.argmin(1))),
                                      batch.column("lang").slice(lo, hi - lo))
                    text = pa.nulls(hi - lo, pa.string()) if last else col.slice(lo, hi - lo)
                    yield pa.record_batch([batch.column("id").slice(lo, hi - lo), text, pa.array(has_letter(part, off)),
                                           pa.array(least), lang, pa.array(total + before)],
                                          names=[c.split()[0] for c in STATE.split(", ")])

        state = state.mapInArrow(run, STATE)
        if len(groups) > 1:
            state = saved(state, "lang-pass")
            sent.destroy()
    found = F.col("known") & F.col("lang").isNotNull()
    return state.select("id", F.when(found, F.col("lang")).otherwise("und").alias("lang_pred"),
                        F.when(found, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def fold(col, n: int = 5):
    """crc32 of an id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def op8_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id")) != 0))
    return predict(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"),
        "lang_pred", "score")
