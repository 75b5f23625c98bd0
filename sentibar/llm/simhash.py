"""SimHash near-duplicates by deletion-variant signatures (operator 2).

Fingerprint: over the XXH64 (seed 42) of every ``k``-word shingle, repeats
included, a bit is 1 if it is set in more than half of the hashes.

Linking at ``bits`` = 3: cut the 64 bits into two segments of 32.  Three
differing bits fall into two segments, so one segment differs in one bit at
most.  Each segment is indexed once per bit position with that bit wiped out;
two segments that differ in one bit at most share a variant.  Equal variants
meet by one shuffle, and only true distances link.

Only distinct fingerprints are indexed, so exact copies cost one entry.  A
variant shared by more than ``HOT`` fingerprints is not compared in one task:
its members are cut again, by the other segment's halves, then by bytes, each
again with at most one differing bit.  After the bytes at most 2**11
different fingerprints can share a key, so every group is bounded and no
pair is lost.  Inside a group a spanning forest is emitted, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import parts_for, pick, read, saved
from .components import components

HOT = 4096
U = np.uint64
LANES = U(0x0101010101010101)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of a lower-cased text; one for the whole
    sequence if it is shorter; none without words."""
    words = text.split()
    if len(words) < k:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=U)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per range of ``first``: the bits set in over half of its hashes.

    Eight bit positions are counted at once in the bytes of a word, over runs
    of at most 255 hashes so that no byte overflows."""
    size = np.diff(first)
    out = np.zeros(len(size), dtype=U)
    if not len(hashes):
        return out
    cuts = -(-size // 255)
    doc = np.repeat(np.arange(len(size)), cuts)
    nth = np.arange(len(doc)) - (np.cumsum(cuts) - cuts)[doc]
    block = first[:-1][doc] + 255 * nth
    begin = np.flatnonzero(nth == 0)
    full = size[doc[begin]]
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> U(shift)) & LANES, block)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        bits = (2 * count > full[:, None]).astype(np.uint8)
        out[doc[begin]] |= np.ascontiguousarray(bits).view(U).ravel() << U(shift)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = 3) -> DataFrame:
    """``(id, tie, fp)``: the fingerprint as the signed long with the same bits,
    and a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            for lo, hi, part, off in W.slices(data, at):
                raw = part.tobytes().lower()
                each = [shingle_hashes(raw[a:b], k) for a, b in zip(off[:-1], off[1:])]
                first = np.concatenate(([0], np.cumsum([len(h) for h in each])))
                fp = majority(np.concatenate(each), first)
                yield pa.record_batch([*[batch.column(c).slice(lo, hi - lo) for c in ("id", "tie")],
                                       pa.array(fp.view(np.int64))], names=["id", "tie", "fp"])

    src = pick(docs, id=id_col, text=text_col)
    src = src.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text")
    return src.mapInArrow(run, "id long, tie long, fp long")


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links ``fp`` entries at
    ``bits`` or fewer differing bits: each node is expanded once, against the
    nodes not yet reached."""
    rest, a, b = np.unique(fp), [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            u = todo.pop()
            near = np.bitwise_count(rest ^ u) <= bits
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), u))
                b.append(found)
                todo.extend(found)
                rest = rest[~near]
    none = np.zeros(0, U)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_in_groups(keyed: DataFrame, bits: int, hot: int) -> DataFrame:
    """``keyed(k1, k2, fp)`` -> rows ``(a, b, k1, k2)``: edges within each key
    group as (a, b, null, null), and the members of a group of more than
    ``hot`` as (fp, null, k1, k2).  A task streams its sorted rows and holds
    one bounded group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))
        flood = None  # key of a group already found to be hot

        def edges(a, b):
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                                    pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())],
                                   names=["a", "b", "k1", "k2"])

        def spill(k1, k2, fp):
            return pa.record_batch([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()),
                                    pa.array(k1), pa.array(k2)], names=["a", "b", "k1", "k2"])

        def work(k1, k2, fp):
            """All groups of these rows are whole."""
            new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(k1)))
            group = np.repeat(np.arange(len(start)), size)
            small = size <= 16
            keep = small[group] & (size[group] > 1)
            sf, sg = fp[keep], group[keep]
            for o in range(1, int(size[small].max(initial=1))):
                near = (sg[o:] == sg[:-o]) & (np.bitwise_count(sf[o:] ^ sf[:-o]) <= bits)
                if near.any():
                    yield edges(sf[:-o][near], sf[o:][near])
            for g in np.flatnonzero(~small):
                a, b = forest(fp[start[g]:start[g] + size[g]], bits)
                if len(a):
                    yield edges(a, b)

        for batch in batches:
            k1 = batch.column("k1").to_numpy()
            k2 = batch.column("k2").to_numpy()
            fp = batch.column("fp").to_numpy().view(U)
            if not len(k1):
                continue
            if flood is not None:
                same = (k1 == flood[0]) & (k2 == flood[1])
                if same.any():
                    yield spill(k1[same], k2[same], fp[same])
                    k1, k2, fp = k1[~same], k2[~same], fp[~same]
                if not len(k1):
                    continue
                flood = None
            k1, k2, fp = (np.concatenate(x) for x in zip(held, (k1, k2, fp)))
            new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(k1)))
            big = np.flatnonzero(size > hot)
            if len(big):
                over = np.repeat(size > hot, size)
                yield spill(k1[over], k2[over], fp[over])
                if big[-1] == len(size) - 1:
                    flood = (k1[-1], k2[-1])
                k1, k2, fp = k1[~over], k2[~over], fp[~over]
            last = 0 if flood is not None or not len(k1) else int(
                np.flatnonzero((k1 == k1[-1]) & (k2 == k2[-1]))[0])
            if flood is not None:
                last = len(k1)
            if last:
                yield from work(k1[:last], k2[:last], fp[:last])
            held = (k1[last:], k2[last:], fp[last:])
        if len(held[0]):
            yield from work(*held)

    n = parts_for(keyed)
    return (keyed.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2")
            .mapInArrow(run, "a long, b long, k1 long, k2 long"))


def near_edges(distinct_fp: DataFrame, bits: int = 3, hot: int = HOT) -> DataFrame:
    """``(fp)`` of distinct fingerprints -> ``(a, b)`` whose components are
    those of all pairs at ``bits`` or fewer differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wiped bit find at most 3 differing bits")
    fp, slot = F.col("fp"), F.col("slot")

    # slot 0..63: segment (slot >= 32: the high one) and wiped bit
    first = distinct_fp.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    seg = F.shiftrightunsigned(fp, 0).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    bit = F.expr("shiftleft(1L, slot % 32)")
    value = F.when(slot < 32, seg).otherwise(high).bitwiseAND(F.bitwise_not(bit))
    keyed = first.select(F.shiftleft(slot.cast("long"), 32).bitwiseOR(value).alias("k1"),
                         F.lit(0).cast("long").alias("k2"), "fp")
    found = saved(links_in_groups(keyed, bits, hot), "simhash-links")
    edges = [found.where("k1 is null").select("a", "b")]

    # hot groups: the other segment's two halves, one wiped bit of 16 each
    hot_rows = found.where("k1 is not null")
    if not hot_rows.isEmpty():
        low = F.expr("CASE WHEN shiftright(k1, 32) < 32 THEN 32 ELSE 0 END")
        cut = (hot_rows.select("k1", F.col("a").alias("fp"), low.alias("low"),
                               F.explode(F.sequence(F.lit(0), F.lit(31))).alias("slot"))
               .withColumn("from", F.expr("low + CASE WHEN slot < 16 THEN 0 ELSE 16 END"))
               .withColumn("value", F.expr("shiftrightunsigned(fp, CAST(from AS INT)) & 65535L & ~shiftleft(1L, slot % 16)")))
        keyed = cut.select("k1", F.expr("shiftleft(CAST(slot AS BIGINT), 16) | value").alias("k2"), "fp")
        found = saved(links_in_groups(keyed, bits, hot), "simhash-links")
        edges.append(found.where("k1 is null").select("a", "b"))

        # still hot: the remaining 16 bits by bytes; at most 2**11 members then
        hot_rows = found.where("k1 is not null")
        if not hot_rows.isEmpty():
            cut = (hot_rows.select("k1", F.col("k2").alias("up"), F.col("a").alias("fp"),
                                   F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot"))
                   .withColumn("low", F.expr("CASE WHEN shiftright(k1, 32) < 32 THEN 32 ELSE 0 END"
                                             " + CASE WHEN shiftright(up, 16) < 16 THEN 16 ELSE 0 END"))
                   .withColumn("from", F.expr("low + CASE WHEN slot < 8 THEN 0 ELSE 8 END"))
                   .withColumn("value", F.expr("shiftrightunsigned(fp, CAST(from AS INT)) & 255L & ~shiftleft(1L, slot % 8)")))
            keyed = cut.select("k1", F.expr("shiftleft(up, 12) | shiftleft(CAST(slot AS BIGINT), 8) | value").alias("k2"), "fp")
            edges.append(links_in_groups(keyed, bits, 1 << 30).where("k1 is null").select("a", "b"))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       k: int = 3, bits: int = 3) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``: ``component`` is the
    smallest id reachable over links of ``bits`` or fewer differing bits.

    Defined cases: null and empty texts have fingerprint zero and link to each
    other and to near-zero fingerprints; repeated rows give repeated result
    rows; a null id takes part but never names a component (null only if the
    whole component has no id); an empty table gives an empty result."""
    prints, roots = linked_prints(docs, id_col, text_col, k, bits)
    smallest = roots.groupBy("component").agg(F.min("least.id").alias("first_id"))
    of_fp = roots.join(smallest, "component").select("fp", "first_id")
    return prints.join(of_fp, "fp").select("id", "fp", F.col("first_id").alias("component"))


def linked_prints(docs: DataFrame, id_col: str, text_col: str, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and per distinct one ``(fp, least, component)``:
    its first row (by id, those without one last, then text hash) and the
    fingerprint that stands for its component."""
    prints = saved(fingerprints(docs, id_col, text_col, k), "simhash-fp")
    row = F.struct(F.col("id").isNull().alias("lone"), F.col("id"), F.col("tie"))
    least = prints.groupBy("fp").agg(F.min(row).alias("least"))
    linked = components(near_edges(least.select("fp"), bits))
    named = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, named.withColumn("component", F.coalesce("component", "fp"))


def simhash_keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     k: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest
    id, rows without an id last, and of rows that share it that of the smallest
    text hash; of rows equal in id and text any one.  Rows that share an id but
    belong to different groups do not touch each other."""
    from .common import own_name, quoted

    prints, roots = linked_prints(docs, id_col, text_col, k, bits)
    keep = roots.groupBy("component").agg(F.min("least").alias("least")).select("least.id", "least.tie")
    keep = saved(keep, "simhash-kept")
    i, t = own_name(docs, "kept_id"), own_name(docs, "kept_tie")
    side = keep.select(F.col("id").alias(i), F.col("tie").alias(t))
    rows = docs.join(side, quoted(id_col).cast("long").eqNullSafe(F.col(i))
                     & (F.xxhash64(quoted(text_col)) == F.col(t)), "left_semi")
    # rows equal in id and text, counted before anything is joined by text
    again = prints.groupBy("id", "tie").count().where("count > 1").select(F.col("id").alias(i), F.col("tie").alias(t)) \
        .join(keep, F.col(i).eqNullSafe(F.col("id")) & (F.col(t) == F.col("tie")), "left_semi")
    return rows if again.isEmpty() else rows.dropDuplicates([id_col, text_col])


def op2_frame(docs: DataFrame) -> DataFrame:
    return simhash_components(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def op2_simhash(spark, sf_dir):
    return op2_frame(read(spark, sf_dir, "documents"))
