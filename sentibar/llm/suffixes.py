"""Duplicate-string removal by external induced suffix sorting (operator 1).

Every byte goes that is covered by a ``span``-byte string which starts at
another place too, in the same document or another.

*Sample.*  As induced sorting samples suffixes that are minima among their
neighbours, a position is sampled if its 8-byte hash is the first minimum of
some ``gap`` consecutive string starts.  The sample of a string of ``span``
bytes depends on its own bytes only, so equal strings have a sampled position
at the same offset ``d < gap``, followed by at least ``key = span - gap + 1``
equal bytes.

*Discard.*  The name of a sampled suffix is the hash of its first ``key``
bytes.  Names that occur once cannot lead to a repeat; a merged count-min
sketch finds nearly all of them before anything is sent.

*Sort.*  What remains are suffix tuples: name, place, the ``gap - 1`` bytes to
the left and the ``span`` bytes to the right.  A task sends identical tuples
once, as their whole context is repeated.  Tuples are dealt out by name and
sorted by (name, right bytes) with Spark's external sorter: runs on disk,
merged through a priority queue, so a shard may be far larger than memory.

*Induce.*  Tuples stream in suffix order.  From neighbours come the common-
prefix values; then the order of the suffixes one byte further left is induced
by stably dealing each class out by its preceding byte, and their common-prefix
values are one more than the range minimum between the new neighbours.  After
``d`` steps a class neighbour with a common prefix of ``span - d`` right bytes
proves that the string starting ``d`` before the sample repeats.  Tuples that
can reach ``span`` with no neighbour leave the order.

A name with more than ``HOT`` tuples is not sorted in one task.  Such names are
found by pre-aggregated counts before anything is dealt out (there are at most
``tuples / HOT``); their tuples are spread over all tasks, and their strings
are counted by hash, pre-aggregated in each task.

Strings are compared byte by byte inside a name, by 64-bit hashes for names
and hot names.  Defined cases: null is the empty text; ids may be null or
repeat (places are told apart by id and text hash; equal rows repeat each
other); an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import parts_for, pick, read, saved
from .substring import MAX_WIDTH, MIN_WIDTH, estimated_repeated, repeated_bits

U = np.uint64
SPAN, GAP = 400, 300
CHUNK = 16384            # tuples induced at once
HOT = 1 << 13            # tuples of a name beyond which it is split
HOT_NAMES = 1 << 22      # most names sent to the tasks as hot; the limit above doubles until they fit

TUPLE = "name long, id long, th long, pos long, ahead binary, back binary, hot boolean"
FIELDS = ["name", "id", "th", "pos", "ahead", "back", "hot"]


def samples(data: np.ndarray, at: np.ndarray, span: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions and their documents."""
    n, none = len(data), np.zeros(0, np.int64)
    size = np.diff(at)
    if n < span or not (size >= span).any():
        return none, none
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = data
    gram = np.zeros(n, U)
    for o in range(8):
        gram |= wide[o:o + n].astype(U) << U(8 * o)
    rank = (W.mix(gram) & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    blocks = -(-n // gap)
    padded = np.full((blocks + 1) * gap, np.iinfo(np.uint64).max, U)
    padded[:n] = rank
    grid = padded.reshape(-1, gap)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[gap - 1:gap - 1 + n])
    doc = np.repeat(np.arange(len(size)), size)
    starts = np.arange(n) + span <= at[1:][doc]
    chosen = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))] if len(chosen) else none
    return chosen, doc[chosen]


def names_of(data: np.ndarray, at: np.ndarray, span: int, gap: int):
    """Sampled positions, documents and names; a sample too close to its text's
    end for a name is followed by no repeat."""
    pos, doc = samples(data, at, span, gap)
    room = at[1:][doc] - pos >= span - gap + 1
    pos, doc = pos[room], doc[room]
    return pos, doc, W.span_hash(data, pos, pos + span - gap + 1) if len(pos) else np.zeros(0, U)


def chunks_of(data: np.ndarray, at: np.ndarray):
    """Slices for sampling: whole documents; positions fit in 32 bits."""
    return W.slices(data, at, W.SLICE_BYTES)


def hot_names(src: DataFrame, bits, width: int, span: int, gap: int, hot: int) -> np.ndarray:
    """Names of more than ``hot`` samples, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, n = bits.value, [], 0

        def flush():
            name, count = np.unique(np.concatenate(held), return_counts=True)
            yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(count)], names=["name", "n"])

        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            for _, _, part, off in chunks_of(data, at):
                name = names_of(part, off, span, gap)[2]
                held.append(name[estimated_repeated(name, rows, width)])
                n += len(held[-1])
                if n >= 1 << 20:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    counts = (src.select("text").mapInArrow(run, "name long, n long").groupBy("name")
              .agg(F.sum("n").alias("n")).where(F.col("n") > hot))
    counts = saved(counts, "suffix-hot")
    while counts.where(F.col("n") > hot).count() > HOT_NAMES:
        hot *= 2
    names = counts.where(F.col("n") > hot).select("name").toArrow().column("name").to_numpy()
    return np.sort(names.astype(np.int64).view(U))


def suffix_tuples(src: DataFrame, bits, hot, width: int, span: int, gap: int) -> DataFrame:
    """``src(id, th, text)`` -> tuples of repeated names, and rows with a null
    name for byte ranges already known to repeat (pos to the end in ``ahead``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hot_now = bits.value, hot.value
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            ids, th = batch.column("id"), batch.column("th").to_numpy()
            for lo, hi, part, off in chunks_of(data, at):
                pos, doc, name = names_of(part, off, span, gap)
                keep = estimated_repeated(name, rows, width)
                pos, doc, name = pos[keep], doc[keep], name[keep]
                if not len(pos):
                    continue
                left = np.maximum(pos - (gap - 1), off[doc])
                right = np.minimum(pos + span, off[doc + 1])
                whole = W.mix(W.span_hash(part, left, right) + (pos - left).astype(U))
                order = np.argsort(whole, kind="stable")
                new = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
                count = np.diff(np.append(np.flatnonzero(new), len(order)))
                many = np.repeat(count > 1, count)
                known = order[many & (right - left >= span)[order]]
                first = order[new]
                own = ids.take(pa.array(lo + doc))
                raw = part.tobytes()
                for some in (first[i:i + 8192] for i in range(0, len(first), 8192)):
                    yield pa.record_batch([
                        pa.array(name[some].view(np.int64)), own.take(pa.array(some)), pa.array(th[lo + doc[some]]),
                        pa.array(pos[some] - off[doc[some]]),
                        pa.array([raw[a:b] for a, b in zip(pos[some].tolist(), right[some].tolist())], pa.binary()),
                        pa.array([raw[a:b][::-1] for a, b in zip(left[some].tolist(), pos[some].tolist())], pa.binary()),
                        pa.array(np.isin(name[some], hot_now))], names=FIELDS)
                if len(known):
                    ends = (right[known] - off[doc[known]]).astype("<i8")
                    yield pa.record_batch([
                        pa.nulls(len(known), pa.int64()), own.take(pa.array(known)), pa.array(th[lo + doc[known]]),
                        pa.array(left[known] - off[doc[known]]),
                        pa.array([e.tobytes() for e in ends], pa.binary()), pa.nulls(len(known), pa.binary()),
                        pa.array(np.zeros(len(known), bool))], names=FIELDS)

    return src.mapInArrow(run, TUPLE)


def matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as zero-padded rows, and their lengths."""
    col = col.fill_null(b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    out = np.zeros((len(col), width), np.uint8)
    fill = np.arange(width) < size[:, None]
    out[fill] = raw[off[0]:off[-1]]
    return out, size


def induce(name: np.ndarray, ahead: np.ndarray, room: np.ndarray, back: np.ndarray, before: np.ndarray,
           span: int) -> np.ndarray:
    """``found[i, d]``: the string that starts ``d`` bytes before sample ``i``
    repeats.  Rows come in suffix order: by name, then right bytes."""
    n, gap = len(name), back.shape[1] + 1
    found = np.zeros((n, gap), bool)
    if n < 2:
        return found
    # common prefix with the row before; -1 across names
    same = ahead[1:] == ahead[:-1]
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(same.all(1), ahead.shape[1], same.argmin(1))
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    lcp[1:][name[1:] != name[:-1]] = -1
    row = np.arange(n)
    for d in range(gap):
        best = np.maximum(lcp, np.append(lcp[1:], -1))      # a class starts at -1
        hit = best + d >= span
        found[row[hit], d] = True
        # who has a byte further left, and can still reach the span
        stay = (before[row] > d) & (best >= 0) & (best + before[row] >= span)
        at = np.flatnonzero(stay)
        if d + 1 == gap or len(at) < 2:
            break
        group = np.cumsum(lcp < 0)[at]
        byte = back[row[at], d]
        order = np.argsort((group << 8) | byte, kind="stable")
        at = at[order]
        cls = ((group << 8) | byte)[order]
        joined = np.flatnonzero(cls[1:] == cls[:-1]) + 1
        new = np.full(len(at), -1, np.int64)
        if len(joined):
            # least common prefix between the two rows' old places
            pairs = np.empty(2 * len(joined), np.int64)
            pairs[0::2], pairs[1::2] = at[joined - 1] + 1, at[joined] + 1
            low = np.append(lcp, 0)
            new[joined] = np.minimum.reduceat(low, pairs)[0::2]
        row, lcp = row[at], new
    return found


def ranges(found: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and start and end relative to the sample, of each covered byte range."""
    n, gap = found.shape
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, -(after - 1), span - first


def induced_places(tuples: DataFrame, span: int, gap: int, chunk: int, hot: int) -> DataFrame:
    """Covered byte ranges ``(id, th, lo, hi)``; a tuple of a hot name comes back
    whole, with its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "id", "th", "lo", "hi", "ahead", "back"]

        def places(ids, th, lo, hi):
            n = len(lo)
            return pa.record_batch([pa.nulls(n, pa.int64()), ids, pa.array(th), pa.array(lo), pa.array(hi),
                                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)

        def work(t: pa.Table):
            t = t.combine_chunks().to_batches()[0]
            ahead, room = matrix(t.column("ahead"), span)
            back, before = matrix(t.column("back"), gap - 1)
            found = induce(t.column("name").to_numpy(), ahead, room, back, before, span)
            row, lo, hi = ranges(found, span)
            if len(row):
                pos = t.column("pos").to_numpy()[row]
                yield places(t.column("id").take(pa.array(row)), t.column("th").to_numpy()[row], pos + lo, pos + hi)

        def spill(t: pa.Table):
            for b in t.to_batches():
                yield pa.record_batch([b.column("name"), b.column("id"), b.column("th"), b.column("pos"),
                                       pa.nulls(len(b), pa.int64()), b.column("ahead"), b.column("back")], names=names)

        held, size, flood = [], 0, None
        for batch in batches:
            known = batch.column("name").is_null()
            if known.true_count:
                done = batch.filter(known)
                yield places(done.column("id"), done.column("th").to_numpy(), done.column("pos").to_numpy(),
                             np.frombuffer(b"".join(done.column("ahead").to_pylist()), "<i8"))
                batch = batch.filter(pc.invert(known))
            is_hot = batch.column("hot")
            if is_hot.true_count:
                yield from spill(pa.Table.from_batches([batch.filter(is_hot)]))
                batch = batch.filter(pc.invert(is_hot))
            if flood is not None and len(batch):
                more = pc.equal(batch.column("name"), flood)
                yield from spill(pa.Table.from_batches([batch.filter(more)]))
                batch = batch.filter(pc.invert(more))
                if len(batch):
                    flood = None
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < chunk:
                continue
            t = pa.Table.from_batches(held)
            name = t.column("name").to_numpy()
            cut = int(np.searchsorted(name, name[-1]))      # the last name may go on
            if cut:
                yield from work(t.slice(0, cut))
                t = t.slice(cut)
            held, size = t.to_batches(), len(t)
            if size > hot:
                yield from spill(t)
                flood, held, size = t.column("name")[0].as_py(), [], 0
        if held:
            yield from work(pa.Table.from_batches(held))

    n = parts_for(tuples)
    spread = F.when(F.col("name").isNull() | F.col("hot"), F.xxhash64("id", "th", "pos")).otherwise(F.col("name"))
    return (tuples.repartition(n, spread).sortWithinPartitions("name", "ahead")
            .mapInArrow(run, "name long, id long, th long, lo long, hi long, ahead binary, back binary"))


def own_starts(text: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Per context (sample at column ``gap - 1``): least and most ``d`` for which
    the sample is the one of the string that starts ``d`` before it.  So a string
    is counted at one sample only, however many it holds."""
    n = text.shape[0]
    gram = np.zeros((n, 2 * gap - 1), U)
    for o in range(8):
        gram |= text[:, o:o + 2 * gap - 1].astype(U) << U(8 * o)
    rank = W.mix(gram.ravel()).reshape(gram.shape) >> U(32)
    own = rank[:, gap - 1:gap]
    left, right = rank[:, gap - 2::-1] > own if gap > 1 else np.zeros((n, 0), bool), rank[:, gap:] >= own
    # how far each side stays above the sample; a tie goes to the first place
    stop = np.ones((n, 1), bool)
    most = np.argmax(np.concatenate((~left, stop), axis=1), axis=1)
    return gap - 1 - np.argmax(np.concatenate((~right, stop), axis=1), axis=1), most


def hot_places(hot: DataFrame, span: int, gap: int) -> DataFrame:
    """Covered byte ranges of hot names: every string of their tuples is counted
    by hash, at its own sample.  A task settles what repeats among its own tuples
    and sends one claim a string; a claim that meets another is repeated."""

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                b = batch.slice(lo, 4096)
                back, before = matrix(b.column("back"), gap - 1)
                ahead, room = matrix(b.column("ahead"), span)
                width = gap - 1 + span
                text = np.concatenate((back[:, ::-1], ahead), axis=1).ravel()
                d = np.arange(gap)
                low, high = own_starts(text.reshape(-1, width), gap)
                ok = (d <= before[:, None]) & (span - d <= room[:, None]) & (d >= low[:, None]) & (d <= high[:, None])
                row, d = np.nonzero(ok)
                start = row * width + gap - 1 - d
                h = W.span_hash(text, start, start + span)
                order = np.argsort(h, kind="stable")
                new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
                count = np.diff(np.append(np.flatnonzero(new), len(order)))
                found = np.zeros((len(b), gap), bool)
                twice = order[np.repeat(count > 1, count)]
                found[row[twice], d[twice]] = True
                one = order[new]
                more = count > 1
                r, x, y = ranges(found, span)
                pos = b.column("lo").to_numpy()
                yield pa.record_batch([
                    pa.nulls(len(r), pa.int64()), b.column("id").take(pa.array(r)),
                    pa.array(b.column("th").to_numpy()[r]), pa.array(pos[r] + x), pa.array(pos[r] + y),
                    pa.array(np.zeros(len(r), bool))], names=["h", "id", "th", "lo", "hi", "many"])
                at = pos[row[one]] - d[one]
                yield pa.record_batch([
                    pa.array(h[one].view(np.int64)), b.column("id").take(pa.array(row[one])),
                    pa.array(b.column("th").to_numpy()[row[one]]), pa.array(at), pa.array(at + span),
                    pa.array(more)], names=["h", "id", "th", "lo", "hi", "many"])

    claims = saved(hot.select("id", "th", "lo", "ahead", "back")
                   .mapInArrow(claim, "h long, id long, th long, lo long, hi long, many boolean"), "suffix-claims")
    many = (claims.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    return (claims.where("h IS NULL").select("id", "th", "lo", "hi")
            .unionByName(claims.where("NOT many").join(many, "h").select("id", "th", "lo", "hi")))


def repeated_places(src: DataFrame, span: int = SPAN, gap: int = GAP, chunk: int = CHUNK,
                    hot: int = HOT) -> DataFrame:
    """``src(id, th, text)`` -> byte ranges ``(id, th, lo, hi)`` covered by repeats."""
    if not 1 <= gap <= span - 7:
        raise ValueError("a sample and its 8 bytes must lie inside the string: 1 <= gap <= span - 7")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MAX_WIDTH, max(MIN_WIDTH, int(np.ceil(np.log2(max(1, size / 24))))))

    def names(data, at):
        return np.concatenate([names_of(p, o, span, gap)[2] for _, _, p, o in chunks_of(data, at)] or
                              [np.zeros(0, U)])

    sc = src.sparkSession.sparkContext
    bits = sc.broadcast(repeated_bits(src, names, width))
    large = sc.broadcast(hot_names(src, bits, width, span, gap, hot))
    tuples = suffix_tuples(src, bits, large, width, span, gap)
    out = saved(induced_places(tuples, span, gap, chunk, 8 * hot), "suffix-places")
    places = out.where("name IS NULL").select("id", "th", "lo", "hi")
    large = out.where("name IS NOT NULL")
    return places if large.isEmpty() else places.unionByName(hot_places(large, span, gap))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                   gap: int = GAP, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)``: the removed byte ranges (pairs
    of longs, packed) and the bytes left, concatenated."""
    src = (pick(docs, id=id_col, text=text_col)
           .select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
           .withColumn("th", F.xxhash64("text")))
    places = repeated_places(src, span, gap, chunk, hot)
    # rows with equal id and text emit equal ranges: each is listed once
    per = places.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    per = per.withColumnsRenamed({"id": "pid", "th": "pth"})
    joined = src.join(per, F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffer(batch.column("text"))
            lists = batch.column("places")
            for lo, hi, part, off in W.slices(data, at):
                spans, kept = [], []
                for i in range(hi - lo):
                    raw = part[off[i]:off[i + 1]].tobytes()
                    cuts = merged(lists[lo + i].values) if lists[lo + i].is_valid else np.zeros((0, 2), np.int64)
                    spans.append(cuts.astype("<i8").tobytes())
                    edges = [0, *cuts.ravel().tolist(), len(raw)]
                    kept.append(b"".join([raw[a:b] for a, b in zip(edges[0::2], edges[1::2])]) if len(cuts) else raw)
                n_bytes = np.diff(off)
                yield pa.record_batch([
                    batch.column("id").slice(lo, hi - lo), pa.array(n_bytes),
                    pa.array(n_bytes - np.array([len(k) for k in kept], np.int64)),
                    pa.array(spans, pa.binary()), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.select("id", "text", "places").mapInArrow(
        cut, "id long, n_bytes long, n_removed long, spans binary, kept binary")


def merged(places: pa.StructArray) -> np.ndarray:
    """Ranges as maximal disjoint runs in order; touching ranges are one run."""
    lo, hi = (places.field(i).to_numpy() for i in (0, 1))
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    cut = np.flatnonzero(new)
    return np.stack((lo[cut], reach[np.append(cut[1:], len(lo)) - 1]), axis=1)


def op1_frame(docs: DataFrame, **options) -> DataFrame:
    out = remove_repeats(docs, **options)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                      (F.octet_length("spans") / 16).cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_dedup(spark, sf_dir):
    return op1_frame(read(spark, sf_dir, "documents"))
