"""Token ids in compressed files: adaptive context-mixing range coder (operator 5).

Documents are ordered by id over range partitions.  Each partition is written
as segments of about ``SEGMENT`` ids that hold whole documents; a segment is a
sequence of blocks of ``BLOCK`` ids, each coded from a fresh model, with its
own checksum.  Blocks do not depend on each other, so a task codes all blocks
of a segment side by side: one numpy step handles the next id of every block.

An id is coded in one range-coder step.  The order-2 and the order-1 context
each predict the id that followed there last; order 0 says how frequent the
order-2 id is.  "Order 2 is right / order 1 is right / neither" has
probabilities learned per order (by confidence, and by frequency grade) and
mixed in the logistic domain with weights adapted per block.  "Neither" leaves
its share to order 0: the class of the id by counts adapted per block, its place
in the class evenly.  A class holds the ids that are about as frequent in the
segment (within a factor of two); the segment begins with the class of every id,
and nothing else is shared by its blocks.  Models stand still for ``ROUND`` ids
of their block and then learn from all of them, so one numpy pass serves a round
of every block and only the interval moves id by id.  All state is integer, so
decoding repeats it exactly; a checksum of the ids guards every block.

Encoding to ids uses the tokenizers library through a table of distinct chunks,
which a worker keeps from task to task: the pre-tokenizer always cuts at some
borders (see :func:`borders`), so the text between them is encoded once and
joined by position.  Strings of special tokens in a text are ordinary text.

Defined cases: null and empty texts have the end id only; rows are ordered by
id (nulls first), ties by text hash; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .common import parts_for, pick, read, saved

MODEL = "byte_bpe_50k.json"
END_ID = 0
SEGMENT = 8 << 20
BLOCK = 4096
TABLE_CHUNKS = 2_000_000
SLICE = 8 << 20                           # bytes of text cut into chunks at once
START_BYTES, BROADCAST_BYTES = 64, 64 << 20     # a segment's start in a broadcast table, and its bound

# ---------------------------------------------------------------- text to ids

_encoders: dict[str, "ChunkEncoder"] = {}
HARD = np.zeros(256, bool)                # printable ASCII other than the space
HARD[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = HARD & ~LETTER
MARK[0x30:0x3A] = False                   # printable ASCII other than letters and digits
CUTS = MARK.copy()
CUTS[[0x20, 0x0A]] = True


def borders(data: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer cuts whatever surrounds them: white space after
    something else, a mark after a letter, and what follows a single line feed.

    Non-ASCII characters count as something else unless they are white space,
    controls or format characters; only Latin-1 letters among them count as letters."""
    cut = np.zeros(len(data), bool)
    at = np.flatnonzero(CUTS[data])
    at = at[at > 0]
    now, last = data[at], data[at - 1]
    hard, letter = HARD[last], LETTER[last]
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        end = at[wide]
        last, before, lead = data[end - 1], data[end - 2], data[end - 3]   # an index below 0 meets no such lead
        soft = (before == 0xC2) & (last <= 0xA0)
        soft |= (lead == 0xE1) & ((before == 0x9A) | (before == 0xA0))
        soft |= (lead == 0xE2) & ((before == 0x81) | (before == 0x80) & ((last <= 0x8F) | (last >= 0xA8)))
        soft |= (lead == 0xE3) & (before == 0x80) & (last == 0x80)
        soft |= (lead == 0xEF) & (before == 0xBB)
        hard[wide] = ~soft
        letter[wide] = (before == 0xC3) & (last != 0x97) & (last != 0xB7)
    space = now <= 0x20
    ok = np.where(space, hard, letter)
    cut[at[ok]] = True
    feed = at[ok & (now == 0x0A)] + 1
    feed = feed[feed < len(data)]
    cut[feed[HARD[data[feed]]]] = True
    return cut


class ChunkEncoder:
    """Ids of texts by way of their distinct chunks.

    The table holds at most ``table_chunks`` entries, or those of one slice of
    text; a full one starts again with the chunks at hand, so memory is bounded."""

    def __init__(self, path: str, table_chunks: int = TABLE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this file take two bytes")
        self.n_bytes = np.zeros(1 << 16, np.int64)          # a byte-level token has one character a byte
        for token, i in self.tok.get_vocab().items():
            self.n_bytes[i] = len(token)
        self.limit, self.known = table_chunks, pa.array([], pa.large_binary())
        self.ids, self.at = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has.  Words after a space stay apart
        when joined, so they go to the library by the hundred."""
        plain = np.array([c[:1] == " " and c[1:].isalpha() for c in chunks], bool)
        words, rest = [c for c, p in zip(chunks, plain) if p], [c for c, p in zip(chunks, plain) if not p]
        texts = ["".join(words[i:i + 128]) for i in range(0, len(words), 128)]
        coded = [np.array(e.ids, np.uint16) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(coded or [np.zeros(0, np.uint16)])
        end = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
        covered = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(covered, end)
        if len(words) and (covered[-1] != end[-1] or (covered[last] != end).any()):
            raise ValueError("the tokenizer joins words over a space")
        own = [np.array(e.ids, np.uint16) for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        size = np.zeros(len(chunks), np.int64)
        size[plain], size[~plain] = np.diff(last, prepend=-1), [len(o) for o in own]
        out = np.zeros(int(size.sum()), np.uint16)
        of_words = np.repeat(plain, size)
        out[of_words], out[~of_words] = ids, np.concatenate(own or [np.zeros(0, np.uint16)])
        return out, size

    def slice_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[at[i]:at[i + 1]]`` (UTF-8), and how many each has."""
        none = np.zeros(len(at) - 1, np.int64)
        if at[-1] == at[0]:
            return np.zeros(0, np.uint16), none
        data = np.ascontiguousarray(data[at[0]:at[-1]])
        at = at - at[0]
        cut = borders(data)
        cut[at[:-1][at[:-1] < len(data)]] = True
        edge = np.append(np.flatnonzero(cut), len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [
            None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        number, distinct = chunks.indices.to_numpy(), chunks.dictionary
        row = pc.index_in(distinct, value_set=self.known)
        missing = row.is_null()
        new = distinct.filter(missing)
        row = row.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            ids, size = self.library(new.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist())
            row[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        first, size = self.at[row][number], np.diff(self.at)[row][number]
        total = np.concatenate(([0], np.cumsum(size)))
        out = self.ids.take(np.repeat(first - total[:-1], size) + np.arange(total[-1]))
        if len(self.known) > self.limit:
            size = np.diff(self.at)[row]
            total_row = np.concatenate(([0], np.cumsum(size)))
            self.ids = self.ids.take(np.repeat(self.at[row] - total_row[:-1], size) + np.arange(total_row[-1]))
            self.known, self.at = distinct, total_row
        return out, np.diff(total[np.searchsorted(edge, at)])

    def encode(self, texts: list[str]) -> list[bytes]:
        data, at = W.text_buffer(pa.array(texts, pa.string()))
        ids, size = self.slice_ids(data, at)
        return [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(size)[:-1])]


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ the coder

ROUND = 128                               # ids that a block codes between two updates of its model
ONE = 12                                  # bits of a probability of the contexts
BITS = 16                                 # bits of a share of the interval
SLOTS = 10                                # log2 of the slots of a context table
LEAST = 64                                # least share of an order-0 class
PRIOR, GAIN, TOTAL_MAX = 512, 4, 1 << 13
KINDS = 128                               # order-2 confidence x order-0 grade x order-1 confidence x agreement
MOST2, MOST = 4000, 4032                  # most of 2**ONE that contexts take: every class keeps a share
#: The interval is below 2**64 wide; words of 32 bits leave at its top.
BOTTOM, WORD = np.uint64(1 << 32), np.uint64(32)

_p = (np.arange(1 << ONE) + 0.5) / (1 << ONE)
STRETCH = np.rint(256 * np.log(_p / (1 - _p))).astype(np.int32)
SQUASH = np.clip(np.rint((1 << ONE) / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, MOST2).astype(np.int32)
FIRST = (1 << 14, 1 << 13, 1 << 13, 1 << 12)  # 16-bit chances before the first round


GAINED2, GAINED1 = np.int32(1 << 21), np.int32(1 << 17)     # a step of confidence, of four
FULL2, FULL1 = 3 * GAINED2, 3 * GAINED1
A2, A1, A0 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0x1234567)
B1, B0, DOWN = np.uint32(0xC2B2AE3D), np.uint32(0x7654321), np.uint32(32 - SLOTS)


def low_half(entries: np.ndarray) -> np.ndarray:
    """The ids of entries (without a copy: numbers here are little-endian)."""
    return entries.view("<u2")[..., ::2]


def margins(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of a table over situations: by order-2 confidence, by order-0 grade,
    by order-1 confidence and agreement."""
    n = of.shape[-1]
    pair = of.reshape(16, 8, n).sum(axis=1, dtype=np.int32).reshape(4, 4, n)
    one = of.reshape(16, 8 * n).sum(axis=0, dtype=np.int32).reshape(4, 2, n)
    return pair.sum(axis=1, dtype=np.int32), pair.sum(axis=0, dtype=np.int32), one


class Frequencies:
    """Order 0 of a segment: ids in classes by the binary order of their number,
    which is all that a file says of it (``level``, 0: not there)."""

    def __init__(self, level: np.ndarray):
        self.level = level
        levels = np.unique(level[level > 0])
        self.n = len(levels)
        index = np.zeros(256, np.int64)
        index[levels] = np.arange(self.n)
        self.kind = index[level].astype(np.uint8)
        there = np.flatnonzero(level)
        self.members = there[np.argsort(level[there], kind="stable")].astype(np.int32)
        self.size = np.bincount(self.kind[there], minlength=self.n)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.zeros(1 << 16, np.int64)
        self.place[self.members] = np.arange(len(there)) - np.repeat(self.first, self.size)
        mass = self.size << levels.astype(np.int64)
        self.prior = np.maximum(4, PRIOR * mass // max(1, mass.sum())).astype(np.int32)
        often = [mass.sum() < np.int64(1) << (level.astype(np.int64) + rare) for rare in (13, 10, 8)]
        self.grade = (np.sum(often, axis=0, dtype=np.int32) << 19) * (level > 0)


class Models:
    """The models of ``n`` blocks, advanced side by side.

    A context table holds, per slot, the id that followed there last, how often
    it did in a row (order 2, order 1) and the id's order-0 grade (order 2).
    Within a round the models stand still, so what they say is one table: for
    every kind of situation the chance that order 2 is right, and the chance
    that it or order 1 is.  The rest of the interval goes to the order-0 classes
    by adapted counts."""

    def __init__(self, n: int, zero: Frequencies):
        self.n, self.zero = n, zero
        self.lane = np.arange(n, dtype=np.int64)
        self.base, self.own = self.lane << SLOTS, self.lane.astype(np.int32)
        self.seen2, self.seen1 = np.zeros(n << SLOTS, np.int32), np.zeros(n << SLOTS, np.int32)
        # 16-bit chances: order 2 right by its confidence, by the order-0 grade, order 1 right by its confidence,
        # and order 1 right though order 2 is not
        self.right = [np.full((4, n), p, np.int32) for p in FIRST]
        self.weight = np.repeat(np.array([[28000], [12000], [24000]], np.int32), n, axis=1)
        self.count = np.repeat(zero.prior[:, None], n, axis=1)
        self.cum = np.zeros((zero.n + 1, n), np.int64)
        self.even = LEAST * np.arange(zero.n + 1)[:, None]

    def begin_round(self) -> None:
        np.cumsum(self.count, axis=0, out=self.cum[1:])
        self.cum = self.cum * ((1 << BITS) - LEAST * self.zero.n) // self.cum[-1] + self.even
        self.s2, self.s0, s1 = (STRETCH[r >> 4] for r in self.right[:3])
        self.s1 = np.stack([np.minimum(-s1, 0), s1], axis=1)                         # disagree, agree
        w2, w0, w1 = self.weight
        mixed = (w2 * self.s2)[:, None] + w0 * self.s0
        mixed = (mixed[:, :, None, None] + w1 * self.s1) >> 16
        mixed += 2047
        self.a = SQUASH.take(mixed, mode="clip")                                     # 4 x 4 x 4 x 2 x lanes
        both = self.a.astype(np.int64)
        both[..., 0, :] += np.maximum((MOST - self.a[..., 0, :]) * self.right[3] >> 16, 1)
        self.split = ((both << 32 | self.a) << (BITS - ONE)).ravel()

    def look(self, two: np.ndarray, one: np.ndarray):
        """Slots, entries, situation and its split, for one or more steps."""
        at2, at1 = self.base + ((two * A2 + one * A1 + A0) >> DOWN), self.base + ((one * B1 + B0) >> DOWN)
        e2, e1 = self.seen2.take(at2), self.seen1.take(at1)
        kind = (e2 >> 16) + (e1 >> 16)
        kind += low_half(e2) == low_half(e1)
        kind *= self.n
        kind += self.own
        return at2, at1, e2, e1, kind, self.split.take(kind)

    def learn(self, ids, at2, at1, e2, e1, kind, first, second, row) -> None:
        """Update with a round's ids (steps x lanes)."""
        size = np.int32(self.n * KINDS)
        told = np.bincount((kind + first * size + second * (2 * size)).ravel(), minlength=3 * size) \
            .astype(np.int32).reshape(3, *self.a.shape)
        hit2, hit1 = told[1], told[2]
        seen = told[0] + hit2 + hit1
        (err2, err0, err1), (of2, of0, of1) = margins((hit2 << ONE) - seen * self.a), margins(seen)
        (h2, h0, h1), n1 = margins(hit2), margins(hit1)[2][:, 0]
        for i, moved in enumerate(((err2 * self.s2).sum(axis=0), (err0 * self.s0).sum(axis=0),
                                   (err1 * self.s1).sum(axis=(0, 1)))):
            self.weight[i] += moved >> 12
        np.clip(self.weight, -(1 << 18), 1 << 18, out=self.weight)
        for table, hit, of in ((self.right[0], h2, of2), (self.right[1], h0, of0),
                               (self.right[2], n1 + h1[:, 1], of1[:, 0] + of1[:, 1]),
                               (self.right[3], n1, of1[:, 0] - h1[:, 0])):
            table[:] = np.clip((table * 24 + hit * 65535) // (24 + of), 32, 65535 - 32)
        missed = row[~(first | second)]
        self.count += GAIN * np.bincount(missed, minlength=self.count.size).astype(np.int32).reshape(self.count.shape)
        heavy = self.count.sum(axis=0) > TOTAL_MAX
        self.count[:, heavy] = (self.count[:, heavy] + 1) >> 1
        ids32 = ids.astype(np.int32)
        entry = ids32 | self.zero.grade.take(ids)
        # order 2: entry = id | (confidence * 4 + grade) * 8 << 16; order 1: id | confidence * 2 << 16.
        # A right id gains confidence; a wrong one loses half, and its place if it had little.
        self.seen2[at2.ravel()] = np.where(first, e2 + ((e2 < FULL2) * GAINED2), np.where(
            e2 >= 2 << 21, (e2 & 0x1FFFFF) | (1 << 21), entry)).ravel()
        right1 = first & (low_half(e2) == low_half(e1)) | second
        self.seen1[at1.ravel()] = np.where(right1, e1 + ((e1 < FULL1) * GAINED1), np.where(
            e1 >= 2 << 17, (e1 & 0xFFFF) | (1 << 17), ids32)).ravel()


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The packed levels of the ids and their length, then blocks of ids below
    2**16: length, words, crc32 (unsigned 32 bit each), the 32-bit words of the code."""
    n = -(-len(ids) // block)
    if not n:
        return b""
    size = np.full(n, block)
    size[-1] = len(ids) - (n - 1) * block
    length = min(block, len(ids))
    grid = np.zeros((n, length), "<u2")       # the last block is filled up with id 0
    grid.ravel()[:len(ids)] = ids
    number = np.bincount(grid.ravel(), minlength=1 << 16)
    zero = Frequencies(np.ceil(np.log2(number + 1)).astype(np.uint8))
    steps = np.zeros((2 + length, n), np.uint32)
    steps[2:] = grid.T
    m = Models(n, zero)
    low, width = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    words, sent = np.zeros((length + 2, n), np.uint32), np.ones((length + 2, n), bool)
    carry = np.zeros((length + 2, n), bool)
    for lo in range(0, length, ROUND):
        hi = min(lo + ROUND, length)
        x = steps[2 + lo:2 + hi]
        m.begin_round()
        at2, at1, e2, e1, kind, split = m.look(steps[lo:hi], steps[1 + lo:1 + hi])
        first = low_half(e2) == x
        second = (low_half(e1) == x) & ~first
        missed = ~(first | second)
        a, both = split & 0xFFFF, split >> 32
        own = zero.kind.take(x)
        row = own * np.int64(n) + m.lane
        one, zero_order = first.view(np.int8) - np.int64(1), -missed.astype(np.int64)    # masks of not
        rest, more = (1 << BITS) - both & zero_order, both - a
        under, over = (rest * m.cum.take(row)) >> BITS, (rest * m.cum.take(row + n)) >> BITS
        start = ((a & one) + (more & zero_order) + under).view(np.uint64)
        share = (a + (more & one) + over).view(np.uint64) - start
        among = ((zero.size.take(own) - 1 & zero_order) + 1).view(np.uint64)
        place = (zero.place.take(x) & zero_order).view(np.uint64)
        for t in range(hi - lo):
            unit = width >> np.uint64(BITS)
            width = unit * share[t] // among[t]
            unit *= start[t]
            unit += width * place[t]
            low += unit
            np.less(low, unit, out=carry[lo + t])
            out = np.less(width, BOTTOM, out=sent[lo + t])
            words[lo + t] = low >> WORD
            shift = out * WORD
            low <<= shift
            width <<= shift
        m.learn(x, at2, at1, e2, e1, kind, first, second, row)
    words[length], words[length + 1] = low >> WORD, low & (BOTTOM - np.uint64(1))
    sent, carry = np.ascontiguousarray(sent.T), np.ascontiguousarray(carry.T)
    code = np.ascontiguousarray(words.T)[sent].astype(np.int64)
    # a carry goes into the word that left before it
    at = np.flatnonzero(carry)
    before = np.cumsum(sent, dtype=np.int32)
    code += np.bincount(before[at - 1] - 1, minlength=len(code))
    while len(at := np.flatnonzero(code >> 32)):
        code[at] &= 0xFFFFFFFF
        code[at - 1] += 1
    code, end = code.astype("<u4"), before.reshape(n, -1)[:, -1]
    used = np.diff(end, prepend=0)
    packed = zlib.compress(zero.level.tobytes())
    parts = [np.array([len(packed)], "<u4").tobytes(), packed]
    for i in range(n):
        head = np.array([size[i], used[i], zlib.crc32(grid[i, :size[i]].tobytes())], "<u4")
        parts += [head.tobytes(), code[end[i] - used[i]:end[i]].tobytes()]
    return b"".join(parts)


def decode_blocks(raw: bytes) -> np.ndarray:
    """The ids of ``encode_blocks``; a wrong checksum is an error."""
    if not len(raw):
        return np.zeros(0, np.uint16)
    pos = 4 + int(np.frombuffer(raw, "<u4", 1)[0])
    try:
        zero = Frequencies(np.frombuffer(zlib.decompress(raw[4:pos]), np.uint8))
    except zlib.error as e:
        raise ValueError("the levels are damaged") from e
    heads, codes = [], []
    while pos < len(raw):
        head = np.frombuffer(raw, "<u4", 3, pos)
        heads.append(head)
        codes.append(np.frombuffer(raw, "<u4", int(head[1]), pos + 12))
        pos += 12 + 4 * int(head[1])
    n = len(heads)
    size = np.array([h[0] for h in heads], np.int64)
    used = np.array([h[1] for h in heads], np.int64)
    words = np.concatenate(codes).astype(np.uint64)
    at_word = np.cumsum(used) - used
    m = Models(n, zero)
    off = (words[at_word] << WORD) | words[at_word + 1]        # the code, less the low end
    at_word += 2
    width = np.full(n, (1 << 64) - 1, np.uint64)
    length = int(size[0])
    out = np.zeros((2 + length, n), np.uint32)
    members, of_size, of_first = zero.members, zero.size - 1, zero.first
    top = np.int64((1 << BITS) - 1)
    held = [np.zeros((min(ROUND, length), n), t) for t in (
        np.int64, np.int64, np.int32, np.int32, np.int32, bool, bool, np.int64)]
    for lo in range(0, length, ROUND):
        hi = min(lo + ROUND, length)
        m.begin_round()
        cum, inner = m.cum.ravel(), m.cum[1:-1].astype(np.int32)
        for t in range(lo, hi):
            seen = m.look(out[t], out[t + 1])   # at2, at1, e2, e1, kind, split
            e2, e1, split = seen[2], seen[3], seen[5]
            a, both = split & 0xFFFF, split >> 32
            unit = width >> np.uint64(BITS)
            v = np.minimum((off // unit).view(np.int64), top)
            first, known = v < a, v < both
            one, zero_order = first.view(np.int8) - np.int64(1), known.view(np.int8) - np.int64(1)   # masks of not
            rest, more = (1 << BITS) - both, both - a
            # the last class whose start is not above v; the quotient is exact in doubles
            want = ((((v - both + 1) << BITS) - 1) / rest).astype(np.int32)
            own = np.add.reduce(inner <= want, axis=0, dtype=np.int8)
            row = own * np.int64(n) + m.lane
            rest &= zero_order
            start = (a & one) + (more & zero_order) + (rest * cum.take(row) >> BITS)
            stop = a + (more & one) + (rest * cum.take(row + n) >> BITS)
            among = ((of_size.take(own) & zero_order) + 1).view(np.uint64)
            width = unit * (stop - start).view(np.uint64) // among
            off -= unit * start.view(np.uint64)
            place = np.minimum(off // width, among - np.uint64(1))
            off -= width * place
            x = np.where(known, low_half(np.where(first, e2, e1)),
                         members.take(of_first.take(own) + place.view(np.int64), mode="clip"))
            out[t + 2] = x
            need = width < BOTTOM
            shift = need * WORD
            width <<= shift
            off <<= shift
            off |= words.take(at_word, mode="clip") * need
            at_word += need
            for all_steps, now in zip(held, (*seen[:5], first, known & ~first, row)):
                all_steps[t - lo] = now
        m.learn(out[2 + lo:2 + hi], *(all_steps[:hi - lo] for all_steps in held))
    grid = np.ascontiguousarray(out[2:].T).astype("<u2")
    for i in range(n):
        if zlib.crc32(grid[i, :size[i]].tobytes()) != heads[i][2]:
            raise ValueError(f"block {i}: checksum differs")
    return grid.ravel()[:int(size.sum())]


# ------------------------------------------------------------------ the files

SEGMENT_SCHEMA = "part int, seq int, n long, ids binary, known binary, sizes binary, code binary"


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Write all documents in id order with an end id each; returns the table of
    segments as reread from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        held, total = [], 0

        def flush():
            number, known, ids, sizes = (np.concatenate(x) for x in zip(*held))
            yield pa.record_batch([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(sizes.sum())]),
                pa.array([number.astype("<i8").tobytes()]), pa.array([known.tobytes()]),
                pa.array([sizes.astype("<i8").tobytes()]), pa.array([encode_blocks(ids, block)], pa.binary())],
                names=[c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])

        for batch in batches:
            col = batch.column("text").fill_null("")
            data, at = W.text_buffer(col)
            number = batch.column("id").fill_null(0).to_numpy()
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, text, off in W.slices(data, at, min(SLICE, segment)):
                ids, sizes = coder.slice_ids(text, off)
                ids = np.insert(ids, np.cumsum(sizes), END_ID)
                held.append((number[lo:hi], known[lo:hi], ids, sizes + 1))
                total += len(ids)
                if total >= segment:
                    yield from flush()
                    held, total, seq = [], 0, seq + 1
        if held:
            yield from flush()

    src = (pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
           .withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()))
    # ranges over the whole order, so many rows of one id, or without one, are cut, too
    order = ["id", "tie", "row"]
    src = src.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order).select("id", "text")
    return saved(src.mapInArrow(run, SEGMENT_SCHEMA), "tokens")


def segment_starts(files: DataFrame) -> DataFrame:
    """``(part, seq, before)``: ids of all earlier segments.  The running sum over
    parts reads one row a part."""
    parts = files.groupBy("part").agg(F.sum("n").alias("n_part"))
    parts = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    return (files.select("part", "seq", inside.alias("inside")).join(parts, "part")
            .select("part", "seq", (F.col("inside") + F.col("base")).alias("before")))


def read_tokens(files: DataFrame) -> DataFrame:
    """``(id, start, ids)`` of every document, ids as little-endian unsigned
    32-bit integers, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["code"]).astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<i8")
                end = np.cumsum(sizes)
                known = np.frombuffer(row["known"], bool)
                number = np.frombuffer(row["ids"], "<i8")
                for lo in range(0, len(sizes), 1024):
                    part = slice(lo, lo + 1024)
                    n = len(sizes[part])
                    yield pa.record_batch([
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
                        pa.array(number[part], mask=~known[part]), pa.array(end[part] - sizes[part]),
                        pa.array([ids[b - s:b].tobytes() for b, s in zip(end[part], sizes[part])], pa.binary())],
                        names=["part", "seq", "id", "offset", "ids"])

    docs = files.mapInArrow(run, "part int, seq int, id long, offset long, ids binary")
    starts = segment_starts(files)
    if files.count() * START_BYTES <= BROADCAST_BYTES:     # else the ids are shuffled to their segment's start
        starts = F.broadcast(starts)
    return (docs.join(starts, ["part", "seq"])
            .select("id", (F.col("offset") + F.col("before")).alias("start"), "ids"))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_frame(docs: DataFrame, **options) -> DataFrame:
    back = read_tokens(write_tokens(docs, model_path(), **options))
    return back.select(F.col("id").alias("doc_id"), "start",
                       (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def op5_token_files(spark, sf_dir):
    return op5_frame(read(spark, sf_dir, "documents"))
