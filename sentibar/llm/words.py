"""Vectorised views of Arrow text columns: bytes, words, lines, hashes.

A text column of a record batch is one byte buffer with offsets.  Words are
maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; a null text is empty.
Nothing here loops over words: each step is a numpy pass over the buffer.
Callers cut a batch with :func:`slices` first, so the temporaries follow the
slice size (or one document, if that is larger), not the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15          # odd, so invertible modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)
U = np.uint64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective): spreads every input bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``len + 1`` offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    at = np.frombuffer(off, dtype=np.int64 if wide else np.int32)
    at = at[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray,
           size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut at document borders into pieces of about ``size`` bytes: yields
    (first document, after the last, bytes, offsets from 0)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true bytes; runs never cross documents."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and per document the index of its first word
    (``len(at)`` entries)."""
    start, end = runs(~IS_SPACE[data], at)
    return start, end, np.searchsorted(start, at)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial from prefix sums, then mixed."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(BASE_INV, n + 1)[start]
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` entries of ``h``; ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(0xD1342543DE82EF95)
        out += h[j:j + n]
    return mix(out)


def gram_docs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``k`` words that stay in one document: word index of each
    run's start, and its document."""
    count = np.diff(first)
    per = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), per)
    skip = np.cumsum(per) - per
    pos = np.arange(len(doc)) - skip[doc] + first[:-1][doc]
    return pos, doc


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's range in ``first``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def cover(marked: np.ndarray, k: int, n: int) -> np.ndarray:
    """Boolean of length ``n``: positions within ``k`` of a marked start."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, marked, 1)
    np.subtract.at(change, np.minimum(marked + k, n), 1)
    return np.cumsum(change[:n]) > 0
