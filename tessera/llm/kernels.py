"""Vectorised byte and word kernels used inside tasks (numpy only).

All hashes are 64-bit. A text is a run of UTF-8 bytes; many texts are handled
at once as one byte array plus offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64 constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_TABLE = mix(np.arange(1, 257, dtype=U64) * _ODD) | U64(1)
_POW: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them."""
    got = _POW.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, U64(base))
        got[0] = 1
        got = np.multiply.accumulate(got)
        _POW[base] = got
    return got[:n]


_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the byte polynomial; ``span_hash`` reads spans from it."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) wherever they stand (equal bytes, equal hash)."""
    h = (sums[end] - sums[start]) * _powers(_INV, len(sums))[start]
    return mix(h + (end - start).astype(U64) * _ODD)


WORD_BLOCK = 64
"""Bytes that the polynomial is trusted with: some longer strings differ by a multiple of 2**64."""


def word_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of any number.

    As ``span_hash`` up to ``WORD_BLOCK`` bytes; of a longer string the hashes
    of its blocks are mixed with their places and added, so that no structure
    of the string carries over from block to block.
    """
    h = span_hash(sums, start, end)
    far = np.flatnonzero(end - start > WORD_BLOCK)
    if len(far):
        n = -(-(end[far] - start[far]) // WORD_BLOCK)
        own = np.repeat(np.arange(len(far)), n)
        place = ranges(np.zeros(len(far), np.int64), n)
        a = start[far][own] + WORD_BLOCK * place
        part = span_hash(sums, a, np.minimum(a + WORD_BLOCK, end[far][own]))
        part = mix(part + (place.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
        h[far] = mix(np.add.reduceat(part, np.cumsum(n) - n) + (end[far] - start[far]).astype(U64) * _ODD)
    return h


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string of ``data`` (len(data)-k+1 of them)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    s = prefix_sums(data)
    return mix((s[k:] - s[:n]) * _powers(_INV, n))


def text_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # no chunk, or too long for one
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    _, off, dat = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def portions(off: np.ndarray, size: int = 1 << 20):
    """Ranges (first, behind the last) of texts of about ``size`` bytes; a longer text stands alone."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, min(hi, len(off) - 1)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased.

    Returns (word hash, start byte, first word of each text); a word never
    crosses a text's end.
    """
    h, start, _, first = word_spans(data, offsets)
    return h, start, first


def word_spans(data, offsets):
    """(word hash, start, end, first word of each text)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.ones(n + 1, bool)
    cut[1:n] = space[1:] != space[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    keep = ~space[start]
    start, end = start[keep], end[keep]
    h = word_hash(prefix_sums(_LOWER[data]), start, end)
    return h, start, end, np.searchsorted(start, offsets)


def shingle_hash(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (positions 0 .. len-size)."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    m = _ODD
    for j in range(size):
        h += word[j : j + n] * m
        m = U64((int(m) * _BASE) & 0xFFFFFFFFFFFFFFFF)
    return mix(h)


def doc_shingles(word: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a shorter text is one shingle."""
    if len(word) == 0:
        return np.zeros(0, U64)
    if len(word) < size:
        return shingle_hash(word, len(word)) ^ U64(len(word))
    return np.unique(shingle_hash(word, size))


def sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """op over each window of w values (np.minimum / np.maximum); length len(a)-w+1."""
    span = 1
    while span * 2 <= w:
        a = op(a[: len(a) - span], a[span:])
        span *= 2
    if span < w:
        a = op(a[: len(a) - (w - span)], a[w - span :])
    return a


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i]+count[i]-1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(start - (np.cumsum(count) - count), count)
    return base + np.arange(total)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs (touching spans join)."""
    if len(start) == 0:
        return start, end
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:] - 1, len(start) - 1)]
