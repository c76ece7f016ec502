"""Vectorised word scanning and hashing over Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, after A-Z have
been lowered. Every word gets a 64-bit fingerprint, so whole batches are handled
with a few numpy passes and no Python object per word. Two different words share
a fingerprint with a chance of about 2**-60; callers treat equal fingerprints as
equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 3  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE_LOWER = _CODE[_LOWER]


def _powers(base: int) -> np.ndarray:
    """base**i for i below _BLOCK, modulo 2**64."""
    out = np.ones(_BLOCK, np.uint64)
    filled = 1
    while filled < _BLOCK:
        n = min(filled, _BLOCK - filled)
        out[filled : filled + n] = out[:n] * np.uint64(pow(base, filled, 1 << 64))
        filled += n
    return out


_POW, _POW_INV = _powers(_BASE), _powers(_INVERSE)


def _power(i: np.ndarray, base: int, table: np.ndarray) -> np.ndarray:
    """base**i for any array of exponents, from a table of the low part and one of the high part."""
    high = i >> 16
    top = np.array([pow(base, int(h) << 16, 1 << 64) for h in range(int(high.max(initial=0)) + 1)], np.uint64)
    return table[i & (_BLOCK - 1)] * top[high]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and row offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) for parts of a string column of about `most` bytes, or one text."""
    raw, offsets = text_bytes(column)
    block = offsets[1:] // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each row the index of its first word (n + 1 values)."""
    n = len(raw)
    solid = ~_SPACE[raw]
    begins, ends = solid.copy(), np.zeros(n + 1, bool)
    begins[1:] &= ~solid[:-1]
    ends[1:n] = solid[:-1] & ~solid[1:]
    if n:
        ends[n] = solid[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts[solid[cuts]]] = True
    ends[cuts[solid[cuts - 1]]] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A fingerprint for each word; A-Z count as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(raw)
    terms = _CODE_LOWER[raw]
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        terms[lo:hi] *= _POW[: hi - lo] * np.uint64(pow(_BASE, lo, 1 << 64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    sums = (total[end] - total[start]) * _power(start, _INVERSE, _POW_INV)
    return mix(sums + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of a whole column and the index of each row's first word (n + 1 values)."""
    raw, offsets = text_bytes(column)
    start, end, first = word_spans(raw, offsets)
    return word_hashes(raw, start, end), first


def combine(*parts: np.ndarray) -> np.ndarray:
    """A fingerprint of a sequence of fingerprints; their order counts."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xA24BAED4963EE407) + p)
    return out
