"""Array kernels over Arrow text columns: words, hashes of spans, sliding minima.

A span's hash comes from prefix sums of a polynomial modulo 2**64, so any number of spans costs one pass over the bytes.
Equal spans have equal hashes in every task; unequal spans differ but for a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES, CHUNK_DOCS = 1 << 20, 4096
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        grown = np.full(size, base, np.uint64)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(pow(BASE, -1, 1 << 64), len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of runs of whole documents, about CHUNK_BYTES each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1), lo + CHUNK_DOCS, n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def space_table() -> np.ndarray:
    """True for bytes of words: all but space and 9 to 13."""
    t = np.ones(256, bool)
    t[[32, *range(9, 14)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for a-z, 0-9 and bytes outside ASCII."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document and the number of words): words never cross documents."""
    is_word = inside[raw]
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[:-1] = is_word
    edge[1:] -= is_word
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    cut = cut[is_word[cut] & is_word[cut - 1]]  # a word that would go on into the next document
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def group_ids(bounds: np.ndarray) -> np.ndarray:
    """Document of each word from the bounds of documents."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def gram_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(BASE)
        out += hashes[i:i + n]
    return mix(out)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys, by doubling."""
    step, out = 1, keys
    while 2 * step <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:len(keys) - w + 1], out[w - step:]) if w > step else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length - 1."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)


def take_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of raw[start:end]."""
    n = ends - starts
    data = raw[ranges(starts, n)]
    at = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def classes(*keys: np.ndarray) -> np.ndarray:
    """Dense numbers of equal tuples."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.int64)
    for k in keys[1:]:
        own = np.unique(k, return_inverse=True)[1]
        out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1].astype(np.int64)
    return out
