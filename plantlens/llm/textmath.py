"""Vectorised hashing over the UTF-8 buffers of Arrow string columns.

A span's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, so a
batch costs a few numpy passes and no Python object per word. Seeds are fixed: equal
spans have equal hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once; it bounds the working arrays to a few tens of MB.
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = U(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_PLAIN = mix(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
#: The separators of a word: space, tab, line feed, vertical tab, form feed, return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII character but letters and digits separates terms.
TERM_SEPARATOR = np.ones(256, bool)
TERM_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, SEGMENT + 1024)
        _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _powers[base][:n]


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _PLAIN)[data] * powers(_BASE, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(_BASE_INVERSE, len(h))
    return mix((h[ends] - h[starts]) * inverse[starts])


def window_hash(h: np.ndarray, width: int, step: int = 1 << 14) -> np.ndarray:
    """span_hash of the span of `width` bytes at each place, in steps that stay in the cache."""
    n = max(0, len(h) - width)
    inverse, out = powers(_BASE_INVERSE, len(h)), np.empty(n, np.uint64)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        x = h[lo + width : hi + width] - h[lo:hi]
        x *= inverse[lo:hi]
        out[lo:hi] = mix(x)
    return out


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value, without copies; none for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[at[i] : at[i + 1]] if valid[i] else data[:0]


def joined(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most `limit` bytes, or of one longer row."""
    rows, lo, size, parts = list(texts(column)), 0, 0, []
    for i, x in enumerate(rows):
        if parts and size + len(x) > limit:
            yield lo, *_together(parts)
            lo, size, parts = i, 0, []
        parts.append(x)
        size += len(x)
    if parts:
        yield lo, *_together(parts)


def _together(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(parts) if len(parts) > 1 else parts[0]), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, by default `[^\\x20\\x09-\\x0D]+`; none goes over a row's end."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] |= inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] |= inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the index of its first word (one more at the end).
    Long rows are taken in segments cut at separators."""
    out, at = [], offsets
    for piece, at in segments(data, offsets):
        starts, ends = word_spans(piece, at)
        out.append(span_hash(prefix_hash(piece, fold), starts, ends))
        at = np.searchsorted(starts, at)
    found = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return found, at if len(out) == 1 else np.array([0, len(found)] if len(offsets) == 2 else np.zeros(len(offsets), int))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of `width` values; the k-th starts at value k."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _WORD_BASE + hashes[k : k + n]
    return mix(out + U(width))


def segments(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same rows, or a long row's segments one by one, cut at separators."""
    if len(data) <= 2 * SEGMENT:
        yield data, offsets
        return
    assert len(offsets) == 2, "only a single row may be longer than a segment"
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        while hi < len(data) and not separator[data[hi]]:
            cut = np.flatnonzero(separator[data[hi : hi + SEGMENT]])
            hi = hi + int(cut[0]) if len(cut) else min(len(data), hi + SEGMENT)
        yield data[lo:hi], np.array([0, hi - lo])
        lo = hi


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct shingles, ascending: runs of `width` lower-cased words; the
    whole sequence as one where there are fewer; nothing without words."""
    for _, data, offsets in joined(column):
        w, at = words(data, offsets)
        sh = runs(w, width)
        for i in range(len(offsets) - 1):
            n = at[i + 1] - at[i]
            if n >= width:
                yield np.unique(sh[at[i] : at[i + 1] - width + 1])
            elif n:
                yield runs(w[at[i] : at[i + 1]], int(n))
            else:
                yield np.zeros(0, np.uint64)


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes; 0 names the empty set."""
    if not len(values):
        return 0
    parts = np.array([values.sum(dtype=np.uint64), np.bitwise_xor.reduce(values), U(len(values))], np.uint64)
    return int(mix(runs(mix(parts), 3)).view(np.int64)[0]) or 1
