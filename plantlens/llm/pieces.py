"""Splits texts into the matches of the public byte-level pattern, and keeps each distinct
piece's ids, so that a tokenizer runs once per distinct piece and not once per occurrence.

The pattern is a fixed value of the public tokenizer:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from plantlens.llm import textmath as tm

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters handled at once, besides longer single texts.
CHARS = 1 << 18
_tables: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point by the pattern's own character classes."""
    if not _tables:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for lo in range(0, 0x110000, 0x10000):
            if lo >= 0x40000 and lo != 0xE0000:
                continue  # no letters, numbers or white space are assigned there
            points = [c for c in range(lo, lo + 0x10000) if not 0xD800 <= c < 0xE000]
            text = "".join(map(chr, points))
            for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(found, text):
                    kinds[points[m.start()] : points[m.end() - 1] + 1] = kind
        _tables.append(kinds)
        _tables.append(tm.mix(np.arange(3, 0x110003, dtype=np.uint64)))
    return _tables[0]


def split(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the texts chars[offsets[i]:offsets[i + 1]], ascending."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[chars]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    begins = offsets[:-1][offsets[:-1] < n]
    start[begins] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    final = np.zeros(n + 1, bool)
    final[offsets] = True
    white = kind[at] == SPACE
    # A white run before something else in its text gives up its last character: as the
    # prefix of what follows if it is U+0020, else as a piece of its own.
    inner = white & ~final[ends]
    last = ends[inner] - 1
    start[last] = True
    joins = last[chars[last] == 32] + 1
    start[joins] = False
    # Contractions: an apostrophe that starts a piece by itself takes the letters after it.
    lone = np.flatnonzero(start & (chars == 39))
    for i in lone.tolist():
        j = i + 1
        if j >= n or final[j] or kind[j] != LETTER:
            continue
        pair = j + 1 < n and not final[j + 1] and kind[j + 1] == LETTER and (int(chars[j]), int(chars[j + 1])) in _TWO
        size = 1 if int(chars[j]) in _ONE else 2 if pair else 0
        if size:
            start[j] = False
            if j + size < n and not final[j + size] and kind[j + size] == LETTER:
                start[j + size] = True
    return np.flatnonzero(start)


_ONE = {ord(c) for c in "stmd"}
_TWO = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


class Encoder:
    """Ids of whole texts, through a bounded table of the ids of known pieces.

    encode: ids of each of a list of pieces, by a tokenizer. The table has two places for a
    64-bit hash; a clash only costs another encode. Beyond `limit` ids it starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], slots: int = 1 << 21, limit: int = 4 << 20):
        self.encode, self.slots, self.limit = encode, slots, limit
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int64)
        self.n = np.zeros(self.slots, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _add(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, len(flat), 1 << 16), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        return at, n

    def _known(self, text: str, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(starts[1:], len(chars))
        h = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_tables[1][chars] * tm.powers(tm._BASE, len(chars)), out=h[1:])
        key = tm.span_hash(h, starts, ends) | tm.U(1)
        if self.used > self.limit:
            self.reset()
        slot = (key >> tm.U(40)).astype(np.int64) % self.slots
        second = np.flatnonzero(self.key[slot] != key)
        slot[second] = (key[second] >> tm.U(8)).astype(np.int64) % self.slots
        at, n = self.at[slot], self.n[slot]
        if len(miss := np.flatnonzero(self.key[slot] != key)):
            _, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            first = miss[first]
            new_at, new_n = self._add(self.encode([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            at[miss], n[miss] = new_at[back], new_n[back]
            key = key[first]
            to = (key >> tm.U(40)).astype(np.int64) % self.slots
            to = np.where(self.key[to] == 0, to, slot[first])
            self.key[to], self.at[to], self.n[to] = key, new_at, new_n
        return at, n

    def batch(self, values: list[str]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit unsigned integers."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(values):
            hi, size = lo, 0
            while hi < len(values) and (hi == lo or size + len(values[hi]) <= CHARS):
                size += len(values[hi])
                hi += 1
            out += self._some(values[lo:hi])
            lo = hi
        return out

    def _some(self, values: list[str]) -> list[np.ndarray]:
        text = "".join(values)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        starts = split(chars, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in values]
        at, n = self._known(text, chars, starts)
        ids = self.pool[gathered(at, n)]
        to = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
        return [ids[to[i] : to[i + 1]] for i in range(len(values))]


def gathered(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices at[0], at[0] + 1 .. (n[0] of them), at[1] .. of consecutive spans."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def strings(column: pa.Array) -> list[str]:
    """Values as Python strings; empty for null."""
    return [v or "" for v in column.to_pylist()]
