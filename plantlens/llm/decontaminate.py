"""Benchmark decontamination by spaced-seed hashing.

Terms are lower-cased (A-Z) runs of letters, digits and non-ASCII bytes. Document and item
overlap if, laid on one another, some run of WINDOW terms (or the whole item, if shorter) is
equal in at least EQUAL of its places.

A mask looks at two blocks of terms and ignores what is between them, so that a seed still
hits where a passage had words substituted there. A run of w terms with at most m of them
unequal is cut into m + 2 blocks: two of these are equal at least, so that the masks of all
distances between two blocks miss no overlap. Every position of every document is hashed
under every mask and looked up among the benchmark's hashes, those of many documents at once;
only documents with a hit are looked at one by one, and each hit is verified.

The benchmark's seeds are broadcast in blocks of at most `block_bytes` of item text; more
items mean more passes and never a larger broadcast. Items of fewer terms than SPAN are
sought whole and must be equal; those of fewer than LEAST terms are no evidence and never
match. Null or empty texts and items match nothing; repeated items or rows match each for
itself; other columns are ignored or, where rows are returned, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm import base
from plantlens.llm import textmath as tm

#: Least terms of an item that is sought by masks.
SPAN = 12
WINDOW, EQUAL, LEAST = 24, 0.8, 6
_FACTORS = tm.mix(np.arange(101, 101 + WINDOW, dtype=np.uint64)) | tm.U(1)
_TABLE_BITS = 22
#: Pairs of places under one hash from which their number is compared with that of all offsets.
MANY = 4096


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the rows, and where each row's begin (one more at the end)."""
    out, at = [], offsets
    for piece, at in tm.segments(data, offsets, tm.TERM_SEPARATOR):
        starts, ends = tm.word_spans(piece, at, tm.TERM_SEPARATOR)
        out.append(tm.span_hash(tm.prefix_hash(piece, fold=True), starts, ends))
        at = np.searchsorted(starts, at)
    found = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return found, at if len(out) == 1 else np.array([0, len(found)] if len(offsets) == 2 else [0] * len(offsets))


def blocked(w: int) -> tuple[int, int]:
    """The terms of a block and the blocks of a run of w terms: two blocks more than the run
    may have unequal terms."""
    n = w - math.ceil(EQUAL * w) + 2
    return w // n, n


def seeds(block: np.ndarray, width: int, distance: int) -> np.ndarray:
    """The hash at each position under the mask of two blocks that begin `distance` blocks of
    `width` terms from one another; `block` holds the hashes of all runs of `width` terms."""
    n = max(0, len(block) - width * distance)
    return block[:n] + block[width * distance :] * _FACTORS[distance]


@dataclass
class Index:
    """The seeds of a block of items: ascending hashes with item and position."""

    ids: list[int | None]
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: ascending whole hashes, items
    masks: list[tuple[int, int]]  # width and distance
    table: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Index:
        ids = [i for i, _ in rows]
        items = []
        for _, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            items.append(terms(data, np.array([0, len(data)]))[0])
        h, item, position, short, masks = [], [], [], {}, set()
        for i, t in enumerate(items):
            if len(t) >= SPAN:
                width, n = blocked(min(WINDOW, len(t)))
                block = tm.runs(t, width)
                for distance in range(1, n):
                    s = seeds(block, width, distance)
                    # a run that is the whole item has its blocks at known places
                    at = np.arange(len(s)) if len(t) > WINDOW else np.arange(n - distance) * width
                    masks.add((width, distance))
                    h.append(s[at])
                    item.append(np.full(len(at), i))
                    position.append(at)
            elif len(t) >= LEAST:
                short.setdefault(len(t), []).append((int(tm.runs(t, len(t))[0]), i))
        hashes, item, position = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, item, position))
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, bool)
        hashes = hashes[order].astype(np.uint64)
        table[(hashes >> tm.U(64 - _TABLE_BITS)).astype(np.int64)] = True
        wholes = {n: tuple(np.array(x, dtype) for x, dtype in zip(zip(*sorted(found), strict=True), (np.uint64, np.int64), strict=True)) for n, found in short.items()}
        return cls(ids, items, hashes, item[order], position[order], wholes, sorted(masks), table)

    def suggested(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the rows that begin at the places `at` of t (one more at the end) hold a seed
        or a whole short item. All rows are looked up at once; the others match nothing."""
        found = np.zeros(len(at) - 1, bool)

        def mark(hashes: np.ndarray, known: np.ndarray, span: int, place: np.ndarray) -> None:
            k = np.searchsorted(known, hashes)
            place = place[known[np.minimum(k, len(known) - 1)] == hashes]
            row = np.searchsorted(at, place, side="right") - 1
            found[row[place + span <= at[row + 1]]] = True  # not over a row's end

        if len(self.hashes):
            block = {width: tm.runs(t, width) for width in {width for width, _ in self.masks}}
            for width, distance in self.masks:
                s = seeds(block[width], width, distance)
                place = np.flatnonzero(self.table[(s >> tm.U(64 - _TABLE_BITS)).astype(np.int64)])
                mark(s[place], self.hashes, width * (distance + 1), place)
        for n, (wholes, _) in self.short.items():
            s = tm.runs(t, n)
            place = np.flatnonzero(np.isin(s, wholes))
            mark(s[place], wholes, n, place)
        return found

    def hits(self, t: np.ndarray) -> np.ndarray:
        """Distinct (item, offset of the item's start in t) that some seed suggests. Where a
        repeated seed would give more pairs of places than there are offsets between its
        first and last places, all those offsets are taken."""
        found = [np.zeros(0, np.int64)]
        block = {width: tm.runs(t, width) for width in {width for width, _ in self.masks}}
        for width, distance in self.masks:
            s = seeds(block[width], width, distance)
            at = np.flatnonzero(self.table[(s >> tm.U(64 - _TABLE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, s[at], "left"), np.searchsorted(self.hashes, s[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            order = np.argsort(lo, kind="stable")
            at, lo, n = at[order], lo[order], n[order]
            starts = np.flatnonzero(np.append(True, lo[1:] != lo[:-1])[: len(lo)])
            times = np.diff(np.append(starts, len(lo)))
            many = times * n[starts] > MANY
            for k in np.flatnonzero(many & (times > 1)).tolist():
                mine = at[starts[k] : starts[k] + times[k]]
                of, place = (x[lo[starts[k]] : lo[starts[k]] + n[starts[k]]] for x in (self.item, self.position))
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(of)).tolist(), strict=True):
                    first, last = int(mine[0] - place[a:b].max()), int(mine[-1] - place[a:b].min())
                    offsets = np.arange(first, last + 1) if len(mine) * (b - a) > last - first else (mine[:, None] - place[None, a:b]).reshape(-1)
                    found.append(self._pairs(of[a], offsets))
            few = np.repeat(~many | (times == 1), times)
            at, lo, n = at[few], lo[few], n[few]
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(self._pairs(self.item[k], np.repeat(at, n) - self.position[k]))
        both = np.unique(np.concatenate(found))
        return np.stack([both >> 40, (both & (1 << 40) - 1) - (1 << 39)], axis=1)

    @staticmethod
    def _pairs(item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Item and offset as one word; repeats go at once."""
        return np.unique(np.int64(item) << np.int64(40) | offset + (1 << 39))

    def matches(self, t: np.ndarray) -> list[tuple[int | None, int, int, int]]:
        """(item id, first term, terms, equal terms) of the verified overlaps, the best of
        each item."""
        best: dict[int, tuple[int, int, int]] = {}
        for i, d in self.hits(t).tolist():
            item = self.items[i]
            lo, hi = max(0, d), min(len(t), d + len(item))
            w = min(WINDOW, len(item))
            equal = np.append(0, np.cumsum(t[lo:hi] == item[lo - d : hi - d]))
            good = np.flatnonzero(equal[w:] - equal[:-w] >= EQUAL * w) if hi - lo >= w else ()
            if len(good):
                a, b = int(good[0]), int(good[-1]) + w
                value = (lo + a, b - a, int(equal[b] - equal[a]))
                if i not in best or (value[2], -value[0]) > (best[i][2], -best[i][0]):
                    best[i] = value
        for n, (wholes, of) in self.short.items():
            s, first = np.unique(tm.runs(t, n), return_index=True)
            at = np.searchsorted(s, wholes)
            for k in np.flatnonzero(s[np.minimum(at, len(s) - 1)] == wholes).tolist() if len(s) else ():
                best[int(of[k])] = (int(first[at[k]]), n, n)
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Index]:
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n = max(1, -(-total // block_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = benchmark.where(of == k).select("item_id", "text").orderBy("item_id", "text").collect()  # a block
        yield Index.of([(r.item_id, r.text) for r in rows])


def _rows_terms(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in tm.joined(column):
        t, at = terms(data, offsets)
        for i in range(len(offsets) - 1):
            yield t[at[i] : at[i + 1]]


def _rows_matches(column: pa.Array, index: Index) -> Iterator[list[tuple[int | None, int, int, int]]]:
    """Index.matches of each row. Only rows that hold a seed are looked at one by one."""
    for _, data, offsets in tm.joined(column):
        t, at = terms(data, offsets)
        for i, held in enumerate(index.suggested(t, at).tolist()):
            yield index.matches(t[at[i] : at[i + 1]]) if held else []


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, start, n_terms, n_equal: each document's best verified overlap with
    each item that it overlaps; start counts the document's terms."""
    spark = docs.sparkSession
    base.small_batches(spark)
    out = None
    for index in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *m) for i, found in zip(ids, _rows_matches(batch.column(1), index), strict=True) for m in found]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "n_terms", "n_equal"])

        found = base.only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, n_terms long, n_equal long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs without an overlap, with all their columns."""
    spark = docs.sparkSession
    base.small_batches(spark)
    at = docs.columns.index("text")
    for index in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _rows_matches(batch.column(at), index)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
