"""Vector code compression: product quantisation in integers, nearest entries by VA-file filtering.

A component x becomes floor(1024 * x); a vector is cut into PARTS equal parts, and each part is
coded by its codebook's nearest entry (squared Euclidean distance, ties to the lower index).
A codebook starts as that part of the vectors of the `entries` smallest ids; each round assigns
every part and replaces each entry by the componentwise floor of its parts' mean.

The nearest entry is found as in a VA-file. Each coordinate of the entries is quantised to one of
2 ** bits cells (by quantiles of that coordinate, so that cells hold like numbers of entries). A
query's table says for each coordinate and cell the least and the greatest squared distance to
the cell; their sums over an entry's cells bound its distance from below and above. Only entries
whose lower bound doesn't exceed the least upper bound are refined by integer distances.

On Spark: the scaled vectors are written once; a round is one pass in which each task assigns its
vectors and sums its parts by entry, so that at most entries * PARTS rows leave a task; their
totals, as many again, are all that reaches the driver. Codebooks are broadcast: entries, parts
and dimensions bound them, not the data.

Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are
vectors that have another length than the vector of the smallest id, or one that PARTS doesn't
divide. Repeated rows keep a row each (rows of one id go by their vector). Rows with a null id
are coded, but begin no codebook. Fewer vectors than entries make smaller codebooks; an empty
table gives no rows. Components beyond 2**18 in size raise a ValueError, as sums of squared
distances would leave 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm import base

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BITS = 4
MOST = 1 << 18  # of a component's size
STEP = 1 << 11  # vectors looked at together


@dataclass
class Approximation:
    """The cells of one codebook: bounds[d, c] to bounds[d, c + 1] hold the coordinates d of the
    entries whose cell there is c; both ends count."""

    entries: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Approximation:
        n, dim = entries.shape
        k = 1 << bits
        cells = np.zeros((n, dim), np.int64)
        low, high = np.zeros((dim, k), np.int64), np.zeros((dim, k), np.int64)
        for d in range(dim):
            values = np.sort(entries[:, d])
            edges = np.unique(values[np.arange(k) * n // k])
            cells[:, d] = np.searchsorted(edges, entries[:, d], side="right") - 1
            for c in range(len(edges)):
                held = entries[cells[:, d] == c, d]
                low[d, c], high[d, c] = held.min(), held.max()
        return cls(entries, cells, low, high)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distances of each query to each entry."""
        q = queries[:, :, None]
        below, above = self.low[None] - q, q - self.high[None]
        nearest = np.maximum(np.maximum(below, above), 0)
        farthest = np.maximum(np.abs(below), np.abs(above))
        nearest *= nearest
        farthest *= farthest
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(queries.shape[1]):
            lower += nearest[:, d].take(self.cells[:, d], axis=1)
            upper += farthest[:, d].take(self.cells[:, d], axis=1)
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, ties to the lower index."""
        index, distance = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for lo in range(0, len(queries), STEP):
            part = queries[lo : lo + STEP]
            lower, upper = self.bounds(part)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])  # rows in order, then entries
            exact = ((part[row] - self.entries[entry]) ** 2).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(exact, starts)
            hit = np.flatnonzero(exact == least[row])
            first = hit[np.searchsorted(row[hit], np.arange(len(part)))]
            index[lo : lo + STEP], distance[lo : lo + STEP] = entry[first], least
        return index, distance


@dataclass
class Codebooks:
    """One array (entries x dimensions) of integers for each part."""

    parts: list[np.ndarray]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) by vector and part."""
        found = [Approximation.of(book).nearest(x) for book, x in zip(self.parts, np.split(vectors, len(self.parts), axis=1), strict=True)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.parts for x in book.reshape(-1).tolist()).encode()).hexdigest()


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (double) and the scaled components as 64-bit integers, of the
    vectors without null or non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = base.only(vectors, "vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", good))
    sized = F.transform("embedding", lambda x: F.floor(F.when(F.abs(x) <= MOST, x.cast("double") * SCALE).otherwise(F.raise_error(F.lit(f"a component exceeds {MOST}")).cast("double"))).cast("long"))
    return kept.select("vec_id", "label", sized.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """The codebooks of the written table ints (vec_id, v); None without a vector."""
    spark = ints.sparkSession
    first = [np.array(r.v) for r in ints.where("vec_id is not null").orderBy("vec_id", "v").select("v").limit(entries).collect()]
    first = [v for v in first if len(v) == len(first[0])]
    if not first or len(first[0]) % parts:
        return None
    books = Codebooks(np.split(np.stack(first), parts, axis=1))
    width = len(first[0]) // parts
    names = [f"s{k}" for k in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{x} long" for x in names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            books = shared.value
            n = np.zeros((parts, entries), np.int64)
            total = np.zeros((parts, entries, width), np.int64)
            for batch in batches:
                vectors = _matrix(batch.column(0), parts * width)
                index, _ = books.assign(vectors)
                for p in range(parts):
                    x = vectors[:, p * width : (p + 1) * width]
                    order = np.argsort(index[:, p], kind="stable")
                    held, starts = np.unique(index[order, p], return_index=True)
                    n[p, held] += np.diff(np.append(starts, len(order)))
                    total[p, held] += np.add.reduceat(x[order], starts, axis=0)
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *[pa.array(total[part, entry, k]) for k in range(width)]], ["part", "entry", "n", *names])

        found = _fitting(ints, parts * width).select("v").mapInArrow(sums, schema)
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
        new = [book.copy() for book in books.parts]
        for r in found.collect():  # at most parts * entries rows
            new[r.part][r.entry] = [r[x] // r.n for x in names]  # whole numbers: floors go down
        books = Codebooks(new)
    return books


def _fitting(ints: DataFrame, dim: int) -> DataFrame:
    base.small_batches(ints.sparkSession)
    return ints.where(F.size("v") == dim)


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of each vector that has the codebooks' length."""
    shared = ints.sparkSession.sparkContext.broadcast(books)
    dim = sum(book.shape[1] for book in books.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distance = shared.value.assign(_matrix(batch.column(2), dim))
            codes = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kind = {c: t for c, t in ints.dtypes}
    return _fitting(ints, dim).select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and
    codebooks_sha256 of each kept vector."""
    spark = vectors.sparkSession
    scratch = base.Scratch(spark, "codes")
    ints = scratch.write(scaled(vectors), "ints")
    books = fit(ints, parts, entries, rounds)
    if books is None:
        books = Codebooks([np.zeros((1, 1), np.int64)] * parts)
        ints = ints.limit(0)
    coded = scratch.write(encode(ints, books), "coded")
    scratch.drop("ints")
    # a row for each label; Spark splits a frequent label's rows, or broadcasts the sums where they are small
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
