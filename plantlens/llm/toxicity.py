"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of four, five and six bytes, hashed into
BUCKETS. The machine's inputs, present or absent, are the terms that toxic documents hold
significantly more or less often (chi-squared over the training sample), and the terms of
pairs that say more of the label together than each for itself (chi-squared of the pair's
four cases less that of its terms). Pairs are sought within the bounded sample alone, among
its POOL most varied terms that at least HELD of its rows hold: a pair of a rarer term is found
only where the term says something by itself. Its factors
learn their pairwise interactions, such as an insult beside the mention of a group, which
additive weights miss. Only the text is an input of a score.

It is fitted on a bounded sample: labelled rows whose crc32(doc_id) mod 3 is not 1, at most
`max_rows` of them, chosen by a hash; a document's equal labels and equal rows count once. Nulls: a null text scores as an empty one, by the bias alone; labels without toxic or
doc_id are left out; without any positive label, or with empty tables, the bias alone is
learned (0 without labels). Equal texts have equal scores. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm import base
from plantlens.llm import textmath as tm

BUCKETS = 1 << 22
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Significance of an input and of a pair (of some half a million pairs), and the rows that a case must hold to count.
SINGLE, PAIR, EXPECTED = 8.0, 40.0, 5.0
#: Terms whose pairs are looked at (the most varied), and the sample's rows that such a term must be in.
POOL, HELD = 1024, 20


def term_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every word and beginning of the rows, with repeats."""
    for piece, at in tm.segments(data, offsets, tm.TERM_SEPARATOR):
        starts, ends = tm.word_spans(piece, at, tm.TERM_SEPARATOR)
        row = np.searchsorted(at, starts, side="right") - 1
        h = tm.prefix_hash(piece, fold=True)
        yield row, (tm.span_hash(h, starts, ends) % tm.U(BUCKETS)).astype(np.int32)
        for n in BEGINNINGS:
            long = ends - starts >= n
            begun = tm.mix(tm.span_hash(h, starts[long], starts[long] + n) + tm.U(n))
            yield row[long], (begun % tm.U(BUCKETS)).astype(np.int32)


def term_sets(column: pa.Array, keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Each row's distinct buckets; with keep (a table by bucket, 0: none), what it gives."""
    for _, data, offsets in tm.joined(column):
        rows, found = [], []
        for row, bucket in term_buckets(data, offsets):
            if keep is not None:
                bucket = keep[bucket]
                row, bucket = row[bucket > 0], bucket[bucket > 0]
            rows.append(row)
            found.append(bucket)
        n = len(offsets) - 1
        if not rows:
            yield from [np.zeros(0, np.int32)] * n
            continue
        pair = np.unique(np.concatenate(rows).astype(np.int64) << 32 | np.concatenate(found))
        at = np.searchsorted(pair >> 32, np.arange(n + 1))
        bucket = (pair & 0xFFFFFFFF).astype(np.int32)
        for i in range(n):
            yield bucket[at[i] : at[i + 1]]


@dataclass
class Machine:
    """Bias, weights and factors by input; place 0 stands for no input. Buckets that always
    come together, such as a word and its beginning, share a place."""

    buckets: np.ndarray
    places: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def table(self) -> np.ndarray:
        keep = np.zeros(BUCKETS, np.int32)
        keep[self.buckets] = self.places
        return keep

    def raw(self, rows: np.ndarray, inputs: np.ndarray, n: int) -> np.ndarray:
        """bias + sum of weights + sum over pairs of the factors' products, for n rows."""
        out, _ = self.sums(rows, inputs, n)
        return out

    def sums(self, rows: np.ndarray, inputs: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """raw() and the sum of each factor over the rows' inputs. A pair's products are half of
        the squared sum less the squares, which are one value for each input."""
        out = self.bias + np.bincount(rows, (self.weights - 0.5 * (self.factors**2).sum(axis=1))[inputs], n)
        each = [np.bincount(rows, np.ascontiguousarray(v)[inputs], n) for v in self.factors.T]
        for x in each:
            out += 0.5 * x * x
        return out, each


def fit(buckets: np.ndarray, places: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 200, rate: float = 1.0, decay: tuple[float, float] = (1e-6, 1e-3)) -> Machine:
    """Logistic loss by full-batch Adagrad over the rows' inputs (places from 1). Factors
    decay faster than weights, so that they say what weights can't."""
    rng = np.random.default_rng(7)
    size = int(places.max(initial=0)) + 1
    m = Machine(buckets, places, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, factors)))
    n = len(labels)
    if not n:
        return m
    share = min(max(labels.mean(), 1 / (n + 2)), 1 - 1 / (n + 2))
    m.bias = float(np.log(share / (1 - share)))
    if not len(buckets):
        return m
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    inputs = np.concatenate(sets)
    seen = [1e-8, np.full(size, 1e-8), np.full(m.factors.shape, 1e-8)]
    for _ in range(epochs):
        raw, each = m.sums(rows, inputs, n)
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels) / n
        g = np.bincount(inputs, err[rows], size)
        gw = g + decay[0] * m.weights
        gv = decay[1] * m.factors - g[:, None] * m.factors
        for f, x in enumerate(each):
            gv[:, f] += np.bincount(inputs, (err * x)[rows], size)
        gb = err.sum()
        for k, grad in enumerate((gb, gw, gv)):
            seen[k] = seen[k] + grad * grad
        m.bias -= rate * gb / seen[0] ** 0.5
        m.weights -= rate * gw / np.sqrt(seen[1])
        m.factors -= rate * gv / np.sqrt(seen[2])
    m.weights[0], m.factors[0] = 0, 0
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def pair_terms(held: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns of the 0/1 matrix `held` (rows by terms) that belong to a telling pair."""
    n, p = len(y), float(y.sum())
    share = p / n
    of_all, of_toxic = (held.T @ held).astype(np.float64), (held[y > 0].T @ held[y > 0]).astype(np.float64)
    m, a = np.diag(of_all), np.diag(of_toxic)

    def part(rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        enough = rows * min(share, 1 - share) >= EXPECTED
        return np.where(enough, (toxic - rows * share) ** 2 / np.maximum(rows * share * (1 - share), 1e-9), 0.0)

    alone = part(m, a) + part(n - m, p - a)
    together = part(of_all, of_toxic) + part(m[:, None] - of_all, a[:, None] - of_toxic) + part(m[None] - of_all, a[None] - of_toxic)
    together += part(n - m[:, None] - m[None] + of_all, p - a[:, None] - a[None] + of_toxic)
    return np.flatnonzero((together - alone[:, None] - alone[None] > PAIR).any(axis=1))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Machine:
    """The machine of the labelled rows that aren't held out."""
    spark = docs.sparkSession
    base.small_batches(spark)
    rows = labels.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    # limit holds where many rows share a hash; it bounds what is broadcast to a few hundred kB
    sample = rows.orderBy(F.xxhash64(F.lit(8), "id"), "id", "y").limit(max_rows)
    labelled = base.only(docs, "doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("id", "y", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(term_sets(batch.column(2)), pa.list_(pa.int32()))], ["id", "y", "terms"])

    scratch = base.Scratch(spark, "toxicity")
    # one row of an id that is repeated, so that the sample stays bounded
    found = labelled.mapInArrow(terms, "id long, y int, terms array<int>").groupBy("id", "y").agg(F.min("terms").alias("terms"))
    found = scratch.write(found.select("y", "terms"), "terms")
    total = found.agg(F.count("y").alias("n"), F.sum("y").alias("p")).first()
    n, p = total.n, total.p or 0
    counts = found.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.sum("y").cast("double").alias("a"), F.count("y").cast("double").alias("m"))
    counts = scratch.write(counts.where(f"a >= 3 or m >= {HELD}"), "counts")
    a, m = F.col("a"), F.col("m")
    chi2 = n * F.pow(a * n - m * p, 2) / (m * (n - m) * p * (n - p) + 1e-9)
    chosen = counts.where(((a >= 3) & (a * n > m * p)) | (m * p >= EXPECTED * n)).where(chi2 > SINGLE).select("bucket")
    pool = counts.where((m >= HELD) & (m <= 0.95 * n)).orderBy(F.desc(m * (n - m)), "bucket").limit(POOL).select("bucket")
    chosen, pool = (np.sort(np.array([r.bucket for r in x.collect()], np.int32)) for x in (chosen, pool))
    rows = _held_terms(found, np.union1d(chosen, pool)).toArrow()  # of at most max_rows rows, what they hold of a few thousand terms
    scratch.drop("terms", "counts")
    y = rows.column("y").to_numpy().astype(float)
    sets = [x.values.to_numpy() for x in rows.column("terms").combine_chunks()] if len(rows) else []
    if len(pool) and 0 < p < n:
        held = np.zeros((n, len(pool)), np.float32)
        for i, s in enumerate(sets):
            held[i, np.searchsorted(pool, np.intersect1d(s, pool, assume_unique=True))] = 1
        chosen = np.union1d(chosen, pool[pair_terms(held, y)])
    chosen = chosen.astype(np.int32)
    held = [np.searchsorted(chosen, np.intersect1d(s, chosen, assume_unique=True)) for s in sets]
    # the rows that hold a bucket, as a sum of their hashes: equal sums share a place
    sums = np.zeros(len(chosen), np.uint64)
    for i, s in enumerate(held):
        sums[s] += tm.mix(np.full(1, i + 1, np.uint64))
    places = np.unique(sums, return_inverse=True)[1] + 1
    return fit(chosen, places, [np.unique(places[s]) for s in held], y)


def _held_terms(found: DataFrame, buckets: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(x.values.to_numpy(), buckets, assume_unique=True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int32()))], ["y", "terms"])

    return found.mapInArrow(run, "y int, terms array<int>")


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each document's whole text."""
    spark = docs.sparkSession
    base.small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)  # the sample bounds its inputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        keep = m.table()
        for batch in batches:
            sets = list(term_sets(batch.column(1), keep))
            rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            inputs = np.concatenate(sets) if sets else np.zeros(0, int)
            p = 1 / (1 + np.exp(-np.clip(m.raw(rows, inputs, len(sets)), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p, pa.float64())], ["doc_id", "score"])

    return base.only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) of each document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns. The
    scored text travels with its row, so no join follows; a null id is kept as it is."""
    spark = docs.sparkSession
    machine = train(docs, labels)
    base.small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        keep = m.table()
        limit = np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            sets = list(term_sets(batch.column(at), keep))
            rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            raw = m.raw(rows, np.concatenate(sets) if sets else np.zeros(0, int), len(sets))
            yield batch.filter(pa.array(raw < limit))

    return docs.mapInArrow(run, docs.schema)
