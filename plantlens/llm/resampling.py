"""Importance resampling towards a target distribution, by a dictionary of distinct features.

A text's features are its runs of 1 to `longest` consecutive words (`[0-9a-z]` and what isn't
ASCII, A-Z lower-cased), joined by one space, repeats counted. A feature's bucket is the crc32 of
its UTF-8 bytes modulo `buckets`; a bucket's gain is floor(1000 ln) of its smoothed share of the
target's features over that of the corpus's. A document's weight is the sum of its features'
gains; adding Gumbel noise from a hash of its id and taking the highest scores draws documents
without replacement, as likely as their weights say.

On Spark: one pass counts features by block (a task's run of documents with up to BLOCK bytes of
text, or one longer document). It writes each block's distinct feature strings with their counts,
and its documents' counts by place in the block's list. Summing the strings over all blocks gives
the dictionary; each distinct string is hashed once there; buckets are sums over it. Gains go back
from the dictionary to the blocks' lists by a join on the string, where a frequent word has a row
for each block and not for each document, and then to the blocks' documents by a join on the
block. The draw sorts by ranges of the score; a row's rank is its place in its range and the rows
before it, so that no task sees all rows.

Null and empty texts have no feature and weight 0. Rows with a null doc_id have a weight, but no
score and no rank, and don't count among the eligible. Repeated rows keep a row each; rows equal
in score and doc_id rank by weight and length, then in any order, as what is returned of them is
equal. An empty corpus gives no rows; an empty target has T = 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm import base
from plantlens.llm import textmath as tm

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
BLOCK = 8 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Counter:
    """Distinct features of the documents of a block, and each document's counts of them."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.totals: list[int] = []
        self.n: list[int] = []  # distinct features by document
        self.places: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.known: dict[bytes, int] = {}
        self.sums: np.ndarray = np.zeros(0, np.int64)
        self.size = 0

    def add(self, ids: list[int | None], data: np.ndarray, offsets: np.ndarray, longest: int) -> None:
        text = data.tobytes().translate(_LOWER)
        starts, ends = tm.word_spans(data, offsets, tm.TERM_SEPARATOR)
        row = np.searchsorted(offsets, starts, side="right") - 1
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        known, found, rows = self.known, [], []
        for n in range(1, longest + 1):
            runs = words if n == 1 else [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
            place = np.fromiter((known.setdefault(x, len(known)) for x in runs), np.int64, len(runs))
            same = row[: len(runs)] == row[n - 1 :]  # a run doesn't leave its document
            found.append(place[same])
            rows.append(row[: len(runs)][same])
        place, of = np.concatenate(found), np.concatenate(rows)
        pair, times = np.unique(of << 40 | place, return_counts=True)
        of, place = pair >> 40, pair & ((1 << 40) - 1)
        m = len(offsets) - 1
        self.ids += ids
        self.totals += np.bincount(of, times, m).astype(np.int64).tolist()
        self.n += np.bincount(of, minlength=m).tolist()
        self.places.append(place)
        self.times.append(times)
        self.sums = np.append(self.sums, np.zeros(len(known) - len(self.sums), np.int64))
        np.add.at(self.sums, place, times)
        self.size += len(data)

    def features(self) -> tuple[list[bytes], np.ndarray]:
        """The features that a document has, and their counts; others keep a place with none."""
        return list(self.known), self.sums

    def counts(self) -> bytes:
        return zlib.compress(np.concatenate([np.concatenate(self.places), np.concatenate(self.times)]).astype("<u4").tobytes(), 1)


def counted(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Rows of two kinds: (block, place, feature, n) for each distinct feature of a block, and
    (block, ids, totals, sizes, counts) for the block's documents."""
    base.small_batches(texts.sparkSession)
    names = ["block", "place", "feature", "n", "ids", "totals", "sizes", "counts"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def rows(size: int, **held: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held.get(c, pa.nulls(size, t)) for c, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, Counter()

        def closed() -> Iterator[pa.RecordBatch]:
            features, n = held.features()
            kept = np.flatnonzero(n)
            for lo in range(0, len(kept), 1 << 16):
                at = kept[lo : lo + (1 << 16)]
                yield rows(len(at), block=pa.array(np.full(len(at), block)), place=pa.array(at, pa.int32()), feature=pa.array([features[k].decode() for k in at.tolist()], pa.string()), n=pa.array(n[at]))
            yield rows(1, block=pa.array([block]), ids=pa.array([held.ids], types[4]), totals=pa.array([held.totals], types[5]), sizes=pa.array([held.n], types[6]), counts=pa.array([held.counts()], types[7]))

        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            for lo, data, offsets in tm.joined(batch.column(1)):
                held.add(ids[lo : lo + len(offsets) - 1], data, offsets, longest)
                if held.size > BLOCK or len(held.ids) > 1 << 16:
                    yield from closed()
                    block, held = block + 1, Counter()
        if held.ids:
            yield from closed()

    return texts.mapInArrow(run, "block long, place int, feature string, n long, ids array<long>, totals array<long>, sizes array<long>, counts binary")


def dictionary(features: DataFrame, buckets: int) -> DataFrame:
    """feature, bucket, n of each distinct feature of (feature, n), each hashed once."""
    total = features.groupBy("feature").agg(F.sum("n").alias("n"))
    return total.select("feature", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"), "n")


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket, from the two dictionaries."""
    by = lambda d, name: d.groupBy("bucket").agg(F.sum("n").alias(name))
    all_s, all_t = (d.agg(F.sum("n").alias("n")).first().n or 0 for d in (corpus, target))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    joined = every.join(by(corpus, "s"), "bucket", "left").join(by(target, "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    share = (t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets))
    return joined.select("bucket", F.floor(1000 * F.ln(share)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight of each document against the texts of target."""
    scratch = base.Scratch(docs.sparkSession, "resampling")
    blocks = scratch.write(counted(base.only(docs, "doc_id", "text"), longest), "blocks")
    goal = counted(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text")), longest)
    features = blocks.where("place is not null").select("block", "place", "feature", "n")
    known = scratch.write(dictionary(features, buckets), "dictionary")
    goal = scratch.write(dictionary(goal.where("place is not null"), buckets), "target")
    gain = scratch.write(gains(known, goal, buckets), "gains")  # `buckets` rows
    valued = known.join(F.broadcast(gain), "bucket").select("feature", "gain")
    lists = features.join(valued, "feature").groupBy("block").agg(F.collect_list(F.struct("place", "gain")).alias("list"))  # a block's features bound it
    documents = blocks.where("ids is not null").select("block", "ids", "totals", "sizes", "counts").join(lists, "block", "left")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                _, ids, totals, sizes, counts, found = (c[k] for c in batch.columns)
                flat = np.frombuffer(zlib.decompress(counts.as_py()), "<u4").reshape(2, -1)
                gain = np.zeros(int(flat[0].max(initial=0)) + 1, np.int64)
                if found.is_valid:
                    gain[found.values.field(0).to_numpy()] = found.values.field(1).to_numpy()
                sums = np.append(0, np.cumsum(gain[flat[0]] * flat[1].astype(np.int64)))
                ends = np.cumsum(sizes.values.to_numpy())
                weight = sums[ends] - sums[np.append(0, ends[:-1])]
                yield pa.RecordBatch.from_arrays([ids.values, totals.values, pa.array(weight)], ["doc_id", "n_features", "weight"])

    return documents.mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(seed: int) -> F.Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def drawn(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed (doc_id, n_features, weight) with score and rank: 1, 2, 3 of the `percent` of the
    documents with at least least_words words that score highest; null for the others. (With
    runs of one word, n_features is the number of words.)"""
    spark = weighed.sparkSession
    scratch = base.Scratch(spark, "drawn")
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + noise(seed)), "scored")
    open_ = (F.col("n_features") >= least_words) & F.col("doc_id").isNotNull()
    n = scored.where(open_).count()
    order = [F.desc("score"), F.col("doc_id"), F.col("weight"), F.col("n_features")]
    ranged = scored.where(open_).repartitionByRange(base.parts_for(spark, n, 1_000_000), *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranged")  # the ranges are sampled; written, so that they are dealt once
    before, at = {}, 0
    for r in sorted(ranged.groupBy("part").count().collect()):  # a row for each range
        before[r[0]], at = at, at + r[1]
    start = spark.createDataFrame(sorted(before.items()), "part int, before long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranged.withColumn("inside", inside).join(F.broadcast(start), "part").withColumn("rank", F.col("before") + F.col("inside"))
    most = n * percent // 100
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    rest = scored.where(~F.coalesce(open_, F.lit(False))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.union(rest)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ranked ones are drawn."""
    if longest > 1:
        raise ValueError("least_words counts words, which are the features of runs of one word")
    return drawn(weights(docs, target, buckets, longest), percent, least_words, seed)
