"""Quality by co-training: two classifiers on separate views of a document teach each other.

The content view sees hashed words of the text and shares of kinds of characters; the
metadata view sees source, language and lengths. Both are logistic regressions. In each
round each labels all unlabelled documents, and those it is most confident of join the
other's training rows, in the proportion of the classes. At the end each view is calibrated
on labelled rows that neither was trained on (Platt's scaling), the calibrated log-odds are
combined by their trust there, and every document is scored.

Inputs are derived once and written. The views are fitted on a bounded sample of labelled
rows, at most `max_labelled` by a hash, a third of them held back for calibration, and on
what they teach each other: in each round both score every other document of the corpus,
and each hands the other its `per_round` surest ones. Documents of equal inputs are one in
this choice; ties go by a hash of the inputs. Scoring covers
every document. Nulls: a null text is empty; null source, language or lengths are values of
their own; labels without quality or doc_id are left out. With labels of one class only, or
none, the score is the share of that class (0.5 without labels). Repeated rows are scored
each; equal rows have equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm import base
from plantlens.llm import textmath as tm

WORDS, META = 1 << 15, 1 << 10
KINDS = np.full(256, 4, np.uint8)  # letters, digits, white space, punctuation, others
for _kind, _of in enumerate((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):
    KINDS[list(_of)] = _kind
#: The columns of the metadata view.
METADATA = ("source", "lang", "n_chars")


def content_inputs(data: np.ndarray) -> np.ndarray:
    """Distinct inputs of one text: hashed words, and ranges of shares and of mean lengths."""
    found, n = [], 0
    for piece, at in tm.segments(data, np.array([0, len(data)])):
        starts, ends = tm.word_spans(piece, at)
        found.append((tm.span_hash(tm.prefix_hash(piece, fold=True), starts, ends) % tm.U(WORDS)).astype(np.int64))
        n += len(starts)
    words = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    share = np.bincount(KINDS[data], minlength=5) / max(1, len(data))
    ranges = [*np.minimum(15, np.ceil(share * 32)), min(15, len(data) / max(1, n)), np.ceil(15 * len(words) / max(1, n))]
    return np.append(words, WORDS + 16 * np.arange(len(ranges)) + np.array(ranges).astype(np.int64))


CONTENT = WORDS + 16 * 8


def metadata_inputs(values: tuple, feeds: int) -> np.ndarray:
    """Inputs of one row's source, language, length and number of lines."""
    source, lang, n_chars = values
    length = -1 if n_chars is None or n_chars < 0 else int(n_chars).bit_length()
    keys = [f"s:{source}", f"l:{lang}", f"n:{length}", f"f:{int(feeds).bit_length()}", f"ln:{lang}:{length}", f"sl:{source}:{lang}"]
    return np.unique([_place(k) for k in keys])


def _place(key: str) -> int:
    data = np.frombuffer(key.encode(), np.uint8)
    return int(tm.span_hash(tm.prefix_hash(data, fold=False), np.array([0]), np.array([len(data)]))[0] % tm.U(META))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def raw_of(self, inputs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bias plus the inputs' weights over the root of their number, for rows of n inputs."""
        rows = np.repeat(np.arange(len(n)), n)
        return self.bias + np.bincount(rows, self.weights[inputs], len(n)) / np.sqrt(np.maximum(n, 1))

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.raw_of(np.concatenate(sets), np.array([len(s) for s in sets])) if sets else np.zeros(0)

    def calibrated(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.scale[0] * self.raw(sets) + self.scale[1]


def fit(sets: list[np.ndarray], y: np.ndarray, size: int, epochs: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Linear:
    m = Linear(np.zeros(size))
    n = np.array([len(s) for s in sets])
    rows, inputs = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    root = 1 / np.sqrt(np.maximum(n, 1))
    seen, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(m.bias + np.bincount(rows, m.weights[inputs], len(sets)) * root, -30, 30)))
        err = (p - y) / len(y)
        g = np.bincount(inputs, (err * root)[rows], size) + decay * m.weights / len(y)
        seen += g * g
        m.weights -= rate * g / np.sqrt(seen)
        gb = err.sum()
        seen_b += gb * gb
        m.bias -= rate * gb / seen_b**0.5
    return m


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of calibrated log-odds, by Newton's steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * raw).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


@dataclass
class CoTrained:
    content: Linear
    metadata: Linear
    share: float  # of good documents among the labels
    trust: tuple[float, float] = (1.0, 1.0)
    exchanged: list[int] = field(default_factory=list)

    def combine(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Probability from both calibrated log-odds, each counted against the prior."""
        prior = np.log(self.share / (1 - self.share))
        odds = prior + self.trust[0] * (content - prior) + self.trust[1] * (metadata - prior)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


Pair = tuple[np.ndarray, np.ndarray]  # content inputs, metadata inputs
#: (views, keys taken, surest bad and good ones wanted) to (view, label, key, inputs) of the chosen.
Pick = Callable[[list[Linear], set[int], int, int], list[tuple[int, float, int, Pair]]]


def co_train(labelled: list[Pair], y: np.ndarray, pick: Pick, rounds: int = 4, per_round: int = 150) -> CoTrained:
    """The model of the labelled documents and of those that `pick` finds in each round."""
    share = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    out = CoTrained(Linear(np.zeros(CONTENT)), Linear(np.zeros(META)), share)
    back = np.arange(len(y)) % 3 == 0
    if len(y) < 6 or min(y[~back].sum(), (1 - y[~back]).sum(), y[back].sum(), (1 - y[back]).sum()) < 1:
        prior = float(np.log(share / (1 - share)))
        out.content.bias = out.metadata.bias = prior
        return out
    sizes = (CONTENT, META)
    rows = [[x[v] for x, b in zip(labelled, back, strict=True) if not b] for v in (0, 1)]
    targets = [y[~back].tolist() for _ in (0, 1)]
    views = [fit(rows[v], np.array(targets[v]), sizes[v]) for v in (0, 1)]
    good, bad = max(1, round(share * per_round)), max(1, round((1 - share) * per_round))
    taken: set[int] = set()
    for _ in range(rounds):
        found = [x for x in pick(views, taken, bad, good) if x[2] not in taken]
        taken |= {key for _, _, key, _ in found}
        for v, label, _, inputs in found:
            rows[1 - v].append(inputs[1 - v])
            targets[1 - v].append(label)
        out.exchanged += [sum(x[0] == v for x in found) for v in (0, 1)]
        if not found:
            break
        views = [fit(rows[v], np.array(targets[v]), sizes[v]) for v in (0, 1)]
    held = [[x[v] for x, b in zip(labelled, back, strict=True) if b] for v in (0, 1)]
    trust = []
    prior = float(np.log(share / (1 - share)))
    for v in (0, 1):
        raw = views[v].raw(held[v])
        views[v].scale = platt(raw, y[back])
        # how far the view's log-odds beat the prior's, 0 to 1, by the share of bits they save
        p = 1 / (1 + np.exp(-np.clip(views[v].calibrated(held[v]), -30, 30)))
        bits = -np.mean(y[back] * np.log(p + 1e-12) + (1 - y[back]) * np.log(1 - p + 1e-12))
        base_bits = -np.mean(y[back] * np.log(share) + (1 - y[back]) * np.log(1 - share))
        trust.append(float(np.clip(1 - bits / base_bits, 0, 1)))
    total = sum(trust) or 1.0
    out.content, out.metadata, out.trust = views[0], views[1], (trust[0] / total, trust[1] / total) if sum(trust) else (0.0, 0.0)
    return out


def _inputs(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    text = [x for x in tm.texts(batch.column(batch.schema.get_field_index("text")))]
    meta = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in METADATA], strict=True)
    return [content_inputs(x) for x in text], [metadata_inputs(m, int((x == 10).sum())) for m, x in zip(meta, text, strict=True)]


def derive(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the inputs), content, meta (16-bit inputs) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[x.astype("<u2").tobytes() for x in view] for view in _inputs(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(x, pa.binary()) for x in both]], ["doc_id", "content", "meta"])

    found = base.only(docs, "doc_id", "text", *METADATA).mapInArrow(run, "doc_id long, content binary, meta binary")
    return found.select("doc_id", F.xxhash64("content", "meta").alias("key"), "content", "meta")


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' inputs, and the number of each row's."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    data = column.buffers()[2]
    return (np.frombuffer(data, "<u2") if data is not None else np.zeros(0, "<u2"))[at[0] : at[-1]], np.diff(at)


def picker(inputs: DataFrame, sample: set[int | None]) -> Pick:
    """Picks from the written `inputs`, without the ids of the labelled sample."""
    spark = inputs.sparkSession
    schema = "view int, label int, raw double, key long, content binary, meta binary"

    def pick(views: list[Linear], taken: set[int], bad: int, good: int) -> list[tuple[int, float, int, Pair]]:
        # views have a fixed size; the sample and the taken are bounded by max_labelled, rounds and per_round
        shared = spark.sparkContext.broadcast((views, np.array(sorted(i for i in sample if i is not None), np.int64), np.array(sorted(taken), np.int64)))

        def surest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, known, used = shared.value
            best: dict[tuple[int, int], pa.Table] = {}  # a task's surest so far: (raw, key, content, meta)
            for batch in batches:
                ids, key = batch.column(0), batch.column(1).to_numpy()
                free = ~np.isin(ids.fill_null(0).to_numpy(), known) | ids.is_null().to_numpy(zero_copy_only=False)
                free &= ~np.isin(key, used)
                for v in (0, 1):
                    raw = models[v].raw_of(*_sets(batch.column(2 + v)))
                    for label, n, side in ((0, bad, raw), (1, good, -raw)):
                        at = np.flatnonzero(free & (side < 0))
                        at = at[np.lexsort((key[at], side[at]))]
                        at = at[np.sort(np.unique(key[at], return_index=True)[1])][:n]
                        more = pa.table([pa.array(side[at]), *[batch.column(k).take(pa.array(at)) for k in (1, 2, 3)]], names=["raw", "key", "content", "meta"])
                        if (v, label) in best:
                            more = pa.concat_tables([best[v, label], more])
                            raws, keys = more.column("raw").to_numpy(), more.column("key").to_numpy()
                            order = np.lexsort((keys, raws))
                            more = more.take(pa.array(order[np.sort(np.unique(keys[order], return_index=True)[1])][:n]))
                        best[v, label] = more
            for (v, label), rows in best.items():
                one = rows.add_column(0, "view", pa.array(np.full(len(rows), v, np.int32))).add_column(1, "label", pa.array(np.full(len(rows), label, np.int32)))
                yield from one.combine_chunks().to_batches()

        # by key first, so that equal inputs are one and the last choice is among few rows of each partition
        each = inputs.mapInArrow(surest, schema).groupBy("view", "label", "key").agg(F.min("raw").alias("raw"), F.first("content").alias("content"), F.first("meta").alias("meta"))
        ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("view", "label").orderBy("raw", "key")))
        found = ranked.where(F.col("rank") <= F.when(F.col("label") == 0, bad).otherwise(good)).where(F.col("rank") <= max(bad, good))
        got = sorted(found.collect(), key=lambda r: (r.view, r.label, r.raw, r.key))  # 2 * (bad + good) rows at most
        once, out = set(), []
        for r in got:  # a document chosen by both views teaches for the first
            if r.key not in once:
                once.add(r.key)
                out.append((r.view, float(r.label), r.key, _pair(r)))
        return out

    return pick


def _pair(row) -> Pair:
    return np.frombuffer(row.content, "<u2").astype(np.int64), np.frombuffer(row.meta, "<u2").astype(np.int64)


def train(inputs: DataFrame, labels: DataFrame, max_labelled: int = 3000) -> CoTrained:
    """The model of what derive() gave, written, and of the labels."""
    rows = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).cast("double").alias("y")).where("id is not null and y is not null").distinct()
    sample = rows.orderBy(F.xxhash64(F.lit(1), "id"), "id", "y").limit(max_labelled)
    # max_labelled bounds what is broadcast and, as repeated rows count once, what is collected
    mine = inputs.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min(F.struct("key", "content", "meta")).alias("one")).select("doc_id", "y", "one.*")
    got = sorted(mine.collect(), key=lambda r: (r.doc_id, r.y))
    return co_train([_pair(r) for r in got], np.array([r.y for r in got]), picker(inputs, {r.doc_id for r in got}))


def score_documents(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """doc_id, content_score, metadata_score, score (0 to 1, higher: better), keep."""
    spark = docs.sparkSession
    base.small_batches(spark)
    inputs = base.Scratch(spark, "quality").write(derive(docs), "inputs")
    shared = spark.sparkContext.broadcast(train(inputs, labels))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            a, b = (view.scale[0] * view.raw_of(*_sets(batch.column(k))) + view.scale[1] for k, view in ((1, m.content), (2, m.metadata)))
            each = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (a, b)]
            p = m.combine(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.float64()) for x in (*each, p)], pa.array(p >= keep_from)], ["doc_id", "content_score", "metadata_score", "score", "keep"])

    return inputs.select("doc_id", "content", "meta").mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double, keep boolean")
