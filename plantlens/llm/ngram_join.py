"""N-gram Jaccard join by T-occurrence search.

Every document's set of word shingles queries an inverted index of all sets; documents
whose overlap reaches the number T that the similarity demands are linked. As in DivideSkip
the lists of a query are divided: short lists (tokens that few sets hold) are merged to find
candidates, long ones are only probed by binary search for candidates already found.

On Spark: a counter of bounded width estimates how many sets hold each token. A set's first
n - ceil(0.75 n) + 1 tokens by (estimate, hash) are its short lists; two linked sets share
one of them at least, by the prefix principle, whatever the estimates' errors. A shuffle by
token merges these lists. Each list gives links to its smallest set to verify, not all its
pairs; verified links join their sets into components. In lists whose members are still in
several components every remaining pair is examined, in blocks of bounded size: by its
sizes, then by parity sketches, whose distance never exceeds the sets' difference, then
exactly. So no link between components is lost. These pairs may be as many as the square of
a group's size, but none leaves its task: first the sets that are near another one leave it,
then these sets meet in their blocks, and only links that join two components leave.

Documents with equal sets stand as one set throughout. Null or empty texts and texts
without words have empty sets and are linked with nothing; fewer words than a shingle make
one shingle; other columns are ignored; repeated rows keep a row each; an empty table gives
no rows. Rows of one doc_id with different texts are documents of their own: of a component
the one with the least doc_id, then the least hash of its text, stays. A row with a null
doc_id stays and links nothing; its set's component is its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm import base, setjoin
from plantlens.llm import textmath as tm

WIDTH = 1 << 22  # counters of the tokens' estimated frequency
PIECE = 1 << 20  # expected members of a list, or of each piece of a longer one


# -- the T-occurrence search itself ------------------------------------------------------


def divide_skip(query: np.ndarray, members: list[np.ndarray], share: tuple[int, int], mu: float = 0.02) -> list[int]:
    """Indices of the members m with share[1] * |q & m| >= share[0] * |q | m|. query and
    members are ascending and without repeats."""
    num, den = share
    n = len(query)
    at = [np.searchsorted(query, m) for m in members]
    held = [a[(a < n) & (query[np.minimum(a, n - 1)] == m)] if n else a[:0] for a, m in zip(at, members, strict=True)]
    which = np.repeat(np.arange(len(members)), [len(h) for h in held])
    place = np.concatenate(held) if held else np.zeros(0, int)
    order = np.lexsort((which, place))
    cuts = np.searchsorted(place[order], np.arange(n + 1))
    index = [which[order[a:b]].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    needed = [-(-num * (n + len(m)) // (num + den)) for m in members]
    t = min(needed, default=1)
    longest = max((len(x) for x in index), default=0)
    long = min(t - 1, int(t / (mu * np.log2(longest + 1) + 1))) if longest else 0
    index.sort(key=len)
    short, rest = index[: n - long], index[n - long :]
    out = []
    counts: dict[int, int] = {}
    for m in heapq.merge(*short):
        counts[m] = counts.get(m, 0) + 1
    for m, c in counts.items():
        if c < t - long:
            continue
        left = len(rest)
        for x in reversed(rest):
            if c + left < needed[m]:
                break
            k = bisect_left(x, m)
            c += k < len(x) and x[k] == m
            left -= 1
        if c >= needed[m] and den * c >= num * (n + len(members[m]) - c):
            out.append(m)
    return sorted(out)


def sketch(values: np.ndarray) -> bytes:
    """Parity of the members in each of 512, 2048 or 8192 cells, by the set's size."""
    cells = 512 if len(values) <= 600 else 2048 if len(values) <= 2500 else 8192
    return np.packbits((np.bincount((values & tm.U(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def mini(full: bytes) -> bytes:
    """A sketch folded to 512 cells."""
    return np.bitwise_xor.reduce(np.frombuffer(full, np.uint8).reshape(-1, 64), axis=0).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between sketches, rows of bytes; the longer are folded to the shorter."""
    n = min(a.shape[-1], b.shape[-1])
    a, b = (np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, n), axis=-2) for x in (a, b))
    return np.bitwise_count(a ^ b).sum(axis=-1)


def distances(left: pa.Array, right: pa.Array) -> np.ndarray:
    """apart() of each row's two sketches, for rows of equal lengths at once."""
    sides = []
    for column in (left, right):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        sides.append((np.frombuffer(column.buffers()[2], np.uint8), at[:-1].astype(np.int64), np.diff(at)))
    (x, xs, xn), (y, ys, yn) = sides
    out = np.zeros(len(left), np.int64)
    for a, b in np.unique(np.stack([xn, yn], axis=1), axis=0).tolist():
        rows = np.flatnonzero((xn == a) & (yn == b))
        out[rows] = apart(x[xs[rows, None] + np.arange(a)], y[ys[rows, None] + np.arange(b)])
    return out


def searched(members: Sequence[pa.Scalar], queries: Sequence[pa.Scalar], names: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether each row's set of members reaches the share with its query; rows of one query
    (by its name) that follow each other are one search."""
    keep = np.zeros(len(names), bool)
    cuts = np.append(np.flatnonzero(np.diff(names)) + 1, len(names))
    lo = 0
    for hi in cuts.tolist():
        if lo < hi:
            query = np.frombuffer(queries[lo].as_buffer(), np.uint64)
            keep[[lo + k for k in divide_skip(query, [np.frombuffer(x.as_buffer(), np.uint64) for x in members[lo:hi]], share)]] = True
        lo = hi
    return keep


def by_sketches(share: tuple[int, int]) -> setjoin.Check:
    """A check that the sizes and sketches of sets (values: n, sketch) leave the share possible."""
    num, den = share

    def check(values: pa.StructArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, sketches = values.field("n").to_numpy(), values.field("sketch")
        ok = np.zeros(len(i), bool)
        for lo in range(0, len(i), setjoin.PAIRS):
            a, b = i[lo : lo + setjoin.PAIRS], j[lo : lo + setjoin.PAIRS]
            ok[lo : lo + setjoin.PAIRS] = (num + den) * distances(sketches.take(pa.array(a)), sketches.take(pa.array(b))) <= (den - num) * (n[a] + n[b])
        return ok

    return check


def by_sets(share: tuple[int, int]) -> setjoin.Check:
    """A check that sets (values: n, sketch, tokens) reach the share, by T-occurrence search of
    each second one's set against those of its first ones."""
    near = by_sketches(share)

    def check(values: pa.StructArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = near(values, i, j)
        at = np.flatnonzero(ok)
        at = at[np.argsort(j[at], kind="stable")]
        tokens = values.field("tokens")
        ok[at] = searched([tokens[k] for k in i[at].tolist()], [tokens[k] for k in j[at].tolist()], j[at], share)
        return ok

    return check


# -- the distributed join ----------------------------------------------------------------


def describe(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (doc_id, text_key, n, key, sketch, mini), and rows of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WIDTH, np.int64)
        for batch in batches:
            sets = list(tm.shingle_sets(batch.column(2), width))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((flat >> tm.U(42)).astype(np.int64), minlength=WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([tm.set_key(s) for s in sets], pa.int64()), pa.array(sketches := [sketch(s) for s in sets], pa.binary()), pa.array([mini(x) for x in sketches], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names,
            )
        packed = setjoin.pack_counts(counts)
        n = len(packed)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array([i for i, _ in packed], pa.int32()), pa.array([c for _, c in packed], pa.binary())], names)

    names = ["doc_id", "text_key", "n", "key", "sketch", "mini", "block", "counts"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n long, key long, sketch binary, mini binary, block int, counts binary")


def short_lists(docs: DataFrame, estimates: np.ndarray, parts: int, width: int, share: tuple[int, int]) -> DataFrame:
    """Postings of every set's short lists."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(estimates, 0xFFFFFFFF).astype(np.uint32))  # WIDTH bounds it
    num, den = share
    piece = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate = shared.value
        tokens, sizes, keys, pieces, held, seen = [], [], [], [], 0, set()

        def packed() -> pa.RecordBatch:
            return setjoin.pack(np.concatenate(tokens), np.concatenate(sizes), np.concatenate(keys), parts, np.concatenate(pieces))

        for batch in batches:
            for s in tm.shingle_sets(batch.column(0), width):
                n = len(s)
                key = tm.set_key(s)
                if not n or key in seen:
                    continue
                seen.add(key)
                prefix = n - -(-num * n // den) + 1
                often = estimate[(s >> tm.U(42)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[:prefix]
                tokens.append(s[first])
                pieces.append(often[first] // piece + 1)
                sizes.append(np.full(prefix, n, np.int64))
                keys.append(np.full(prefix, key, np.int64))
                held += prefix
            if held > 1 << 20:
                yield packed()
                tokens, sizes, keys, pieces, held, seen = [], [], [], [], 0, set()
        if held:
            yield packed()

    return base.only(docs, "text").mapInArrow(run, setjoin.POSTINGS)


def fetch_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key, tokens of the sets `wanted` (key, doc_id of one document with that set)."""
    members = docs.sparkSession.sparkContext.broadcast(setjoin.Members.of(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = members.value
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            batch = batch.filter(pa.array(filter_.holds(ids.fill_null(0).to_numpy())))
            if len(batch):
                sets = list(tm.shingle_sets(batch.column(1), width))
                keys = pa.array([tm.set_key(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), keys, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "key", "tokens"])

    found = base.only(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, key long, tokens binary")
    # by both, as repeated rows of one doc_id may hold different texts
    return wanted.join(found, ["doc_id", "key"]).select("key", "tokens").dropDuplicates(["key"])


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, width: int, share: tuple[int, int], scratch: base.Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the share, by T-occurrence search of b's
    set against the sets of its candidates. pairs and known are written tables."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(known.select("key", "doc_id"), "key")
    wanted = scratch.write(wanted, f"{name}_wanted")
    sets = fetch_sets(docs, wanted, width)
    mine = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    both = mine.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = searched(batch.column(2), batch.column(3), batch.column(1).to_numpy(), share)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def near_enough(pairs: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose sizes and sketches leave the similarity possible, and whose shared
    short lists, where they are counted, reach T less the long lists. Of two sets the one
    whose short lists end first has all it shares below that end in the other's short
    lists; it can share no more than its long lists beside these. (One is allowed for, as a
    posting holds 48 bits of a token.)"""
    num, den = share
    both = pairs.join(sketches.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = both.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    if "shared" in pairs.columns:
        t = F.ceil(num * (F.col("na") + F.col("nb")) / (num + den))
        long = F.ceil(num * F.greatest("na", "nb") / den) - 1
        both = both.where(F.col("shared") >= t - long - 1)
    both = both.select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            d = distances(batch.column(4), batch.column(5))
            yield batch.select(["a", "b"]).filter(pa.array((num + den) * d <= (den - num) * total))

    return both.mapInArrow(run, "a long, b long")


def components_of(docs: DataFrame, width: int = 5, share: tuple[int, int] = (75, 100), per_part: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, component_id of each document: two documents link when
    share[1] * intersection >= share[0] * union of their sets of `width`-word shingles."""
    return _components(docs, width, share, per_part).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, width: int, share: tuple[int, int], per_part: int = 100_000) -> DataFrame:
    """components_of, and text_key and the first (doc_id, text_key) of each row's component."""
    spark = docs.sparkSession
    base.small_batches(spark)
    scratch = base.Scratch(spark, "ngram")
    described = scratch.write(describe(docs, width), "described")
    rows = described.where("block is null").select("doc_id", "text_key", "n", "key", "sketch", "mini")
    estimates = setjoin.summed(described.where("block is not null"), WIDTH)
    parts = max(256, int(estimates.sum()) // 4 // per_part)
    found = scratch.write(setjoin.lists(short_lists(docs, estimates, parts, width, share)), "lists")
    labels = _labels(scratch, docs, rows, found, width, share)
    # names: the least doc_id of a component's documents
    named = rows.where("n > 0").groupBy("key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least"))
    named = named.join(labels, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    of = scratch.write(named.join(least, "component").select("key", "first"), "names")
    result = rows.join(of, "key", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "first")
    scratch.drop("lists", "links", "known", "stars", "stars_wanted", "first", "labels0", "mixed0", "tries", "tries_wanted", "chance", "labels1", "mixed1", "groups", "near", "near_wanted", "chance_over", "all_over")
    return result


def _labels(scratch: base.Scratch, docs: DataFrame, rows: DataFrame, found: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    known = rows.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini"))
    known = scratch.write(known, "known")
    sketches = known.select("key", "n", "sketch")
    stars = found.where("key <> leader").groupBy(F.col("key").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    stars = scratch.write(near_enough(stars, sketches, share), "stars")
    first = scratch.write(verified(stars, docs, known, width, share, scratch, "stars"), "first")
    labels = scratch.write(setjoin.components(scratch, first, "first_"), "labels0")
    mixed = scratch.write(setjoin.unresolved(found, labels), "mixed0")
    tries = scratch.write(near_enough(setjoin.random_stars(mixed), sketches, share), "tries")
    chance = scratch.write(verified(tries, docs, known, width, share, scratch, "tries"), "chance")
    labels = scratch.write(setjoin.merged(scratch, labels, chance, "chance_"), "labels1")
    mixed = scratch.write(setjoin.unresolved(mixed.select("token", "key", "size"), labels), "mixed1")
    groups = scratch.write(setjoin.gathered(mixed), "groups")
    looked = known.select("key", "mini", F.struct("n", "sketch").alias("value"))
    near = setjoin.near_members(setjoin.in_chunks(groups).join(looked, "key"), *share, by_sketches(share))
    near = near.join(groups, ["token", "key"]).join(known.select("key", (8 * F.col("n")).alias("bytes")), "key")
    near = scratch.write(near, "near")
    wanted = scratch.write(near.select("key").distinct().join(known.select("key", "doc_id"), "key"), "near_wanted")
    sets = fetch_sets(docs, wanted, width).join(known, "key").select("key", "mini", F.struct("n", "sketch", "tokens").alias("value"))
    last = scratch.write(setjoin.links_in_blocks(setjoin.in_chunks(near).join(sets, "key"), *share, by_sets(share)), "links")
    return setjoin.merged(scratch, labels, last, "all_")


def first_of_each(docs: DataFrame, width: int = 5, share: tuple[int, int] = (75, 100)) -> DataFrame:
    """The rows of docs but those in whose component another document comes first. Rows with
    a null doc_id stay; rows equal in doc_id and text are one document and share its fate."""
    found = _components(docs, width, share).where("n_shingles > 0 and (doc_id <> first.doc_id or text_key <> first.text_key)")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_key")), "left_anti")
