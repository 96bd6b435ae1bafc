"""Fuzzy line dedup by MinHash: one line of each component of near-duplicate lines stays.

A line is what stands between line feeds; its shingles are its runs of `width` bytes, lower
cased (A-Z), with runs of white space held as they are. One-permutation MinHash: each
shingle's hash names one of `bands * rows` slots and competes there for the least; an empty
slot takes its right neighbour's value. Each band of `rows` slots is a bucket. Lines of one
bucket are candidates; the exact Jaccard similarity of their shingle sets decides; union-
find over the links, distributed, gives the components, and each component's first line (by
doc_id, then place) stays.

Equal lines (by their lower-cased bytes) stand as one throughout; one pass over the texts
writes each line's key and the postings of the bands. A bucket gives links to
its smallest member, then to one chosen by hash, and every pair that is still in two
components afterwards is examined in blocks of bounded size: by set sizes, then by parity
sketches, whose distance never exceeds the sets' difference, then exactly (inside the block,
or where a line is longer than LONG bytes by a join of the pair with its lines, so that a
group's size is bounded). So no candidate pair between components goes unexamined.

Lines without a word (empty or white space) are layout: they stay, and link with nothing.
A line shorter than a shingle is its own single shingle. Null texts stay null, empty ones
empty; a text that loses all lines becomes empty, its row stays. Rows of one doc_id with
different texts are told apart by a hash of the text (a tie in doc_id and place goes by it);
rows equal in both are one document and share its decisions. Rows with a null doc_id stay as
they are. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm import base, setjoin
from plantlens.llm import textmath as tm

WIDTH, BANDS, ROWS = 7, 12, 4
SHARE = (75, 100)
EMPTY = tm.U(0xFFFFFFFFFFFFFFFF)
CELLS = 1024  # of a line's parity sketch
MANY = 1 << 12  # lines looked at together
LONG, PART = 1 << 10, 20_000  # bytes of a line that is verified inside its blocks, members of a group of blocks


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, start, end) of each line that has a word."""
    feeds = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(offsets[1:], feeds, side="right")])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    ends = np.append(starts[1:] - 1, 0) if len(row) else starts
    ends[last] = offsets[1:][row[last]]
    first = np.searchsorted(row, np.arange(n))
    place = np.arange(len(row)) - first[row]
    full = np.flatnonzero(ends > starts)
    keep = np.zeros(len(row), bool)
    keep[full] = ~tm.SEPARATOR[data[starts[full]]]
    for i in full[~keep[full]].tolist():  # those that begin with white space
        keep[i] = not tm.SEPARATOR[data[starts[i] : ends[i]]].all()
    return row[keep], place[keep], starts[keep], ends[keep]


def shingles(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle, with repeats: those of lines as long as a shingle in
    order, then the others. Lines are in order of their places and don't overlap."""
    long = ends - starts >= width
    of = np.flatnonzero(long)
    edge = np.zeros(max(1, len(h)), np.int8)
    np.add.at(edge, starts[of], 1)
    np.add.at(edge, ends[of] - width + 1, -1)
    inside = np.cumsum(edge, dtype=np.int8).view(bool)
    found = tm.window_hash(h, width)
    rest = np.flatnonzero(~long)
    line = np.concatenate([np.repeat(of, ends[of] - starts[of] - width + 1), rest])
    return line, np.concatenate([found[inside[: len(found)]], tm.span_hash(h, starts[rest], ends[rest])])


def signatures(line: np.ndarray, hashes: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots least hashes; a line's empty slots borrow from the right, round."""
    out = np.full((n, slots), EMPTY, np.uint64)
    slot = hashes & tm.U(0xFFFFFFFF)  # the lower half says the slot, the upper half competes
    slot *= tm.U(slots)
    slot >>= tm.U(32)
    np.minimum.at(out.reshape(-1), line * slots + slot.view(np.int64), hashes)
    gaps = np.flatnonzero((out == EMPTY).any(axis=1))
    if len(gaps):
        part = out[gaps]
        at = np.where(part != EMPTY, np.arange(slots), 2 * slots)
        at = np.concatenate([at, at + slots], axis=1)[:, ::-1]
        near = np.minimum.accumulate(at, axis=1)[:, ::-1][:, :slots]  # the next full slot, beyond the end: round
        out[gaps] = np.take_along_axis(part, near % slots, axis=1)
    return out


def key_of(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of lines: equal for equal lower-cased bytes."""
    return tm.mix(tm.span_hash(h, starts, ends) ^ tm.mix((ends - starts).astype(np.uint64))).view(np.int64)


def key_of(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of lines: equal for equal lower-cased bytes."""
    return tm.mix(tm.span_hash(h, starts, ends) ^ tm.mix((ends - starts).astype(np.uint64))).view(np.int64)


def scan(docs: DataFrame, width: int, bands: int, rows: int, parts: int) -> DataFrame:
    """In one pass over the texts, doc_id, text_key, place, key of each line; and in rows of
    their own (part, postings) the postings of the bands of each batch's distinct lines."""
    base.small_batches(docs.sparkSession)
    names = ["doc_id", "text_key", "place", "key", "part", "postings"]
    longs = pa.int64(), pa.int64(), pa.int32(), pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, keys, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            part, postings = setjoin.pack(np.concatenate(tokens), np.concatenate(sizes), np.concatenate(keys), parts).columns
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(part), t) for t in longs], part, postings], names)

        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()).to_numpy(), batch.column(1).to_numpy()
            for lo, data, offsets in tm.joined(batch.column(2)):
                row, place, starts, ends = lines_of(data, offsets)
                h = tm.prefix_hash(data, fold=True)
                key = key_of(h, starts, ends)
                n = len(key)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + row]), pa.array(texts[lo + row]), pa.array(place.astype(np.int32)), pa.array(key), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
                one = np.sort(np.unique(key, return_index=True)[1])
                starts, ends, key = starts[one], ends[one], key[one]
                line, hashes = shingles(h, starts, ends, width)
                least = signatures(line, hashes, len(starts), bands * rows)
                for b in range(bands):
                    token = np.full(len(starts), b + 1, np.uint64)
                    for r in range(rows):
                        token = tm.mix(token * tm._WORD_BASE + least[:, b * rows + r])
                    tokens.append(token)
                    sizes.append(np.maximum(1, ends - starts - width + 1))
                    keys.append(key)
                held += bands * len(key)
            if held > 1 << 20:
                yield packed()
                tokens, sizes, keys, held = [], [], [], 0
        if held:
            yield packed()

    source = base.only(docs, "doc_id", "text").where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(run, "doc_id long, text_key long, place int, key long, part int, postings binary")


def fetch_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, line of the distinct lines `wanted` (key), read from the texts again."""
    members = docs.sparkSession.sparkContext.broadcast(setjoin.Members.of(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tm.joined(batch.column(0)):
                _, _, starts, ends = lines_of(data, offsets)
                key, one = np.unique(key_of(tm.prefix_hash(data, fold=True), starts, ends), return_index=True)
                held = members.value.holds(key)
                found = [data[a:b].tobytes() for a, b in zip(starts[one[held]].tolist(), ends[one[held]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[held]), pa.array(found, pa.binary())], ["key", "line"])

    found = base.only(docs, "doc_id", "text").where("doc_id is not null").select("text").mapInArrow(run, "key long, line binary")
    return wanted.join(found.groupBy("key").agg(F.first("line").alias("line")), "key")


def sketched(lines: DataFrame, width: int) -> DataFrame:
    """lines (key, line) with n, the number of distinct shingles, and mini, the parity of
    the distinct shingles in each of CELLS cells: two sketches never differ in more cells
    than the sets differ in members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, MANY) for whole in batches for k in range(0, len(whole), MANY)):
            for lo, data, offsets in tm.joined(batch.column(1).cast(pa.string())):
                m = len(offsets) - 1
                line, h = distinct(*shingles(tm.prefix_hash(data, fold=True), offsets[:-1], offsets[1:], width))
                odd = np.bincount(line * CELLS + (h >> tm.U(12) & tm.U(CELLS - 1)).astype(np.int64), minlength=m * CELLS).reshape(m, CELLS) & 1
                mini = np.packbits(odd.astype(np.uint8), axis=1)
                part = batch.slice(lo, m)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.bincount(line, minlength=m)), pa.array([x.tobytes() for x in mini], pa.binary())], ["key", "line", "n", "mini"])

    return lines.mapInArrow(run, "key long, line binary, n long, mini binary")


def distinct(line: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, upper 52 bits of the hash) in order, without repeats; lines are below MANY, so
    that both fit one sorted word."""
    both = np.sort(line.astype(np.uint64) << tm.U(52) | hashes >> tm.U(12))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    return (both >> tm.U(52)).astype(np.int64), both << tm.U(12)


def similar(left: list[bytes], right: list[bytes], width: int, share: tuple[int, int]) -> np.ndarray:
    """Whether the exact Jaccard similarity of each pair's shingle sets reaches the share."""
    num, den = share
    n = len(left)
    ends = np.cumsum([len(x) for x in (*left, *right)])
    starts = np.append(0, ends[:-1])
    h = tm.prefix_hash(np.frombuffer(b"".join((*left, *right)), np.uint8), fold=True)
    line, hashes = distinct(*shingles(h, starts, ends, width))
    total = np.bincount(line % n, minlength=n)
    united = np.bincount(distinct(line % n, hashes)[0], minlength=n)
    return den * (total - united) >= num * united


def similar_pairs(left: list[bytes], right: list[bytes], width: int, share: tuple[int, int]) -> np.ndarray:
    """similar() of any number of pairs, by runs of bounded size."""
    sums = np.cumsum([len(x) + len(y) for x, y in zip(left, right, strict=True)])
    keep, lo = [np.zeros(0, bool)], 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + tm.SEGMENT, side="right")))
        hi = min(hi, lo + MANY // 2)
        keep.append(similar(left[lo:hi], right[lo:hi], width, share))
        lo = hi
    return np.concatenate(keep)


def similar_places(width: int, share: tuple[int, int]):  # noqa: ANN201
    def check(lines: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return similar_pairs(lines.take(pa.array(i)).to_pylist(), lines.take(pa.array(j)).to_pylist(), width, share)

    return check


def verified(pairs: DataFrame, lines: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of keys whose lines' shingle sets reach the share exactly. Sizes and
    sketches spare the exact look at pairs that cannot."""
    num, den = share
    both = pairs
    for side in ("a", "b"):
        both = both.join(lines.select(F.col("key").alias(side), F.col("line").alias(f"l{side}"), F.col("n").alias(f"n{side}"), F.col("mini").alias(f"m{side}")), side)
    both = both.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb")).select("a", "b", "la", "lb", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ma, mb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(batch), -1) for k in (6, 7))
            d = np.bitwise_count(ma ^ mb).sum(axis=1, dtype=np.int64)
            batch = batch.filter(pa.array((num + den) * d <= (den - num) * (batch.column(4).to_numpy() + batch.column(5).to_numpy())))
            keep = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), width, share)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def decide(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, text_key, place, rep_doc_id, rep_place, keep of every line with a word: the
    line of its component that stays, and whether it is this one."""
    scratch = base.Scratch(docs.sparkSession, "lines")
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    scanned = scratch.write(scan(docs, width, bands, rows, max(256, total // 100 * bands // 100_000)), "described")
    described = scanned.where("place is not null").select("doc_id", "text_key", "place", "key")
    found = scratch.write(setjoin.lists(scanned.where("part is not null").select("part", "postings")), "lists")
    stars = found.where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    stars = scratch.write(stars, "stars")
    lines = scratch.write(sketched(fetch_lines(docs, found.select("key").distinct()), width), "candidates")
    first = scratch.write(verified(stars, lines, width, share), "first")
    labels = scratch.write(setjoin.components(scratch, first, "first_"), "labels0")
    mixed = scratch.write(setjoin.unresolved(found, labels), "mixed0")
    chance = scratch.write(verified(setjoin.random_stars(mixed), lines, width, share), "chance")
    labels = scratch.write(setjoin.merged(scratch, labels, chance, "chance_"), "labels1")
    mixed = scratch.write(setjoin.unresolved(mixed.select("token", "key", "size"), labels), "mixed1")
    # a line of up to LONG bytes travels into its blocks; PART of them fill a group
    value = F.when(F.octet_length("line") <= LONG, F.col("line"))
    held = lines.select("key", F.least("n", F.lit(setjoin.SIZE_CAP)).cast("int").alias("size"), "mini", value.alias("value"))
    pairs = setjoin.links_in_blocks(setjoin.in_chunks(mixed, PART).drop("size").join(held, "key"), *share, similar_places(width, share))
    pairs = scratch.write(pairs.select("a", "b", "open"), "pairs")
    links = pairs.where("not open").select("a", "b").union(verified(pairs.where("open").select("a", "b"), lines, width, share))
    links = scratch.write(links, "links")
    labels = scratch.write(setjoin.merged(scratch, labels, links, "all_"), "components")
    scratch.drop("lists", "stars", "candidates", "first", "labels0", "labels1", "mixed0", "mixed1", "chance", "pairs", "links", "chance_over", "all_over")
    located = described.groupBy("key").agg(F.min(F.struct("doc_id", "place", "text_key")).alias("at"), F.count(F.lit(1)).alias("n"))
    named = located.join(labels, "key", "left").where("n > 1 or component is not null").select("key", "at", F.coalesce("component", "key").alias("component"))
    named = scratch.write(named, "named")
    reps = named.groupBy("component").agg(F.min("at").alias("rep"))
    reps = scratch.write(named.join(reps, "component").select("key", "rep"), "reps")
    scratch.drop("named", "components")
    here = F.struct("doc_id", "place", "text_key")
    all_lines = described.join(reps, "key", "left").withColumn("rep", F.coalesce("rep", here))
    return all_lines.select("doc_id", "text_key", "place", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.place").alias("rep_place"), (here == F.col("rep")).alias("keep"))


def decide_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, and the dropped lines with the lines that stay for them."""
    lost = F.when(~F.col("keep"), F.struct("place", "rep_doc_id", "rep_place"))
    found = decide(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("keep").cast("long")).alias("n_kept"), F.sort_array(F.collect_list(lost)).alias("dropped"))
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "dropped")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the lines that go taken out of text, and n_chars, where it is a column,
    the new length."""
    lost = decide(docs).where(~F.col("keep")).groupBy(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).agg(F.collect_set("place").alias("lost_places"))
    lines = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("lost_places", i))
    text = F.when(F.col("lost_places").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    out = docs.join(lost, (docs["doc_id"] == F.col("lost_id")) & (F.xxhash64(docs["text"]) == F.col("lost_key")), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
