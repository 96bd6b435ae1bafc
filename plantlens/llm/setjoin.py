"""Parts shared by the operators that link sets by common tokens.

A posting is 16 bytes: a token's upper 48 bits with a size in the lower 16 (sizes beyond
are held at 65,535), and the 64-bit key of the set. Map tasks pack postings by part of the
token space, so that Spark shuffles a few large values in place of one row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm import textmath as tm
from plantlens.llm.base import Scratch

POSTINGS = "part int, postings binary"
BLOCK = 1 << 14
SIZE_CAP = (1 << 16) - 1
#: Lists longer than this are worked on in chunks of this many members.
CHUNK = 1 << 11
#: Lists of members with more bytes than this are worked on in chunks of about as many.
SPACE = 8 << 20
#: Pairs whose values are compared at once.
PAIRS = 1 << 12


# -- counters of bounded width, summed over all tasks ------------------------------------


def pack_counts(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """(block, compressed 16-bit counts) of the blocks that hold any."""
    blocks = np.minimum(counts, SIZE_CAP).astype("<u2").reshape(-1, BLOCK)
    return [(i, zlib.compress(blocks[i].tobytes(), 1)) for i in np.flatnonzero(blocks.any(axis=1)).tolist()]


def summed(df: DataFrame, width: int) -> np.ndarray:
    """The sum of the counters (block int, counts binary) of all rows: `width` values."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), "<u2")
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})

    out = np.zeros((width // BLOCK, BLOCK), np.int64)
    for row in df.select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[row.block] = np.frombuffer(zlib.decompress(row.counts), "<u4")
    return out.reshape(-1)


class Members:
    """A filter of fixed width over 64-bit keys: no false negatives. It only spares work
    before an exact join, so a full one costs time and no result."""

    WIDTH = 1 << 24
    BLOCKS = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, df: DataFrame, key: str) -> Members:
        names = ["block", "bits"]

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(cls.WIDTH, np.uint8)
            for batch in batches:
                seen[cls.place(batch.column(0).drop_null().to_numpy())] = 1
            blocks = np.packbits(seen).reshape(cls.BLOCKS, -1)
            held = np.flatnonzero(blocks.any(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in held], pa.binary())], names)

        def either(group: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in group.column("bits")])
            return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

        out = np.zeros((cls.BLOCKS, cls.WIDTH // 8 // cls.BLOCKS), np.uint8)
        for row in df.select(key).coalesce(64).mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary").collect():
            out[row.block] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
        return cls(out.reshape(-1))

    @classmethod
    def place(cls, keys: np.ndarray) -> np.ndarray:
        return (tm.mix(keys.astype(np.int64).view(np.uint64)) % tm.U(cls.WIDTH)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


# -- postings and lists ------------------------------------------------------------------


def pack(tokens: np.ndarray, sizes: np.ndarray, keys: np.ndarray, parts: int, pieces: np.ndarray | None = None) -> pa.RecordBatch:
    """Postings by part, without repeats. A token is split over `pieces` parts by a hash of
    the key; what belongs to a split token has a part below 0."""
    head = (tokens & ~tm.U(SIZE_CAP)) | np.minimum(sizes, SIZE_CAP).astype(np.uint64)
    part = (tm.mix(tokens >> tm.U(16)) % tm.U(parts)).astype(np.int32)
    if pieces is not None and (split := pieces > 1).any():
        which = tm.mix(keys[split].view(np.uint64)) % pieces[split].astype(np.uint64)
        part[split] = -1 - (tm.mix((tokens[split] >> tm.U(16)) + tm.mix(which)) % tm.U(parts)).astype(np.int32)
    order = np.lexsort((head, part))
    head, keys, part = head[order], keys[order], part[order]
    if len(head) > 1:
        new = np.append(True, (head[1:] != head[:-1]) | (keys[1:] != keys[:-1]))
        head, keys, part = head[new], keys[new], part[new]
    values = np.stack([head, keys.view(np.uint64)], axis=1)
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts = np.append(0, cuts) if len(part) else np.zeros(0, int)
    ends = np.append(cuts, len(part)) if len(part) else starts
    blobs = [values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(blobs, pa.binary())], ["part", "postings"])


def lists(postings: DataFrame) -> DataFrame:
    """token, key, size, leader of every posting whose token has two keys or more; the
    leader is the list's smallest set (by size, then key). Each piece of a split list has a
    leader of its own, and is kept even with one key."""

    def find(group: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("postings")]).reshape(-1, 2)
        head, keys = values[:, 0], values[:, 1].view(np.int64)
        order = np.lexsort((keys, head))
        head, keys = head[order], keys[order]
        new = np.append(True, (head[1:] != head[:-1]) | (keys[1:] != keys[:-1]))
        head, keys = head[new], keys[new]
        token = head >> tm.U(16)
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.diff(np.append(starts, len(token)))
        of = np.repeat(np.arange(len(starts)), n)
        keep = (n[of] > 1) | (group.column("part")[0].as_py() < 0)
        leader = keys[starts][of]
        return pa.table({
            "token": pa.array(token[keep].astype(np.int64)), "key": pa.array(keys[keep]),
            "size": pa.array((head[keep] & tm.U(SIZE_CAP)).astype(np.int32)), "leader": pa.array(leader[keep]),
        })

    return postings.groupBy("part").applyInArrow(find, "token long, key long, size int, leader long")


# -- connected components ----------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """key, component (its least key) of every key that has an edge (a, b), by alternating
    large and small stars, until every edge ends at a root. Hubs are joined, never gathered;
    each round is written."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.write(edges, f"{name}0")

    def ended() -> bool:  # each u has one v, and no v is a u
        ends = edges.select("u", F.lit(1).alias("one"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("u").agg(F.sum("one").alias("one"), F.max("root").alias("root")).where("one > 1 or (one = 1 and root = 1)").isEmpty()

    for i in range(1, 60):
        if ended():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below has two plain shuffles and Spark can split hubs
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}m{i}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.write(large, f"{name}l{i}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.write(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}", f"{name}m{i}", f"{name}l{i}")
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("component")).union(roots.select(F.col("u").alias("key"), F.col("u").alias("component")))


def merged(scratch: Scratch, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels (key, component) after more links (a, b): only components are joined, so that
    the rounds work on what the new links touch. labels is a written table."""
    for side in ("a", "b"):
        of = labels.select(F.col("key").alias(side), F.col("component").alias(f"of_{side}"))
        links = links.join(of, side, "left")
    ends = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    over = scratch.write(components(scratch, ends, name), f"{name}over")
    to = over.select(F.col("key").alias("component"), F.col("component").alias("to"))
    old = labels.join(to, "component", "left").select("key", F.coalesce("to", "component").alias("component"))
    return old.union(over.join(labels, "key", "left_anti"))


def unresolved(found: DataFrame, labels: DataFrame) -> DataFrame:
    """token, key, size, component of the lists whose members aren't all in one component.
    Lists of the same members are one, under the least of their tokens."""
    labelled = found.select("token", "key", "size").join(labels, "key", "left").select("token", "key", "size", F.coalesce("component", "key").alias("component"))
    mixed = labelled.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    ).where("lo <> hi")
    return labelled.join(mixed.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"), "token")


def random_stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each member of a mixed list with the list's leader, where that is of
    another component. Leaders are chosen by a hash of token and key, so that the members of
    a dense group meet many others, and few pairs are left to examine one by one."""
    leader = members.groupBy("token").agg(F.min_by(F.struct("key", "component"), F.xxhash64("token", "key")).alias("leader"))
    pairs = members.join(leader, "token").where("component <> leader.component")
    return pairs.select(F.greatest("key", "leader.key").alias("a"), F.least("key", "leader.key").alias("b")).distinct()


def gathered(members: DataFrame) -> DataFrame:
    """members (token, key, size, component) of mixed lists, with lists put together under the
    key of theirs that has the least hash: lists that share most of their members mostly share
    that one. A set that is in many such lists stands in their group once."""
    least = members.groupBy("token").agg(F.min_by("key", F.xxhash64("key")).alias("group"))
    return members.join(least, "token").groupBy(F.col("group").alias("token"), "key").agg(F.first("size").alias("size"), F.first("component").alias("component"))


def in_chunks(members: DataFrame, per_part: int = 50_000) -> DataFrame:
    """members (token, key and what else they have; a written table) with block, two (whether the
    block is a pair of chunks), mine and part. A list of up to CHUNK members is one block; a
    longer one is cut by a hash of the key, and each pair of its chunks is a block, so that every
    two members meet in a block of bounded size. A part gathers whole blocks of about per_part
    members, copies counted. Members with bytes are cut and gathered by SPACE of these too."""
    space = F.col("bytes") if "bytes" in members.columns else F.lit(0)
    n = members.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(space).alias("space"))
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("space") / SPACE)).cast("int")
    copies = n.agg(F.sum(F.col("n") * chunks).alias("n"), F.sum(F.col("space") * chunks).alias("space")).first()
    parts = max(64, (copies.n or 0) // per_part, (copies.space or 0) // SPACE)
    mine = F.pmod(F.xxhash64("key", "token"), F.col("chunks")).cast("int")
    held = [c for c in members.columns if c not in ("token", "bytes")]
    block = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))
    return (
        members.join(n.select("token", chunks.alias("chunks")).where("chunks > 1"), "token", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*held, F.col("token").alias("list"), "mine", (F.col("mine") != F.col("other")).alias("two"), block.alias("block"))
        .withColumn("part", F.pmod(F.col("block"), F.lit(parts)).cast("int"))
    )


def _near(group: pa.Table, num: int, den: int) -> tuple[dict[str, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The columns of a part in order of its blocks, with their old places (order), and the places
    (i, j) of its near pairs, some at a time: members of one block and of different components
    whose sizes, and whose parity sketches of equal length (mini), allow a similarity of num / den."""
    columns = {c: group.column(c).to_numpy() for c in ("key", "size", "component", "mine", "two", "block", "list")}
    order = np.lexsort((columns["component"], columns["block"]))
    columns = {c: x[order] for c, x in columns.items()} | {"order": order}
    size, component, mine, two, block = (columns[c] for c in ("size", "component", "mine", "two", "block"))
    sketch = np.frombuffer(b"".join(group.column("mini").to_pylist()), np.uint64).reshape(len(order), -1)[order]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(starts[1:], len(block))
        runs = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (component[1:] != component[:-1])))
        behind = np.repeat(np.append(runs[1:], len(block)), np.diff(np.append(runs, len(block))))  # where each one's component ends
        after = np.repeat(ends, ends - starts) - behind  # members of later components in its block
        lo, sums = 0, np.append(0, np.cumsum(after))
        most = (1 << 23) // sketch.shape[1]  # pairs at once
        while lo < len(block):
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + most, side="right")) - 1)
            n = after[lo:hi]
            i = np.repeat(np.arange(lo, hi), n)
            j = np.repeat(behind[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ok = den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])
            ok &= ~two[i] | (mine[i] != mine[j])
            i, j = i[ok], j[ok]
            if len(i):
                d = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                capped = np.maximum(size[i], size[j]) >= SIZE_CAP
                ok = capped | ((num + den) * d <= (den - num) * (size[i].astype(np.int64) + size[j]))
                yield i[ok], j[ok]
            lo = hi

    return columns, pairs()


Check = Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]


def near_members(members: DataFrame, num: int, den: int, check: Check) -> DataFrame:
    """token, key of the members in blocks that make a near pair which passes the check of (the
    part's values, places, places): a row for each member at most, not one for each pair."""

    def run(group: pa.Table) -> pa.Table:
        columns, pairs = _near(group, num, den)
        values, order = group.column("value").combine_chunks(), columns["order"]
        hit = np.zeros(len(order), bool)
        for i, j in pairs:
            for lo in range(0, len(i), PAIRS):
                a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                new = ~(hit[a] & hit[b])
                a, b = a[new], b[new]
                ok = check(values, order[a], order[b])
                hit[a[ok]] = hit[b[ok]] = True
        return pa.table({"token": pa.array(columns["list"][hit]), "key": pa.array(columns["key"][hit])})

    return members.groupBy("part").applyInArrow(run, "token long, key long").distinct()


def links_in_blocks(members: DataFrame, num: int, den: int, check: Check) -> DataFrame:
    """Pairs (a, b) of near members of blocks that pass the check of (the part's values, places,
    places) and join two components which earlier pairs of their part haven't joined: fewer rows
    than a part has members. Near pairs of which a value is null can't be checked; they leave
    the part as open."""

    def run(group: pa.Table) -> pa.Table:
        columns, pairs = _near(group, num, den)
        key, order = columns["key"], columns["order"]
        values = group.column("value").combine_chunks()
        none = np.asarray(values.is_null())[order]
        names, component = np.unique(columns["component"], return_inverse=True)
        of = np.arange(len(names))
        out, held, n = [], [], 0

        def flush() -> None:
            i, j = np.concatenate(held, axis=1)
            a, b = np.maximum(key[i], key[j]), np.minimum(key[i], key[j])
            at = np.lexsort((b, a))
            a, b = a[at], b[at]
            at = at[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]]
            i, j = i[at], j[at]
            left = none[i] | none[j]
            out.append(np.stack([i[left], j[left]]))
            i, j = i[~left], j[~left]
            ok = _joining(lambda k: check(values, order[i[k]], order[j[k]]), component[i], component[j], of)
            out.append(np.stack([i[ok], j[ok]]))

        for pair in pairs:
            held.append(np.stack(pair))
            n += len(pair[0])
            if n > 1 << 20:
                flush()
                held, n = [], 0
        if held:
            flush()
        i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(np.maximum(key[i], key[j])), "b": pa.array(np.minimum(key[i], key[j])), "open": pa.array(none[i] | none[j])})

    return members.groupBy("part").applyInArrow(run, "a long, b long, open boolean").distinct()


def _joining(check: Callable[[np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, of: np.ndarray, first: int = 256) -> np.ndarray:
    """Places of the pairs that pass the check and join components a and b, which nothing before
    has joined; `of` holds where each component belongs, and goes on. Pairs of components that
    are joined by then aren't checked: they are linked already."""
    left, passed = np.flatnonzero(of[a] != of[b]), []
    while len(left):
        now, left = left[:first], left[first:]
        for k in now[check(now)].tolist():
            x, y = of[a[k]], of[b[k]]
            if x != y:
                of[of == max(x, y)] = min(x, y)
                passed.append(k)
        left = left[of[a[left]] != of[b[left]]]
        first = min(2 * first, 1 << 14)
    return np.array(passed, np.int64)
