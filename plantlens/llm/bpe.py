"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at its byte, each inner node the least
(rank, position) below it. A merge reads the root and updates three leaves (the merged
token's, its successor's and its predecessor's), each in logarithmic time.

Null and empty texts have no ids. Every text, however long, is encoded whole; equal texts
have equal ids. Repeated rows are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantlens.llm import base, pieces

NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merges of the lowest rank first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    shift = size.bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # where the token at a byte ends
    before = list(range(-1, n - 1))  # where the token before it starts

    def put(i: int, j: int) -> None:
        """The pair of the token at i with the one that ends at j (0: there is none)."""
        rank = ranks.get(piece[i:j]) if j else None
        value = NONE if rank is None else rank << shift | i
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            least = value if value < other else other
            if tree[k] == least:
                break
            tree[k] = value = least

    mask = (1 << shift) - 1
    while tree[1] != NONE:
        i = tree[1] & mask
        gone = after[i]
        end = after[i] = after[gone]
        put(gone, 0)
        if end < n:
            before[end] = i
            put(i, after[end])
        else:
            put(i, 0)
        if (left := before[i]) >= 0:
            put(left, end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """A worker's encoder and decoder for one rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        by_rank = sorted(self.ranks, key=self.ranks.get)
        assert [self.ranks[t] for t in by_rank] == list(range(len(by_rank))), "ranks must be gapless"
        size = np.array([len(t) for t in by_rank], np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.encoder = pieces.Encoder(lambda found: [encode_piece(p.encode(), self.ranks) for p in found])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.batch(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[pieces.gathered(self.at[ids], self.size[ids])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's whole text, and with
    with_ids the ids themselves. The decoded bytes come from the ids alone; where they
    should differ from the text, its pieces are encoded again without the table."""
    base.small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in batches:
            values = pieces.strings(batch.column(1))
            n, ids_sha, text_sha, kept = [], [], [], []
            for value, ids in zip(values, c.encode(values), strict=True):
                decoded = c.decode(ids)
                if decoded != value.encode():
                    c.encoder.reset()
                    decoded = c.decode(ids := c.encode([value])[0])
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                kept.append(ids)
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                columns.append(pa.array([k.astype(np.int32) for k in kept], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return base.only(docs, "doc_id", "text").mapInArrow(run, schema)
