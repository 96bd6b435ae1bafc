"""Length-delimited binary records of token ids, with a separate offset index.

A record file is a run of frames, one for each document in ascending order of doc_id:

    8 bytes   length of the payload, little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    payload   8 bytes doc_id, 1 byte width of an id (2 or 4; plus 128: doc_id is null), ids
    4 bytes   masked CRC-32 of the payload
    1 byte    line feed, which ends the frame

A masked checksum is the CRC-32 rotated right by 15 bits plus 0xA282EAD8, modulo 2**32, so
that a checksum of bytes that hold checksums stays sound. Files are written by Spark's own
committer (a failed or repeated task leaves no half file) into any file system that Spark
writes. The index is a Parquet table doc_id, part, offset, length, n_tokens.

A null or empty text has no ids but the end id. A special token's string in a text is that
token, as the library has it by default. Equal texts have equal ids; rows of one doc_id are
written each, in the order of a hash of their texts; an empty table gives no records.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.llm import base, pieces

HEAD = struct.Struct("<QI")
DOC = struct.Struct("<qB")
END_ID = 2


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = DOC.pack(doc_id or 0, width | (doc_id is None) << 7) + ids.astype(f"<u{width}").tobytes()
    size = len(payload).to_bytes(8, "little")
    return size + masked(zlib.crc32(size)).to_bytes(4, "little") + payload + masked(zlib.crc32(payload)).to_bytes(4, "little") + b"\n"


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, where the next frame starts); ValueError where a checksum is wrong."""
    n, check = HEAD.unpack_from(data, at)
    if masked(zlib.crc32(data[at : at + 8])) != check:
        raise ValueError(f"the length at byte {at} is damaged")
    lo, hi = at + HEAD.size, at + HEAD.size + n
    payload = data[lo:hi]
    if masked(zlib.crc32(payload)) != int.from_bytes(data[hi : hi + 4], "little"):
        raise ValueError(f"the record at byte {at} is damaged")
    doc_id, kind = DOC.unpack_from(payload)
    return None if kind & 128 else doc_id, np.frombuffer(payload, f"<u{kind & 127}", offset=DOC.size), hi + 5


class Encoder:
    """The tokenizers library behind the table of known pieces, and by itself for texts that
    hold a special token's string."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = lambda found: [e.ids for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]
        self.pieces = pieces.Encoder(self.whole)

    def batch(self, values: list[str]) -> list[np.ndarray]:
        odd = [i for i, v in enumerate(values) if self.special and self.special.search(v)]
        out = self.pieces.batch(["" if k else v for v, k in zip(values, np.isin(np.arange(len(values)), odd).tolist(), strict=True)])
        for i, ids in zip(odd, self.whole([values[i] for i in odd]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, tokenizer_path: str, out: str, file_bytes: int = 24 << 20) -> tuple[DataFrame, DataFrame]:
    """Writes record files in ascending doc_id order under out/records, and the index under
    out/index. Returns (files read back as bytes, index)."""
    spark = docs.sparkSession
    base.small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    parts = max(1, -(-total // file_bytes))
    # by the text's hash too, so that a repeated doc_id is split and has one order
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).repartitionByRange(parts, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path)
        for batch in batches:
            doc_ids, values = batch.column(0).to_pylist(), pieces.strings(batch.column(1))
            lo = 0
            while lo < len(values):  # frames of a few MB at once
                hi, size = lo, 0
                while hi < len(values) and (hi == lo or size + len(values[hi]) < 2 << 20):
                    size += len(values[hi])
                    hi += 1
                framed = [frame(i, np.append(x, np.uint32(END_ID))) for i, x in zip(doc_ids[lo:hi], known.batch(values[lo:hi]), strict=True)]
                # the writer ends each row by the line feed that ends a frame
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(framed)[:-1]], pa.binary())], ["frames"])
                lo = hi

    framed = ordered.select("doc_id", "text").mapInArrow(encode, "frames binary")
    framed.select(F.col("frames").cast("string").alias("value")).write.mode("overwrite").text(f"{out}/records")
    return read_files(spark, out), write_index(spark, out)


def read_files(spark: SparkSession, out: str) -> DataFrame:
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/records").select(part.alias("part"), "content")


def read_records(files: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, part, offset, length of each record, checksums verified."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, part int, offset long, length long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, rows = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    doc_id, ids, end = unframe(data, at)
                    rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), part, at, end - at))
                    at = end
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 3 else pa.int64()) for k, c in enumerate(columns)], [x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(scan, schema)


def write_index(spark: SparkSession, out: str) -> DataFrame:
    found = read_records(read_files(spark, out))
    found.write.mode("overwrite").parquet(f"{out}/index")
    return spark.read.schema(found.schema).parquet(f"{out}/index")


def read_at(content: bytes, offsets: list[int]) -> list[tuple[int, np.ndarray]]:
    """Records of one file in any order, by the offsets of the index."""
    return [unframe(content, at)[:2] for at in offsets]


def record_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the records of docs to the shared folder and describes them from the files:
    doc_id, start (ids of all records before), n_tokens, ids_crc32, part, offset, length."""
    scratch = base.Scratch(docs.sparkSession, "records")
    _, index = write_records(docs, tokenizer_path, scratch.root)
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    ranked = index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return ranked.join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "offset", "length")
