"""Dictionary-compressed WARC archives: `.warc.zst` files that Spark tasks write and read back.

Each file begins with a skippable Zstandard frame (magic number 0x184D2A5D) that holds the
dictionary; each record after it is a frame of its own, compressed with that dictionary, so that
any record can be read alone. The dictionary is trained once, in one task, on a bounded sample of
archived records (at most `samples` distinct payloads by a hash, of at most `sample_bytes` each);
it affects the files' size only. Files are written by Spark's text committer, whose line ends are
set to an empty skippable frame, so that any file system works and a lost task leaves nothing.

A record's block is an HTTP response; its payload is the page's html in UTF-8 (null: empty). Of
records with equal payloads of at least `least` bytes the one with the largest page_id is the
response; the others are revisits that hold the HTTP header alone and refer to it. Smaller
payloads are responses each. Equal rows (page_id and payload) share their type, so a repeated
largest page_id is a response each time. Rows with a null page_id are archived under no id: they
are revisits where another row of their payload has an id, else responses. A null url has no
target header; white space and control characters in a url are percent-encoded. An empty table
makes no records. Extra columns are ignored.

Which row is a response is settled by keys alone; the html moves once, by (page_id, digest), so
that a payload with very many copies isn't gathered anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import base

#: Fixed values of the formats: magic numbers of frames, the revisit profile.
DICTIONARY_MAGIC, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame, as the text writer's line end.
FILLER = struct.pack("<II", SKIPPABLE, 0)
URN = "urn:plantlens:page:"
CHUNK = 2 << 20


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-cased name, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its header says")
    return fields, rest[:n]


def frames(data: memoryview) -> Iterator[bytes]:
    """The records of a file in order, each decompressed with the file's dictionary."""
    import zstandard

    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == FRAME:
            unit = reader.decompressobj()
            parts, lo = [], at
            while not unit.eof:  # a frame doesn't say its length; what follows it is handed back
                hi = min(len(data), lo + (1 << 13))
                parts.append(unit.decompress(data[lo:hi]))
                if lo == hi and not unit.eof:
                    raise ValueError("a frame is cut off")
                lo = hi
            at = lo - len(unit.unused_data)
            yield b"".join(parts)
        elif magic == DICTIONARY_MAGIC and at == 0:
            if size:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
            at = 8 + size
        elif magic & ~15 == SKIPPABLE:
            at += 8 + size
        else:
            raise ValueError(f"no frame at byte {at}")


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest (hex), rep: the page_id that a revisit refers to, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = base.only(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    total = rows.agg(F.sum(F.octet_length("html")).alias("b")).first().b or 0
    parts = base.parts_for(pages.sparkSession, total, 32 << 20)
    keys = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    reps = keys.groupBy("digest").agg(F.max("page_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1 and rep is not null").select("digest", "rep")
    again = keys.join(reps, "digest").where("page_id is null or page_id <> rep").distinct()
    at = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("at")  # never null, so that the html is dealt once
    rows = rows.select("*", at).repartition(parts, "at", "digest")
    return rows.join(again.select(at, "digest", "rep"), ["at", "digest"], "left").select("page_id", "url", "html", "digest", "rep")


def train(rows: DataFrame, size: int = 64 << 10, samples: int = 1000, sample_bytes: int = 64 << 10, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A dictionary of at most `size` bytes, built in one task from the bounded sample; empty
    where there are too few records to build one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held = [record(i, u, h.encode(), base32(bytes.fromhex(d)), None, False, date) for b in batches for i, u, h, d in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        try:
            found = zstandard.train_dictionary(size, held).as_bytes() if len(held) > 7 else b""
        except zstandard.ZstdError:  # the library's word for samples that are too few or too small
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    base.small_batches(rows.sparkSession)
    sample = rows.where(F.octet_length("html").between(1, sample_bytes)).select("page_id", "url", "html", "digest")
    order = F.xxhash64("digest"), F.col("page_id")
    chosen = sample.select("page_id", "digest").orderBy(*order).limit(samples)
    chosen = chosen.groupBy("digest").agg(F.max("page_id").alias("page_id"))
    picked = sample.join(F.broadcast(chosen), ["page_id", "digest"], "left_semi").select("page_id", "url", "html", "digest").orderBy(*order).limit(samples)
    found = picked.coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return found[0].dictionary if found else b""


def write_archives(pages: DataFrame, out: str, least: int = 0, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the pages' archives under out: a file for each task."""
    rows = planned(pages, least)
    trained = train(base.only(pages, "page_id", "url", "html").where("html is not null").withColumn("digest", F.sha1(F.col("html").cast("binary"))), date=date)
    shared = pages.sparkSession.sparkContext.broadcast(trained)  # at most 64 KB

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        trained = shared.value
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=level)
        held, size = [struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained], 0
        for batch in batches:
            for page_id, url, html, digest, rep in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(writer.compress(record(page_id, url, html.encode(), base32(bytes.fromhex(digest)), rep, rep is not None, date)))
                size += len(held[-1])
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["frames"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["frames"])

    packed = rows.mapInArrow(compress, "frames binary")
    packed.select(F.col("frames").cast("string").alias("value")).write.mode("overwrite").option("lineSep", FILLER.decode()).text(out)


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of the
    files. A response's digest and length are those of the payload read and must be what its
    headers say; a revisit's are its headers'."""
    base.small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content")

    def number(fields: dict[str, str], name: str) -> int | None:
        found = fields.get(name, "").strip("<>").removeprefix(URN)
        return int(found) if found else None

    def rows(data: memoryview) -> Iterator[tuple]:
        for whole in frames(data):
            fields, block = parse(whole)
            http, _, payload = block.partition(b"\r\n\r\n")
            n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            kind = fields["warc-type"]
            if kind == "response" and (len(payload) != n or base32(hashlib.sha1(payload).digest()) != digest):  # noqa: S324
                raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
            yield number(fields, "warc-record-id"), fields.get("warc-target-uri"), n, digest, kind, number(fields, "warc-refers-to")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                found: list[tuple] = []
                for row in rows(memoryview(content.as_buffer())):
                    found.append(row)
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return files.mapInArrow(scan, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives of pages to the shared folder and describes them from the files."""
    scratch = base.Scratch(pages.sparkSession, "warc")
    write_archives(pages, scratch.path("archives"), least)
    return read_archives(pages.sparkSession, scratch.path("archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
