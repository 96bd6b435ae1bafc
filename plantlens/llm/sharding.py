"""Two-pass external shuffle into shards, by DataFrame functions alone.

Pass one scatters whole records uniformly into buckets of bounded size by a seeded hash of
their id and content. Pass two shuffles each bucket by Fisher-Yates (Spark's `shuffle` with
a seed, over the bucket in a fixed order) and writes it. The shuffled buckets in a row are
the permutation; shard s takes the rows at floor(position * shards / rows) = s, so counts
differ by one at most (law `rows`), and a bucket is written to its shards without another
exchange. Bucket b is the work of task b alone, and its size doesn't grow with the input.
The permutation follows from the rows and the seed, not from the session.

Null ids and texts are scattered by what else they hold; repeated rows stay repeated and
may share a bucket; an empty table gives no rows. Extra columns are written along, whatever
their names, but for those named slot or shard, which the result's take the place of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm import base

LAW = "rows"
#: Buckets of a small table, work for every core; and the most, whose counts are broadcast.
LEAST, MOST = 256, 1 << 20


def shuffle_shards(docs: DataFrame, shards: int, seed: int, out: str, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Writes docs under `out`, a folder for each shard, and returns the table read back:
    the columns of docs, shard and slot."""
    spark = docs.sparkSession
    docs = docs.drop("slot", "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text) + 64).alias("b")).first()
    buckets = min(MOST, max(LEAST, -(-(total.b or 0) // bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.crc32(text), F.octet_length(text)), F.lit(buckets)).cast("int")
    scattered = docs.select(F.struct("doc_id", *[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]).alias("record"), bucket.alias("bucket"))
    before = (  # as many rows as buckets: 24 bytes of each, 25 MB at most
        docs.select(bucket.alias("bucket")).groupBy("bucket").count()
        .select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    shuffled = (
        scattered.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
        .select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
        .join(F.broadcast(before), "bucket").select("before", F.posexplode("records").alias("i", "record"))
    )
    position, n = F.col("before") + F.col("i"), F.lit(max(1, total.n))
    shard = F.floor(position * shards / n) if total.n * shards < 1 << 52 else F.expr(f"(before + i) * {shards} div {total.n}")
    placed = shuffled.select("record", shard.cast("int").alias("of"), position.alias("at"))
    first = F.ceil(F.col("of") * n / shards) if total.n * shards < 1 << 52 else F.expr(f"(of * {total.n}L + {shards - 1}) div {shards}")
    placed.select("record.*", (F.col("at") - first).cast("long").alias("slot"), F.col("of").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(out)
    columns = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in ("slot", "shard"))
    return spark.read.schema(f"{columns}, slot long, shard int").parquet(out)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """The shards of docs in the shared folder, described for each document."""
    scratch = base.Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    written = shuffle_shards(docs, shards, seed, scratch.path("files"))
    return written.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
