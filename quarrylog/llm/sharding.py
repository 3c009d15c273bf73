"""Sharding by weighted rendezvous hashing of stable record keys, in DataFrame functions only.

Each shard scores a key by -ln(u) / weight, u being a hash of key and shard in (0, 1); the smallest score wins, ties go to the
smaller shard. A new shard adds one score and changes none, so rows move into the new shard only.

Slots number a shard's rows from 0 without gaps. A row_number over a shard would put a sixteenth of all rows in one
task, so rows get a sub-bucket first: counts per (shard, bucket) give each bucket's first slot, and row numbers run within
a bucket. The bucket comes from a row id stored with the written table, so rows with one key, even a third of all
rows, spread over all buckets, and slots don't change when a task is run again.

Nulls: a null text has no bytes (size 1, checksum of nothing); null doc_ids are one key. Repeated rows go to one shard
and take separate slots. Empty tables give empty results. Columns not asked for are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.common import partitions, session, written

SHARDS = 16
#: Rows of a shard's sub-bucket, about.
BUCKET_ROWS = 20_000


def shard_of(key: F.Column, weights: list[float], seed: int = 11) -> F.Column:
    """The shard, from 0, that the key falls to."""

    def score(k: int, w: float) -> F.Column:
        h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(k)), 11)
        return F.struct((-F.log((h.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(w))).alias("score"), F.lit(k).alias("shard"))

    return F.array_min(F.array(*(score(k, w) for k, w in enumerate(weights))))["shard"]


def assign(docs: DataFrame, weights: list[float] | None = None, added: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard of weight `added`), slot."""
    session(docs)
    weights = list(weights or [1.0] * SHARDS)
    key, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), shard_of(key, [*weights, added]).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(rows, "shards")
    n = rows.count()
    buckets = max(partitions(rows, least=64) // len(weights) + 1, n // (len(weights) * BUCKET_ROWS) + 1)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = written(counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "shard-offsets")
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_row")
    return rows.join(first, ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.row_number().over(within) - 1).cast("long")).drop("_first", "_bucket", "_row")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
