"""Two-pass external shuffle of a corpus into shards of equal row counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import known


def shuffle_into_shards(
    docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All records in a random order, cut into ``shards`` runs whose row counts differ by one at most.

    Pass one scatters the records by a seeded hash into buckets of about ``bucket_bytes``; pass two gathers one bucket
    at a time and shuffles it (Fisher-Yates). The buckets one after the other are the order; a shard is a run of it,
    so a bucket feeds two shards at most unless there are fewer buckets than shards.

    Returns doc_id, text, bucket, shard (int) and slot (long, from 0 in each shard). Null texts stay null and count as
    no bytes; null ids, ties and repeated rows are records like others; an empty table gives no rows. Other columns
    are not read. Rows equal in id and text share a bucket.
    """
    records = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(
        "spot", F.xxhash64(F.lit(seed), "doc_id", "text"))
    size = F.octet_length(known()) + F.lit(16).cast("long")
    n_rows, n_bytes = records.agg(F.count(F.lit(1)), F.sum(size)).first()
    buckets = max(1, math.ceil((n_bytes or 0) / bucket_bytes))
    records = records.withColumn("bucket", F.pmod("spot", F.lit(buckets)))

    # Offsets of the buckets: a running sum within blocks of buckets and one over the blocks.
    counts = records.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("bucket") / 1024))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select(
        "bucket", (F.col("start") + F.col("block_start")).alias("start"))

    gathered = (
        records.repartition(buckets, "bucket").sortWithinPartitions("bucket", "spot", "doc_id")
        .groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "text")).alias("held"))
    )
    placed = (
        gathered.join(starts.hint("shuffle_hash"), "bucket")
        .select("bucket", "start", F.posexplode(F.shuffle("held", F.lit(seed))).alias("at", "record"))
        .withColumn("place", F.col("start") + F.col("at"))
    )
    # Shard s holds the places from ceil(s * rows / shards) on; whole numbers throughout.
    rows = max(1, n_rows)
    placed = placed.withColumn("shard", F.expr(f"(place * {shards}L) div {rows}L"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "record.doc_id", "record.text", "bucket", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write_shards(records: DataFrame, path: str) -> None:
    """One folder per shard, its rows written in the order of their slots, with doc_id, text and slot.

    Null ids and texts, ties and repeated rows are written like others; an empty table gives no folders. A shard's rows
    lie in as many files as tasks have some of them, each a run of the order.
    """
    dealt = records.select("doc_id", "text", "slot", "shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
