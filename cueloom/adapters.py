"""The given tables read as cue tracks, documents, works, items, jobs and boxes.

All arithmetic is on integers, so the same tables can be written in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators.scan import at_most, plan_layout, scan

EPOCH_2024_US = 1_704_067_200_000_000
CLOCK = 60_000  # microseconds per tick: the event month plays in half a day
WORDS_PER_CUE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds of a timestamp without zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def cues_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per user, a cue per event; cues may overlap."""
    start = F.floor((micros("ts") - F.lit(EPOCH_2024_US)) / F.lit(CLOCK)).cast("bigint")
    length = F.floor(F.col("value") * 1000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("cue_id"),
        start.alias("start_ms"), (start + length).alias("end_ms"), F.col("event_type").alias("text"),
    )


def phrases_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per conversation, a cue per four words of its whole text, in speaking order."""
    # Runs of up to four words, found in one pass over the text.
    runs = F.regexp_extract_all("text", F.lit(rf"\S+(?:\s+\S+){{0,{WORDS_PER_CUE - 1}}}"), F.lit(0))
    spoken = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("track_id"), "turn",
        F.when(F.col("role") == "user", "M1").otherwise("F1").alias("speaker"),
        F.posexplode(runs).alias("pos", "text"),
    ).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    length = F.size(F.split("text", " ")).cast("bigint") * 300
    gap = F.lit(40) + (F.col("pos") * 137 + F.col("turn") * 61) % 900
    rows = spoken.withColumn("pos", F.col("pos").cast("bigint")).withColumn("_len", length).withColumn("_gap", gap)
    layout = plan_layout(rows, ["track_id"], ["turn", "pos"])
    timed = scan(rows, layout, {
        "cue_id": ("number", None), "start_ms": ("sum_before", F.col("_len") + F.col("_gap")),
    })
    return at_most(timed.select(
        "track_id", "cue_id", "start_ms", (F.col("start_ms") + F.col("_len")).alias("end_ms"), "text", "speaker", "turn",
    ), rows)


def docs_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def works_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel per customer, a work per order."""
    day = F.floor(micros("o_orderdate") / F.lit(1_000_000)).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("work_id"),
        (day + F.col("o_orderkey") % 86_400).alias("create_time"),
        F.floor("o_totalprice").cast("bigint").alias("likes"),
        (F.col("o_orderkey") % 600).alias("duration_s"),
        F.when(F.col("o_orderstatus") == "P", "album").otherwise("video").alias("kind"),
        F.concat(F.lit("work "), F.col("o_orderpriority")).alias("title"),
    )


def history_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that were processed before."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("work_id")
    )


def ledger_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in which delivered and open orders stand for several states."""
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "PUBLISHED")
        .when(F.col("o_orderpriority") == "2-HIGH", "FAILED")
        .otherwise("PROCESSING")
    )
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "O").select(
        F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("work_id"), status.alias("status"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
        F.when(status == "FAILED", F.lit("download failed")).alias("last_error"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"),
    )


def items_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch per order, an item per line."""
    status = (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "queued")
        .when(F.col("l_returnflag") == "N", "processing")
        .when(F.col("l_linestatus") == "O", "done")
        .otherwise("partial")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("size"), status.alias("status"),
        F.floor("l_quantity").cast("int").alias("progress"),
        (F.col("l_linenumber") % 3).cast("int").alias("attempts"),
    )


def jobs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per user, a snapshot per event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), micros("ts").alias("updated"), "event_id",
        F.col("event_type").alias("status"), F.floor("value").cast("int").alias("progress"),
        (F.col("event_type") == "error").alias("cancel"), (F.col("event_type") == "signup").alias("reset"),
    )


def boxes_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised boxes on a 1000 x 1000 frame, a track per supplier."""
    x, y = F.col("l_partkey") % 700, F.col("l_orderkey") % 900
    wide = F.floor("l_quantity").cast("bigint") * 8
    tall = F.lit(8) + F.col("l_linenumber").cast("bigint") * 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track_id"), (F.col("l_orderkey") % 50).alias("frame"),
        F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line"),
        F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linenumber").cast("string"), F.col("l_linestatus")).alias("text"),
        x.alias("x0"), y.alias("y0"), (x + wide).alias("x1"), (y + tall).alias("y1"),
        F.floor(F.col("l_discount") * 100 + F.lit(0.5)).cast("bigint").alias("score"),
    )
