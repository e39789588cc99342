"""Helpers the corpus operators share: reading, staging in the shared folder, size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cueloom.session import shared_dir

# A joined side is broadcast only when its counted rows come to no more than this; a shuffle join takes the rest.
BROADCAST_BYTES = 16 << 20


#: Rows that go to a Python worker at once. They carry whole texts, so that Spark's 10,000 would be too much memory for
#: long ones on both sides.
BATCH_ROWS = 1_000


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _modest(spark: SparkSession) -> None:
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With it, the shuffle files of a query go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from there, so that lost executors cost only their tasks.

    What led to the table isn't needed any more once it is written: its shuffle files are removed with the write. Where
    rows that go to Python are large, ``batch_rows`` of them go at once.
    """
    spark = df.sparkSession
    _modest(spark)
    path = scratch(spark, name)
    before, rows = spark.conf.get(CLEANUP, None), spark.conf.get(ARROW_ROWS)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(ARROW_ROWS, str(batch_rows or rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, row_bytes: int) -> DataFrame:
    """The broadcast form of a staged table if its counted size allows it, else the table as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def known(text: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(df: DataFrame, **kinds: str) -> StructType:
    """The table's schema with further columns."""
    shape = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        shape = shape.add(name, kind)
    return shape


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, position: str = "position") -> DataFrame:
    """The rows with their place within their group, from 0, in ascending order of ``order``, nulls first.

    Rows are dealt by ranges of (group, order), so that a large group lies in many partitions; its places go on from
    partition to partition by a running sum over one row per partition and group. Rows equal in all these columns are
    told apart by where they are read and get places of their own.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = df.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("tie_")).sortWithinPartitions(*keys)
    placed = staged(dealt.drop("tie_").withColumn("part_", F.spark_partition_id()).withColumn(
        "at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    runs = placed.groupBy("part_", *group).agg(F.min("at_").alias("least_"), F.count("*").alias("many_"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(runs.select(
        F.col("part_").alias("run_"), *(F.col(c).alias(f"{c}_run") for c in group),
        (F.col("least_") - F.coalesce(F.sum("many_").over(before), F.lit(0))).alias("first_")), f"{name}-runs")
    met = F.col("part_") == F.col("run_")
    for c in group:
        met &= F.col(c).eqNullSafe(F.col(f"{c}_run"))
    joined = placed.join(checked(starts, 64), met).withColumn(position, F.col("at_") - F.col("first_"))
    return joined.select(*df.columns, position)
