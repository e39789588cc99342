"""Session settings and the few knobs the library reads from them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows of one key above which the key is cut into several ordered blocks.
HOT_ROWS_CONF = "cueloom.hotRows"
HOT_ROWS_DEFAULT = 1_000_000
# Rows that a task of a scan holds where the keys allow; more rows make more tasks.
TASK_ROWS_CONF = "cueloom.taskRows"
TASK_ROWS_DEFAULT = 250_000


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("cueloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_ROWS_CONF, str(TASK_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Clusters name it in ``spark.checkpoint.dir``. Only a local session without that
    setting (tests, local runs) gets a folder of its own; elsewhere executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage so a lost executor cannot break a loop."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
