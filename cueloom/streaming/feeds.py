"""Streams: new works, claims, sessions, windows, runs, job state, messages, uploads, delivery.

Batches that change keyed state write a version named after the batch id from the version
before it, so a batch that is run again after a failure gives the same state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cueloom.functions.values import LEAST_BACKOFF_S, MOST_BACKOFF_S
from cueloom.operators.cues import KEY
from cueloom.operators.scan import null_safe_join
from cueloom.operators.state import MAX_DELIVERY_ATTEMPTS, MAX_DELIVERY_BYTES, WORK_KEY, job_upsert, ledger_claim, ledger_mark
from cueloom.session import checkpointed, shared_dir
from cueloom.sources.readers import decode_messages
from cueloom.sources.sinks import committed_versions


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table file of a folder as a stream; zoneless times become timestamps."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
        for f in schema.fields
    ])


def sliced_stream(rows: DataFrame, order: str, slices: int = 3, files: int = 8) -> DataFrame:
    """A table as a stream of several batches: slices by ranges of ``order``, copied to the shared folder
    one after the other. A slice is ``files`` files, and a batch reads as many."""
    spark = rows.sparkSession
    base = run_folder(spark, "slices")
    cuts = [r for r in rows.agg(*[F.percentile_approx(order, i / slices, 1000).alias(f"c{i}") for i in range(1, slices)]).first()]
    number = sum(((F.col(order) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for i in range(slices):
        rows.where(F.coalesce(number, F.lit(0)) == i).repartition(files).write.mode("append").parquet(base)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(base)


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """States of keys in RocksDB, which operators with named states need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _started(spark: SparkSession, base: str) -> bool:
    """Whether a stream has committed a batch under ``base``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(folder) and len(files.listStatus(folder)))


def append_all(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into a table, and read the table."""
    spark = stream.sparkSession
    base = run_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def each_batch(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None], base: str | None = None) -> str:
    base = base or run_folder(stream.sparkSession, name)
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return base


def _state_path(base: str, batch_id: int) -> str:
    return f"{base}/state/v={batch_id:08d}"


def _begin(spark: SparkSession, base: str, start: DataFrame) -> None:
    """Write the first state of a folder; a folder that has one goes on from its last batch."""
    if not committed_versions(spark, f"{base}/state"):
        start.write.mode("overwrite").parquet(_state_path(base, 0))


def _last(spark: SparkSession, base: str) -> int:
    return max(committed_versions(spark, f"{base}/state"))


def _clock(spark: SparkSession, base: str, version: int) -> int | None:
    """How far time had come with a version; null before the first one."""
    if not version:
        return None
    return spark.read.schema("at bigint").parquet(f"{base}/clock/v={version:08d}").first()[0]


def _set_clock(spark: SparkSession, base: str, version: int, at: int | None) -> None:
    spark.createDataFrame([(at,)], "at bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/clock/v={version:08d}")


def fold_batches(
    stream: DataFrame, name: str, start: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], base: str | None = None,
) -> DataFrame:
    """Fold micro-batches into a state table: ``step(state, batch, batch_id) -> state``.

    With a ``base`` of the caller a later start goes on where the last one stopped.
    """
    spark = stream.sparkSession
    base = base or run_folder(spark, name)
    _begin(spark, base, start)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = session.read.schema(start.schema).parquet(_state_path(base, batch_id))
        step(state, batch, batch_id).select(*start.columns).write.mode("overwrite").parquet(_state_path(base, batch_id + 1))

    each_batch(stream, name, handle, base)
    return spark.read.schema(start.schema).parquet(_state_path(base, _last(spark, base)))


# A full version after so many batches; those between hold what the batches changed.
COMPACT = 10
STATE_BUCKETS = 64


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(STATE_BUCKETS)).cast("int")


def _state_at(spark: SparkSession, base: str, shape: T.StructType, keys: list[str], version: int, compact: int, buckets: list[int] | None = None, only: Column | None = None) -> DataFrame:
    """The state after a version: of every key the row of the latest of the last full version and its changes.

    ``only`` picks rows by columns that a key's row keeps in all versions.
    """
    rows = None
    for v in range(version - version % compact, version + 1):
        part = spark.read.schema(T.StructType([*shape.fields, T.StructField("_bucket", T.IntegerType())])).parquet(_state_path(base, v))
        part = (part.where(F.col("_bucket").isin(buckets)) if buckets is not None else part).withColumn("_v", F.lit(v))
        part = part if only is None else part.where(only)
        rows = part if rows is None else rows.unionByName(part)
    names = [f.name for f in shape.fields]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[n for n in names if n not in keys]), "_v").alias("_row"))
    return latest.select(*[F.col(n) if n in keys else F.col(f"_row.{n}").alias(n) for n in names])


def fold_keyed(
    stream: DataFrame, name: str, start: DataFrame, keys: list[str], step: Callable[[DataFrame, DataFrame], DataFrame],
    base: str | None = None, compact: int = COMPACT,
) -> DataFrame:
    """Fold micro-batches into a state of which a batch changes its own keys only: ``step(state, batch) -> state``.

    ``step`` gets the rows of the batch's keys and returns theirs. A batch reads the buckets of its keys and writes the
    rows that it made, as a version named after the batch, so that what is written follows the batch; every ``compact``
    batches a version holds all rows. A batch run again after a failure writes the same version. With a ``base`` of the
    caller a later start goes on where the last one stopped.
    """
    spark = stream.sparkSession
    base = base or run_folder(spark, name)
    shape = start.schema
    if not committed_versions(spark, f"{base}/state"):
        start.withColumn("_bucket", _bucket(keys)).write.mode("overwrite").partitionBy("_bucket").parquet(_state_path(base, 0))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        asked = batch.select(*keys).distinct()
        touched = [r[0] for r in asked.select(_bucket(keys).alias("b")).distinct().collect()]
        old = _state_at(session, base, shape, keys, batch_id, compact, touched)
        new = step(null_safe_join(old, asked, keys, "left_semi"), batch).select(*start.columns)
        if (batch_id + 1) % compact == 0:
            rest = _state_at(session, base, shape, keys, batch_id, compact)
            new = null_safe_join(rest, asked, keys, "left_anti").unionByName(new)
        new.withColumn("_bucket", _bucket(keys)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(_state_path(base, batch_id + 1))

    each_batch(stream, name, handle, base)
    return _state_at(spark, base, shape, keys, _last(spark, base), compact)


# ------------------------------------------------------------------------------ works


def monitor_stream(works: DataFrame, now: Column | int, hours: int = 72) -> DataFrame:
    """New works once each.

    The horizon is the wall clock; the watermark only bounds the state of the duplicates.
    Works seen longer ago are kept out by the history (see ``claim_stream``).
    """
    since = F.timestamp_seconds((F.lit(now) if isinstance(now, int) else now) - hours * 3600)
    return (
        works.where((F.col("create_ts") >= since) & F.col("work_id").isNotNull())
        .withWatermark("create_ts", f"{hours} hours").dropDuplicatesWithinWatermark(["work_id"])
    )


def claim_stream(works: DataFrame, ledger: DataFrame, now: Column, base: str | None = None) -> DataFrame:
    """Claim the works of every batch in the ledger; a work is claimed once whatever is retried."""
    return fold_keyed(works, "claims", ledger, WORK_KEY, lambda state, batch: ledger_claim(state, batch, now), base)


def mark_stream(marks: DataFrame, ledger: DataFrame, now: Column, base: str | None = None) -> DataFrame:
    return fold_keyed(marks, "marks", ledger, WORK_KEY, lambda state, batch: ledger_mark(state, batch, now), base)


# ---------------------------------------------------------------------------- windows


def session_cues(events: DataFrame, gap: str, ts: str = "ts") -> DataFrame:
    """Events of a track closer than a gap as one session; for tables and streams."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), KEY).agg(F.count(F.lit(1)).alias("events")).select(
        KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"
    )


def hop_windows(events: DataFrame, ts: str = "ts", length: str = "61 seconds", every: str = "60 seconds") -> DataFrame:
    """Counts per overlapping window."""
    return events.groupBy(F.window(ts, length, every).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"
    )


def tumbling_energy(samples: DataFrame, ts: str = "ts", length: str = "50 milliseconds") -> DataFrame:
    """Energy per track and tumbling window of a sample stream."""
    square = F.col("v").cast("double") * F.col("v")
    return samples.groupBy(F.window(ts, length).alias("w"), KEY).agg(
        F.sqrt(F.avg(square)).alias("rms"), F.count(F.lit(1)).alias("samples")
    ).select(KEY, F.col("w.start").alias("start"), "rms", "samples")


# ------------------------------------------------------------------------------- runs

RUNS = f"{KEY} bigint, start_ms bigint, end_ms bigint, frames bigint, has_unknown boolean"
OPEN_RUN = "pattern_id bigint, start_ms bigint, last_ms bigint, frames bigint, known boolean, has_unknown boolean"


class OpenRuns(StatefulProcessor):
    """Runs of one pattern per track; the run that is still open is the track's state."""

    def __init__(self, frame_ms: int) -> None:
        self.frame_ms = frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN_RUN)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        frames = pd.concat(list(rows)).sort_values("frame_no", kind="stable")
        run = self.open.get() if self.open.exists() else None
        closed = []

        def close(run, until):
            pattern, start, _last, many, known, unknown = run
            if pattern is not None and (known or many >= 3):
                closed.append((key[0], start, until, many, unknown))

        for t, pattern, known in zip(frames["t_ms"], frames["pattern_id"], frames["known"]):
            t, pattern, known = int(t), None if pd.isna(pattern) else int(pattern), bool(known)
            if run is not None and run[0] == pattern:
                run = (pattern, run[1], t, run[3] + 1, run[4] or known, run[5] or not known)
                continue
            if run is not None:
                # A run lasts until the next frame begins.
                close(run, t)
            run = (pattern, t, t, 1, known, not known)
        self.open.update(run)
        yield pd.DataFrame(closed, columns=[KEY, "start_ms", "end_ms", "frames", "has_unknown"])


def run_confirm_stream(frames: DataFrame, frame_ms: int = 40, base: str | None = None) -> DataFrame:
    """Confirmed runs of a frame stream; the open run of each track is a value in the state store.

    Frames arrive in order across batches. A batch writes the states of the tracks that it meets and appends the runs
    that it closes, so that its cost follows the batch, not the number of tracks seen so far. Runs open at the end of
    the input are closed there. With a ``base`` of the caller a later start goes on where the last one stopped. The
    frames that a track has in one batch are one task; the stream's trigger bounds them.
    """
    spark = frames.sparkSession
    base = base or run_folder(spark, "runs")
    with state_store(spark):
        closed = frames.groupBy(KEY).transformWithStateInPandas(
            OpenRuns(frame_ms), outputStructType=RUNS, outputMode="Append", timeMode="None")
        query = (
            closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start(f"{base}/closed")
        )
        query.awaitTermination()
    done = spark.read.schema(RUNS).parquet(f"{base}/closed")
    if not _started(spark, base):
        return spark.createDataFrame([], RUNS)
    left = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/checkpoint")
    ended = left.where(F.col("value.pattern_id").isNotNull() & (F.col("value.known") | (F.col("value.frames") >= 3))).select(
        F.col(f"key.{KEY}").alias(KEY), "value.start_ms", (F.col("value.last_ms") + frame_ms).alias("end_ms"), "value.frames", "value.has_unknown")
    return done.unionByName(ended)


# ------------------------------------------------------------------- jobs and messages


def job_state_stream(log: DataFrame, data: list[str], order: list[str], start: DataFrame, base: str | None = None) -> DataFrame:
    """Latest snapshot per job with its sticky cancel, folded batch by batch."""
    return fold_keyed(log, "jobs", start, ["job_id"], lambda state, batch: job_upsert(state, batch, data, order), base)


def message_stream(frames: DataFrame) -> DataFrame:
    return decode_messages(frames)


def read_receipts(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("kind") == "read").select(
        "conversation_id", F.col("value").try_cast("bigint").alias("read_index")
    )


# ---------------------------------------------------------------------------- uploads


UPLOAD_EVENTS = "session_id bigint, received bigint, event string"
UPLOAD_STATE = "since bigint, total bigint, chunks array<bigint>, told boolean, received bigint, event string"
UPLOAD_TTL_S = 7200
# A session that was told keeps a mark this long, so that late receipts don't open it again.
MARK_TTL_S = 30 * 86_400


def _uploads_after(state: DataFrame, receipts: DataFrame, ttl: int, now: int) -> DataFrame:
    """The sessions of a batch's receipts and what is told of them; ``state`` holds theirs, with ended marks left out."""
    met = receipts.groupBy("session_id", "chunk_index", "total_chunks").agg(F.min("at").alias("at"))
    rows = null_safe_join(met, state.select("session_id", "since", "total", "chunks", "told"), ["session_id"], "left").where(~F.coalesce("told", F.lit(False)))
    of_session = Window.partitionBy("session_id")
    so_far = of_session.orderBy("at", "chunk_index", F.desc("total_chunks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(Window.partitionBy("session_id", "chunk_index").orderBy("at", F.desc("total_chunks"))) == 1
    had = F.coalesce("chunks", F.array().cast("array<bigint>"))
    rows = rows.withColumn("since", F.coalesce("since", F.min("at").over(of_session))).withColumn("chunks", had)
    rows = rows.withColumn("_in", F.col("at") <= F.col("since") + ttl)
    rows = rows.withColumn("_new", F.col("_in") & first & ~F.array_contains("chunks", F.col("chunk_index")))
    rows = rows.withColumn("_received", F.size("chunks") + F.sum(F.col("_new").cast("bigint")).over(so_far))
    rows = rows.withColumn("_total", F.greatest(F.coalesce("total", F.lit(0)), F.max("total_chunks").over(so_far)))
    ended = rows.groupBy("session_id").agg(
        F.first("since").alias("since"),
        F.min(F.when(F.col("_in") & (F.col("_received") == F.col("_total")), F.col("_received"))).alias("_full"),
        F.max(F.when(F.col("_in"), F.col("_received"))).alias("_received"), F.max(F.when(F.col("_in"), F.col("_total"))).alias("_total"),
        F.first("total").alias("_had_total"), F.first("chunks").alias("_had"), F.collect_list(F.when(F.col("_new"), F.col("chunk_index"))).alias("_fresh"), F.max("at").alias("_last"))
    event = F.when(F.col("_full").isNotNull(), "complete").when(F.greatest("_last", F.lit(now)) > F.col("since") + ttl, "expired")
    none = F.array().cast("array<bigint>")
    return ended.select(
        "session_id", "since", F.coalesce("_total", "_had_total").alias("total"), F.when(event.isNull(), F.concat("_had", "_fresh")).otherwise(none).alias("chunks"),
        event.isNotNull().alias("told"), F.coalesce("_full", "_received", F.size("_had")).cast("bigint").alias("received"), event.alias("event"))


def chunk_arrivals(chunks: DataFrame, base: str | None = None, ttl_s: int = UPLOAD_TTL_S, mark_ttl_s: int = MARK_TTL_S, late: str = "0 seconds") -> DataFrame:
    """Upload events from ``(session_id, chunk_index, total_chunks, ts)``: complete or expired, once each.

    A receipt counts once however often it arrives. A session expires ``ttl_s`` of event time after its first receipt,
    whatever the batches are; what comes later doesn't count. Receipts may come ``late`` against those of earlier
    batches. A batch writes the sessions that it meets or that end with its time as a version with their events; it reads
    the buckets of the former and, by their first receipt, the latter. Every ``COMPACT`` batches a version holds all
    sessions. Told ones keep a mark, which goes ``mark_ttl_s`` after the session's first receipt.
    """
    spark = chunks.sparkSession
    base = base or run_folder(spark, "uploads")
    keys, index = ["session_id"], F.col("chunk_index")
    ttl, mark_ttl = ttl_s * 1_000_000, max(mark_ttl_s, ttl_s + 1) * 1_000_000
    shape = T.StructType([chunks.schema["session_id"], *T.StructType.fromDDL(UPLOAD_STATE).fields])
    lag = spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {late}"))).first()[0]
    if not committed_versions(spark, f"{base}/state"):
        spark.createDataFrame([], shape).withColumn("_bucket", _bucket(keys)).write.mode("overwrite").partitionBy("_bucket").parquet(_state_path(base, 0))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _clock(session, base, batch_id)
        rows = batch.where((index >= 0) & (index < F.col("total_chunks")) & F.col("ts").isNotNull()).select(
            "session_id", index.cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
        rows = rows if before is None else rows.where(F.col("at") >= before)
        seen = rows.agg(F.max("at").alias("at"), F.collect_set(_bucket(keys)).alias("buckets")).first()
        now = max((t for t in (before, None if seen["at"] is None else seen["at"] - lag) if t is not None), default=None)
        if now is None:
            new = session.createDataFrame([], shape)
        else:
            asked = rows.select(*keys).distinct()
            old = null_safe_join(_state_at(session, base, shape, keys, batch_id, COMPACT, seen["buckets"]), asked, keys, "left_semi")
            met = _uploads_after(old if before is None else old.where(F.col("since") + mark_ttl >= before), rows, ttl, now)
            # A session keeps its first receipt, so its rows in all versions fall into the range together.
            ends = F.col("since") < now - ttl if before is None else (F.col("since") >= before - ttl) & (F.col("since") < now - ttl)
            ending = null_safe_join(_state_at(session, base, shape, keys, batch_id, COMPACT, only=ends).where(~F.col("told")), asked, keys, "left_anti")
            new = met.unionByName(ending.withColumns({
                "received": F.size("chunks").cast("bigint"), "chunks": F.array().cast("array<bigint>"), "told": F.lit(True), "event": F.lit("expired")}))
            new = new.select(*shape.names)
            if (batch_id + 1) % COMPACT == 0:
                rest = _state_at(session, base, shape, keys, batch_id, COMPACT).where(F.col("since") + mark_ttl >= now)
                new = checkpointed(new)
                new = null_safe_join(rest, new, keys, "left_anti").withColumn("event", F.lit(None).cast("string")).unionByName(new)
        new.withColumn("_bucket", _bucket(keys)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(_state_path(base, batch_id + 1))
        _set_clock(session, base, batch_id + 1, now)

    each_batch(chunks, "uploads", handle, base)
    told = spark.read.schema(shape).parquet(f"{base}/state")
    return told.where(F.col("event").isNotNull()).select(*[f.name for f in T.StructType.fromDDL(UPLOAD_EVENTS).fields])


# --------------------------------------------------------------------------- delivery

JOB_STATE = "delivery_status string, delivery_path string, attempts int, next_attempt bigint"


def _tried(rows: DataFrame, now: int) -> DataFrame:
    """Jobs after all attempts that are due by ``now``, each made at its own time."""
    unfit = F.col("size").isNull() | (F.col("size") > MAX_DELIVERY_BYTES)

    def attempt(job: Column, _no: Column) -> Column:
        due = (job["status"] == "pending") & (job["due"] <= now)
        stuck = unfit | (job["attempts"] >= MAX_DELIVERY_ATTEMPTS)
        sent = F.coalesce(job["attempts"] >= F.col("sent_from"), F.lit(False))
        delay = F.call_function("shiftleft", F.lit(LEAST_BACKOFF_S).cast("bigint"), F.least(job["attempts"], F.lit(10)))
        return F.struct(
            F.when(due & stuck, "manual_required").when(due & sent, "delivered").otherwise(job["status"]).alias("status"),
            F.when(due & ~stuck, job["attempts"] + 1).otherwise(job["attempts"]).alias("attempts"),
            F.when(due & ~stuck, job["due"] + F.least(F.lit(MOST_BACKOFF_S).cast("bigint"), delay)).otherwise(job["due"]).alias("due"),
        )

    # One step more than there are attempts left, since the last one leaves the job to a person.
    steps = F.sequence(F.lit(0), F.greatest(F.lit(MAX_DELIVERY_ATTEMPTS) - F.col("attempts"), F.lit(0)))
    start = F.struct(F.col("delivery_status").alias("status"), F.col("attempts").alias("attempts"), F.col("next_attempt").alias("due"))
    after = rows.withColumn("_job", F.aggregate(steps, start, attempt))
    told = {"delivery_status": "status", "attempts": "attempts", "next_attempt": "due"}
    return after.select(*[F.col(f"_job.{told[c]}").alias(c) if c in told else F.col(c) for c in rows.columns])


def _not_yet(now: int | None) -> Column:
    """Rows of a version that no later one has replaced by ``now``: ended jobs, and those due later."""
    waits = F.lit(True) if now is None else F.col("next_attempt") > now
    return ~F.col("delivery_status").eqNullSafe("pending") | waits


def delivery_timer(ticks: DataFrame, jobs: DataFrame, results: DataFrame, files: DataFrame, base: str | None = None) -> DataFrame:
    """Delivery jobs after the time that a clock stream (``now``, seconds) tells has passed.

    ``results`` is ``(job_id, sent_from)``: how many attempts fail before one is sent, null if none is. Due jobs are
    tried, failed ones again after a back-off that doubles, and after five attempts, or where the file is missing or too
    large, they are left to a person. The jobs are the first version of a new ``base`` folder; a later start with it goes
    on where the last one stopped. A tick reads the jobs that fell due since the one before it and writes these as the
    next version, so a pending row that is due is always the job's latest. Every ``COMPACT`` ticks a version holds all
    jobs. Times are of the stream; ticks that run back change nothing.
    """
    spark = ticks.sparkSession
    base = base or run_folder(spark, "delivery")
    if not committed_versions(spark, f"{base}/state"):
        sized = files.groupBy(F.col("path").alias("delivery_path")).agg(F.max("size").alias("size"))
        sent = results.groupBy("job_id").agg(F.max(F.col("sent_from").cast("int")).alias("sent_from"))
        first = jobs.dropDuplicates(["job_id"]).join(sized, "delivery_path", "left").join(sent, "job_id", "left")
        first.select(
            "job_id", "delivery_status", "delivery_path", F.coalesce(F.col("attempts").cast("int"), F.lit(0)).alias("attempts"),
            F.coalesce(F.col("next_attempt").cast("bigint"), F.lit(0)).alias("next_attempt"), F.col("size").cast("bigint").alias("size"), "sent_from",
        ).write.mode("overwrite").parquet(_state_path(base, 0))
    shape = T.StructType([jobs.schema["job_id"], *T.StructType.fromDDL(f"{JOB_STATE}, size bigint, sent_from int").fields])

    def versions(session: SparkSession, last: int) -> DataFrame:
        return session.read.schema(shape).parquet(*[_state_path(base, v) for v in range(last - last % COMPACT, last + 1)])

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _clock(session, base, batch_id)
        now = max((t for t in (before, batch.agg(F.max(F.col("now").cast("bigint"))).first()[0]) if t is not None), default=None)
        rows = versions(session, batch_id).where(_not_yet(before))
        if (batch_id + 1) % COMPACT:
            rows = rows.where(~_not_yet(now))
        (rows if now is None else _tried(rows, now)).write.mode("overwrite").parquet(_state_path(base, batch_id + 1))
        _set_clock(session, base, batch_id + 1, now)

    each_batch(ticks, "delivery", handle, base)
    last = _last(spark, base)
    if not last:
        return jobs.select("job_id", *[f.name for f in T.StructType.fromDDL(JOB_STATE)])
    return versions(spark, last).where(_not_yet(_clock(spark, base, last))).select("job_id", *[f.name for f in T.StructType.fromDDL(JOB_STATE)])
