"""Keyed state as tables: pure functions from a state and changes to the next state.

The caller writes the returned table as a new version (see ``sinks.write_version``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import is_blank, strip
from cueloom.functions.values import backoff_seconds, valid_region
from cueloom.operators.works import ACTIVE_STATES, WORK_KEY

# Job states.
TERMINAL_STATES = ["done", "error", "cancelled", "partial", "failed"]
ACTIVE_STEP_STATES = ["generating", "processing", "queued", "rendering"]
WAITING_STATES = ["awaiting_review", "uploaded", "uploading", "interrupted"]
MAX_DELIVERY_BYTES = int(49.5 * 1024 * 1024)
MAX_DELIVERY_ATTEMPTS = 5

LEDGER = (
    "channel_id", "work_id", "source_url", "source_json", "status", "artifact_path", "package_path",
    "last_error", "attempts", "created_at", "updated_at",
)


# ------------------------------------------------------------------------ source ledger


def ledger_claim(ledger: DataFrame, works: DataFrame, now: Column) -> DataFrame:
    """Claim works that no one is busy with; a repeated claim counts the attempt."""
    asked = works.where(~is_blank(F.col("work_id").cast("string"))).groupBy(*WORK_KEY).agg(
        F.min("source_url").alias("_url"), F.min("source_json").alias("_json")
    ).withColumn("_asked", F.lit(True))
    both = ledger.withColumn("_known", F.lit(True)).join(asked, WORK_KEY, "full_outer")
    busy = F.coalesce(F.col("status").isin(ACTIVE_STATES), F.lit(False))
    claim = F.coalesce("_asked", F.lit(False)) & ~busy
    known = F.col("_known").isNotNull()
    return both.select(
        *WORK_KEY,
        F.when(claim & ~known, F.col("_url")).otherwise(F.col("source_url")).alias("source_url"),
        F.when(claim, F.col("_json")).otherwise(F.col("source_json")).alias("source_json"),
        F.when(claim, "CLAIMED").otherwise(F.col("status")).alias("status"),
        "artifact_path", "package_path",
        F.when(~claim, F.col("last_error")).alias("last_error"),
        F.when(claim, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(known, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(claim, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def ledger_mark(ledger: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """Set status and error; paths stay when the mark names none. The last mark of a key wins."""
    rest = [c for c in marks.columns if c not in (*WORK_KEY, "seq")]
    last = marks.groupBy(*WORK_KEY).agg(
        F.max_by(F.struct("status", "error"), "seq").alias("_m"),
        F.max_by("artifact_path", F.when(F.col("artifact_path").isNotNull(), F.col("seq"))).alias("_artifact"),
        F.max_by("package_path", F.when(F.col("package_path").isNotNull(), F.col("seq"))).alias("_package"),
    )
    assert {"status", "error", "artifact_path", "package_path"} <= set(rest)
    both = ledger.join(last, WORK_KEY, "left")
    hit = F.col("_m").isNotNull()
    cols = {
        "status": F.when(hit, F.col("_m.status")).otherwise(F.col("status")),
        "artifact_path": F.coalesce("_artifact", "artifact_path"),
        "package_path": F.coalesce("_package", "package_path"),
        "last_error": F.when(hit, F.col("_m.error")).otherwise(F.col("last_error")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return both.select(*[cols.get(c, F.col(c)).alias(c) for c in ledger.columns])


# --------------------------------------------------------------------------------- jobs


def latest_job_state(log: DataFrame, data: list[str], order: list[str], marks: bool = False) -> DataFrame:
    """Newest snapshot per job. A cancel sticks until a later reset snapshot.

    One aggregate: the job is cancelled when its last cancelling snapshot is not before its
    last reset. ``marks`` adds the places of the newest, the last cancelling and the last reset
    snapshot, by which ``job_upsert`` can tell what is newer.
    """
    at = F.struct(*order)
    last_cancel = F.max(F.when(F.col("cancel"), at))
    last_reset = F.max(F.when(F.col("reset"), at))
    folded = log.groupBy("job_id").agg(
        F.max_by(F.struct(*data), at).alias("_data"), F.max("updated").alias("updated"), F.max(at).alias("newest_at"),
        last_cancel.alias("cancel_at"), last_reset.alias("reset_at"), F.count(F.lit(1)).alias("snapshots"),
    )
    return folded.select("job_id", "updated", "_data.*", _sticky("cancel_at", "reset_at").alias("cancel"), "snapshots", *(MARKS if marks else ()))


MARKS = ("newest_at", "cancel_at", "reset_at")


def _sticky(cancel_at: Column | str, reset_at: Column | str) -> Column:
    cancel_at, reset_at = (F.col(c) if isinstance(c, str) else c for c in (cancel_at, reset_at))
    return cancel_at.isNotNull() & (reset_at.isNull() | (cancel_at >= reset_at))


def job_upsert(state: DataFrame, log: DataFrame, data: list[str], order: list[str]) -> DataFrame:
    """State after more snapshots.

    A state with the ``marks`` of ``latest_job_state`` keeps them: snapshots may then come in any order. Without, the
    stored row counts as older than all of the log and never resets.
    """
    fresh = latest_job_state(log, data, order, marks=True)
    if set(MARKS) <= set(state.columns):
        both = state.select("job_id", "updated", *data, *MARKS).unionByName(fresh.select("job_id", "updated", *data, *MARKS))
        merged = both.groupBy("job_id").agg(
            F.max_by(F.struct(*data), "newest_at").alias("_data"), F.max("updated").alias("updated"), *[F.max(c).alias(c) for c in MARKS])
        return merged.select("job_id", "updated", "_data.*", _sticky("cancel_at", "reset_at").alias("cancel"), *MARKS)
    new = fresh.select("job_id", *[F.col(c).alias(f"_n_{c}") for c in ("updated", *data, "cancel")], F.col("reset_at").isNotNull().alias("_was_reset"))
    both = state.join(new, "job_id", "full_outer")
    kept = F.coalesce("cancel", F.lit(False)) & ~F.coalesce("_was_reset", F.lit(False))
    seen = F.col("_n_updated").isNotNull()
    return both.select(
        "job_id",
        *[F.when(seen, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in ("updated", *data)],
        (F.coalesce("_n_cancel", F.lit(False)) | kept).alias("cancel"),
    )


def dead_owner(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """Interrupt active jobs whose owner sends no heartbeat.

    ``jobs`` has ``status``, ``owner`` and ``steps map<string,string>`` (step states); a step
    in work makes its job active too.
    """
    beats = alive.select(F.col("owner")).distinct().withColumn("_alive", F.lit(True))
    marked = jobs.join(beats, "owner", "left")
    steps = F.coalesce("steps", F.create_map().cast("map<string,string>"))
    step_active = F.exists(F.map_values(steps), lambda s: s.isin(ACTIVE_STEP_STATES))
    active = step_active | ~F.col("status").isin(TERMINAL_STATES + WAITING_STATES)
    stop = active & F.col("_alive").isNull()
    stopped = F.transform_values(
        steps, lambda _k, s: F.when(s.isin(ACTIVE_STEP_STATES), "interrupted").otherwise(s)
    )
    return marked.select(
        *[c for c in jobs.columns if c not in ("status", "steps")],
        F.when(stop, "interrupted").otherwise(F.col("status")).alias("status"),
        F.when(stop, stopped).otherwise(steps).alias("steps"), stop.alias("stopped"),
    )


def active_jobs(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """What a restart finds: running jobs, and those settled to cancelled or interrupted."""
    beats = alive.select("owner").distinct().withColumn("_alive", F.lit(True))
    rows = jobs.join(beats, "owner", "left")
    resting = F.col("status").isin(TERMINAL_STATES + ["uploaded", "awaiting_review", "interrupted"])
    settled = (
        F.when(resting, F.col("status")).when(F.col("cancel"), "cancelled")
        .when(F.col("owner").isNotNull() & F.col("_alive").isNull(), "interrupted").otherwise(F.col("status"))
    )
    active = ~resting & ~F.col("cancel") & (F.col("owner").isNull() | F.col("_alive").isNotNull())
    return rows.withColumn("settled", settled).withColumn("active", active).drop("_alive")


def evict_jobs(jobs: DataFrame, now: int, max_age_s: int, keep: int) -> DataFrame:
    """Finished jobs that are too old or not among the ``keep`` newest."""
    steps = F.coalesce("steps", F.create_map().cast("map<string,string>"))
    busy = F.exists(F.map_values(steps), lambda s: s.isin("processing", "generating", "queued"))
    finished = jobs.where(F.col("status").isin(TERMINAL_STATES) & ~busy).withColumn(
        "finished_at", F.coalesce("completed_at", "created_at", F.lit(now))
    )
    # Top-k instead of a global rank; the k rows kept are a setting, not data.
    newest = finished.orderBy(F.desc("finished_at"), F.desc("job_id")).limit(keep).select("job_id").withColumn("_new", F.lit(True))
    marked = finished.join(newest, "job_id", "left")
    old = F.lit(now) - F.col("finished_at") > max_age_s
    return marked.where(old | F.col("_new").isNull()).select(
        "job_id", "finished_at", F.when(old, "age").otherwise("count").alias("reason")
    )


def job_view(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "status", F.coalesce("progress", F.lit(0)).alias("progress"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("message", "active_step", "original_name")],
        F.coalesce("created_at", F.lit(0)).alias("created_at"),
    )


def all_job_ids(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    return stored.select("job_id").union(loaded.select("job_id")).distinct()


def path_parts(path: Column) -> Column:
    """Names a path can be tied to a job by: each folder, the file, and file name prefixes."""
    parts = F.split(path, "/")
    name = F.try_element_at(parts, F.lit(-1))
    pieces = F.split(name, "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "_"),
    )
    prefixes = F.when(F.size(pieces) > 1, prefixes).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parts, prefixes))


def expired_files(files: DataFrame, jobs: DataFrame, roots: dict[str, int], now: int) -> DataFrame:
    """Files past the retention of their root that belong to no active job.

    ``roots`` maps a folder to its retention in seconds.
    """
    age = F.lit(now) - F.col("mtime")
    due, root = F.lit(False), F.lit(None).cast("string")
    for folder, limit in roots.items():
        below = F.col("path").startswith(folder.rstrip("/") + "/")
        due = due | (below & (age > limit))
        root = F.when(below, folder).otherwise(root)
    old = files.withColumn("root", root).where(due)
    steps = F.coalesce("steps", F.create_map().cast("map<string,string>"))
    busy = F.exists(F.map_values(steps), lambda s: s.isin("processing", "generating", "queued"))
    active = jobs.where(~F.col("status").isin(TERMINAL_STATES) | busy).select(F.col("job_id").alias("part")).distinct()
    tied = old.select("path", F.explode(path_parts(F.col("path"))).alias("part")).join(active, "part", "left_semi")
    return old.join(tied.select("path"), "path", "left_anti")


def missing_artifacts(jobs: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the number of promised files that are gone; a finished one becomes partial."""
    gone = declared.join(files.select("path"), "path", "left_anti").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("missing")
    )
    missing = F.coalesce("missing", F.lit(0))
    return jobs.join(gone, "job_id", "left").withColumn("missing", missing).withColumn(
        "status", F.when((F.col("missing") > 0) & (F.col("status") == "done"), "partial").otherwise(F.col("status"))
    )


# ------------------------------------------------------------------- channels, presets


def channel_upsert(channels: DataFrame, changes: DataFrame) -> DataFrame:
    """Add or update channels by case-insensitive id; blank names keep what was stored.

    The last change per id (``seq``) wins and enables the channel again.
    """
    settings = [c for c in channels.columns if c not in ("channel_id", "nickname", "sec_uid", "enabled", "last_check")]
    named = changes.withColumn("_id", F.lower(strip("channel_id"))).where(F.col("_id") != "")
    last = named.groupBy("_id").agg(
        F.min_by(strip("channel_id"), "seq").alias("_channel_id"),
        F.max_by(F.struct(*settings), "seq").alias("_s"),
        *[F.max_by(c, F.when(~is_blank(c), F.col("seq"))).alias(f"_{c}") for c in ("nickname", "sec_uid")],
    )
    both = channels.withColumn("_id", F.lower("channel_id")).join(last, "_id", "full_outer")
    hit = F.col("_s").isNotNull()
    return both.select(
        F.coalesce("channel_id", "_channel_id").alias("channel_id"),
        F.coalesce("_nickname", "nickname", "_channel_id").alias("nickname"),
        F.coalesce("_sec_uid", "sec_uid", F.lit("")).alias("sec_uid"),
        *[F.when(hit, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in settings],
        F.when(hit, True).otherwise(F.col("enabled")).alias("enabled"),
        F.coalesce("last_check", F.lit(0)).alias("last_check"),
    ).select(*channels.columns)


def channel_remove(channels: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.lower(strip("channel_id")).alias("_id"))
    return channels.withColumn("_id", F.lower("channel_id")).join(gone, "_id", "left_anti").drop("_id")


def channel_patch(channels: DataFrame, patches: DataFrame) -> DataFrame:
    """Set the given columns of existing channels (NULL leaves a column); the id never changes."""
    fields = [c for c in patches.columns if c in channels.columns and c != "channel_id"]
    last = patches.withColumn("_id", F.lower(strip("channel_id"))).groupBy("_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in fields]
    )
    both = channels.withColumn("_id", F.lower("channel_id")).join(last, "_id", "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in channels.columns])


def preset_upsert(presets: DataFrame, changes: DataFrame) -> DataFrame:
    """Save presets under a normalised key. Unusable changes are left out, extras are checked."""
    key = F.replace(F.lower(strip("key")), F.lit(" "), F.lit("_"))

    def ok(r: Column) -> Column:
        return valid_region(r["x_ratio"], r["y_ratio"], r["w_ratio"], r["h_ratio"])

    extras = F.coalesce("extra_regions", F.array().cast(changes.schema["extra_regions"].dataType))
    ready = changes.withColumn("key", key).where(
        (F.col("key") != "") & (F.length("key") <= 30) & F.col("name").isNotNull() & ok(F.col("sub_region"))
    ).withColumn("name", F.left("name", F.lit(50))).withColumn(
        "extra_regions", F.filter(F.slice(extras, 1, 2), ok)
    )
    rest = ["name", "sub_region", "extra_regions"]
    last = ready.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_p"))
    both = presets.join(last, "key", "full_outer")
    return both.select("key", *[F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def preset_delete(presets: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove presets; the default one stays."""
    gone = keys.where(F.col("key") != "default").select("key")
    return presets.join(gone, "key", "left_anti")


def history_add(history: DataFrame, done: DataFrame) -> DataFrame:
    new = done.where(~is_blank(F.col("work_id").cast("string"))).select("work_id")
    return history.select("work_id").union(new).distinct()


# ------------------------------------------------------------------- review, delivery


def review_save(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """Compare-and-swap: the first edit made on the current revision wins, others are stale."""
    current = edits.join(drafts.select("job_id", F.col("revision").alias("base_revision")), ["job_id", "base_revision"], "left_semi")
    first = current.groupBy("job_id").agg(F.min_by("content", "seq").alias("_content"))
    both = drafts.join(first, "job_id", "left")
    hit = F.col("_content").isNotNull()
    return both.select(
        "job_id", F.coalesce("_content", "content").alias("content"),
        (F.col("revision") + F.when(hit, 1).otherwise(0)).alias("revision"), hit.alias("accepted"),
    )


def delivery_step(jobs: DataFrame, results: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """One delivery round over due jobs: delivered, tried again later, or left to a person."""
    sized = files.select(F.col("path").alias("delivery_path"), F.col("size").alias("_size"))
    rows = jobs.join(sized, "delivery_path", "left").join(results.select("job_id", "sent"), "job_id", "left")
    tries = F.coalesce("attempts", F.lit(0))
    due = (F.col("delivery_status") == "pending") & (F.coalesce("next_attempt", F.lit(0)) <= now)
    stuck = F.col("_size").isNull() | (F.col("_size") > MAX_DELIVERY_BYTES) | (tries >= MAX_DELIVERY_ATTEMPTS)
    sent = F.coalesce("sent", F.lit(False))
    cols = {
        "delivery_status": F.when(due & stuck, "manual_required").when(due & sent, "delivered").otherwise(F.col("delivery_status")),
        "attempts": F.when(due & ~stuck, tries + 1).otherwise(F.col("attempts")).cast("int"),
        "next_attempt": F.when(due & ~stuck, F.lit(now) + backoff_seconds(tries)).otherwise(F.col("next_attempt")).cast("bigint"),
    }
    return rows.select(*[cols.get(c, F.col(c)).alias(c) for c in jobs.columns])
