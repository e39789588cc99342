"""Keyed state, jobs put together, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.feeds import NOW
from catalog.registry import CUES, ITEMS, JOBS, PHRASES, WORKS, big, query, with_
from catalog.scalars import MESSAGES_SQL, fusion_answers, message_frames, srt_docs
from catalog.tracks import CLOSED, RUNS, joined_sql, split_sql
from cueloom.adapters import (
    history_from_orders, items_from_lineitem, jobs_from_events, ledger_from_orders,
    phrases_from_conversations, table, works_from_orders,
)
from cueloom.operators import batches as B
from cueloom.operators import quality as Q
from cueloom.operators import state as S
from cueloom.plans import jobs as P
from cueloom.streaming import feeds as X

STAMP = "2024-02-02T00:00:00+00:00"

# ------------------------------------------------------------------------------- ledger


def full_ledger(spark, sf_dir):
    return ledger_from_orders(spark, sf_dir).select(
        "channel_id", "work_id", F.lit("u").alias("source_url"), F.lit("{}").alias("source_json"), "status",
        F.lit("a").alias("artifact_path"), F.lit(None).cast("string").alias("package_path"), "last_error", "attempts", "created_at",
        F.col("created_at").alias("updated_at"))


def asked_works(spark, sf_dir):
    return works_from_orders(spark, sf_dir).select(
        "channel_id", "work_id", F.concat(F.lit("w"), F.col("work_id").cast("string")).alias("source_url"), F.col("title").alias("source_json"))


CLAIM_SQL = with_(WORKS, "ask AS (SELECT * FROM works)") + f"""SELECT coalesce(l.channel_id, a.channel_id) AS channel_id, coalesce(l.work_id, a.work_id) AS work_id,
    CASE WHEN l.work_id IS NULL THEN 'w' || a.work_id ELSE 'u' END AS source_url, CASE WHEN a.work_id IS NOT NULL AND coalesce(l.status, '') NOT IN ('PROCESSING', 'PUBLISHED') THEN a.title ELSE '{{}}' END AS source_json,
    CASE WHEN a.work_id IS NOT NULL AND coalesce(l.status, '') NOT IN ('PROCESSING', 'PUBLISHED') THEN 'CLAIMED' ELSE l.status END AS status,
    CASE WHEN a.work_id IS NULL OR l.status IN ('PROCESSING', 'PUBLISHED') THEN l.last_error END AS last_error,
    CAST(CASE WHEN a.work_id IS NOT NULL AND coalesce(l.status, '') NOT IN ('PROCESSING', 'PUBLISHED') THEN coalesce(l.attempts, 0) + 1 ELSE l.attempts END AS INTEGER) AS attempts,
    coalesce(l.created_at, '{STAMP}') AS created_at FROM ledger l FULL OUTER JOIN ask a ON a.channel_id = l.channel_id AND a.work_id = l.work_id"""
CLAIM_COLUMNS = ["channel_id", "work_id", "source_url", "source_json", "status", "last_error", "attempts", "created_at"]


@query("ups1_ledger_claim", CLAIM_SQL)
def _claim(spark, sf_dir):
    return S.ledger_claim(full_ledger(spark, sf_dir), asked_works(spark, sf_dir), F.lit(STAMP)).select(*CLAIM_COLUMNS)


@query("ups2_ledger_mark", with_(WORKS) + """SELECT channel_id, work_id, CASE WHEN work_id % 3 = 0 THEN 'DONE' WHEN work_id % 3 = 1 THEN 'FAILED' ELSE status END AS status,
    CASE WHEN work_id % 3 = 1 THEN 'e2' WHEN work_id % 3 = 2 THEN last_error END AS last_error, CASE WHEN work_id % 3 = 0 THEN 'p1' ELSE 'a' END AS artifact_path FROM ledger""")
def _mark(spark, sf_dir):
    """Two marks per key: only the first one names a path."""
    rows = ledger_from_orders(spark, sf_dir).where("work_id % 3 < 2").select("channel_id", "work_id")
    none = F.lit(None).cast("string")
    zero = F.col("work_id") % 3 == 0
    first = rows.select("*", F.lit(1).alias("seq"), F.lit("X").alias("status"), F.lit("e1").alias("error"), F.when(zero, "p1").alias("artifact_path"), none.alias("package_path"))
    second = rows.select("*", F.lit(2).alias("seq"), F.when(zero, "DONE").otherwise("FAILED").alias("status"), F.when(~zero, "e2").alias("error"), none.alias("artifact_path"), none.alias("package_path"))
    return S.ledger_mark(full_ledger(spark, sf_dir), first.unionByName(second), F.lit(STAMP)).select("channel_id", "work_id", "status", "last_error", "artifact_path")


# --------------------------------------------------------------------------------- jobs

LATEST = """la AS (SELECT job_id, max(updated) AS updated, arg_max(status, row(updated, event_id)) AS status, arg_max(progress, row(updated, event_id)) AS progress,
  coalesce(max(event_id) FILTER (cancel) >= coalesce(max(event_id) FILTER (reset), -1), false) AS cancel, count(*) AS snapshots FROM jobs GROUP BY job_id)"""


@query("win25_latest_job_state", with_(JOBS, LATEST) + "SELECT * FROM la")
def _latest(spark, sf_dir):
    return S.latest_job_state(jobs_from_events(spark, sf_dir), ["status", "progress"], ["updated", "event_id"])


@query("ups3_job_upsert", with_(JOBS, LATEST) + "SELECT job_id, updated, status, progress, cancel FROM la")
def _upsert(spark, sf_dir):
    """A part of the log first, then the rest on top; a job's snapshots may lie in both in any order."""
    log = jobs_from_events(spark, sf_dir)
    args = (["status", "progress"], ["updated", "event_id"])
    early = S.latest_job_state(log.where("event_id % 100000 < 4000"), *args, marks=True).drop("snapshots")
    return S.job_upsert(early, log.where("event_id % 100000 >= 4000"), *args).drop(*S.MARKS)


def snapshots(spark, sf_dir):
    """Latest job rows with owner and a step state."""
    rows = S.latest_job_state(jobs_from_events(spark, sf_dir), ["status", "progress"], ["updated", "event_id"])
    state = F.when(F.col("status") == "error", "done").when(F.col("status") == "view", "processing").when(F.col("status") == "click", "partial").when(F.col("status") == "signup", "awaiting_review").otherwise("queued")
    return rows.select(
        F.format_string("job_%05d", "job_id").alias("job_id"), state.alias("status"), F.concat(F.lit("p"), (F.col("job_id") % 7).cast("string")).alias("owner"),
        "cancel", F.when(F.col("progress") % 5 == 0, F.create_map(F.lit("tts"), F.lit("generating"))).alias("steps"),
        (F.col("updated") / F.lit(1_000_000)).cast("bigint").alias("created_at"), F.when(F.col("progress") % 2 == 0, (F.col("updated") / F.lit(1_000_000)).cast("bigint") + 5).alias("completed_at"), "progress")


SNAP = """sn AS (SELECT printf('job_%05d', job_id) AS job_id, CASE status WHEN 'error' THEN 'done' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'partial' WHEN 'signup' THEN 'awaiting_review' ELSE 'queued' END AS status,
  job_id % 7 AS owner, cancel, progress % 5 = 0 AS stepping, updated // 1000000 AS created_at, CASE WHEN progress % 2 = 0 THEN updated // 1000000 + 5 END AS completed_at, progress FROM la)"""


def beats(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id % 7 < 4").select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("owner"))


@query("jn19_dead_owner", with_(JOBS, LATEST, SNAP) + """SELECT job_id, CASE WHEN stop THEN 'interrupted' ELSE status END AS status, stop AS stopped FROM (SELECT *, owner >= 4 AND (stepping OR status IN ('processing', 'queued')) AS stop FROM sn) x""")
def _dead(spark, sf_dir):
    return S.dead_owner(snapshots(spark, sf_dir), beats(spark, sf_dir)).select("job_id", "status", "stopped")


@query("agg21_active_jobs", with_(JOBS, LATEST, SNAP) + """SELECT job_id, CASE WHEN rest THEN status WHEN cancel THEN 'cancelled' WHEN owner >= 4 THEN 'interrupted' ELSE status END AS settled, NOT rest AND NOT cancel AND owner < 4 AS active FROM (SELECT *, status NOT IN ('processing', 'queued') AS rest FROM sn) x""")
def _active(spark, sf_dir):
    return S.active_jobs(snapshots(spark, sf_dir), beats(spark, sf_dir)).select("job_id", "settled", "active")


JOB_NOW, AGE, KEEP = 1_706_745_600, 86_400, 20
EVICT = f"""fi AS (SELECT *, coalesce(completed_at, created_at) AS fin FROM sn WHERE status IN ('done', 'partial') AND NOT stepping),
nw AS (SELECT job_id FROM fi ORDER BY fin DESC, job_id DESC LIMIT {KEEP}),
ev AS (SELECT job_id, fin AS finished_at, CASE WHEN {JOB_NOW} - fin > {AGE} THEN 'age' ELSE 'count' END AS reason FROM fi WHERE {JOB_NOW} - fin > {AGE} OR job_id NOT IN (SELECT job_id FROM nw))"""


@query("win26_evict_jobs", with_(JOBS, LATEST, SNAP, EVICT) + "SELECT * FROM ev")
def _evict(spark, sf_dir):
    return S.evict_jobs(snapshots(spark, sf_dir), JOB_NOW, AGE, KEEP)


@query("agg18_job_view", with_(JOBS, LATEST, SNAP) + "SELECT job_id, status, progress, '' AS message, 'step' AS active_step, '' AS original_name, created_at FROM sn")
def _view(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = snapshots(spark, sf_dir).withColumn("message", none).withColumn("active_step", F.lit("step")).withColumn("original_name", none)
    return S.job_view(rows)


@query("set2_all_job_ids", with_(JOBS) + "SELECT DISTINCT job_id FROM jobs")
def _ids(spark, sf_dir):
    log = jobs_from_events(spark, sf_dir)
    return S.all_job_ids(log.where("status = 'view'"), log.where("status <> 'view'"))


def artifact_files(spark, sf_dir):
    """Events as result files of their user's job, in folders or by file name."""
    job = F.format_string("job_%05d", "user_id")
    n = F.col("event_id").cast("string")
    path = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/out/"), job, F.lit("/"), n, F.lit(".mp4")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("/out/"), job, F.lit("_burned_"), n, F.lit(".mp4")))
        .otherwise(F.concat(F.lit("/up/"), n, F.lit("/"), job, F.lit("/source.mp4"))))
    return table(spark, sf_dir, "events").select(path.alias("path"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("mtime"), F.floor("value").cast("bigint").alias("size"))


FILES = """fs AS (SELECT CASE event_id % 3 WHEN 0 THEN '/out/' || printf('job_%05d', user_id) || '/' || event_id || '.mp4' WHEN 1 THEN '/out/' || printf('job_%05d', user_id) || '_burned_' || event_id || '.mp4'
  ELSE '/up/' || event_id || '/' || printf('job_%05d', user_id) || '/source.mp4' END AS path, printf('job_%05d', user_id) AS jid, epoch_us(ts) // 1000000 AS mtime, event_id FROM events),
act AS (SELECT job_id FROM sn WHERE status NOT IN ('done', 'partial') OR stepping)"""
EXPIRED = f"ex AS (SELECT path FROM fs WHERE {JOB_NOW} - mtime > CASE WHEN event_id % 3 < 2 THEN 864000 ELSE 172800 END AND jid NOT IN (SELECT job_id FROM act))"
ROOTS = {"/out": 864_000, "/up": 172_800}


@query("jn20_expired_files", with_(JOBS, LATEST, SNAP, FILES, EXPIRED) + "SELECT path FROM ex")
def _expired(spark, sf_dir):
    return S.expired_files(artifact_files(spark, sf_dir), snapshots(spark, sf_dir), ROOTS, JOB_NOW).select("path")


@query("job9_retention_report", with_(JOBS, LATEST, SNAP, FILES, EXPIRED, EVICT) + "SELECT 'file' AS kind, path AS name FROM ex UNION ALL SELECT 'job', job_id FROM ev")
def _retention(spark, sf_dir):
    return P.retention_report(artifact_files(spark, sf_dir), snapshots(spark, sf_dir), ROOTS, JOB_NOW, AGE, KEEP)


@query("jn16_missing_artifacts", with_(JOBS, LATEST, SNAP) + """, m AS (SELECT printf('job_%05d', user_id) AS job_id, count(*) AS missing FROM events WHERE event_id % 10 = 0 GROUP BY 1)
    SELECT sn.job_id, coalesce(missing, 0) AS missing, CASE WHEN missing > 0 AND status = 'done' THEN 'partial' ELSE status END AS status FROM sn LEFT JOIN m USING (job_id)""")
def _artifacts(spark, sf_dir):
    declared = table(spark, sf_dir, "events").select(F.format_string("job_%05d", "user_id").alias("job_id"), F.concat(F.lit("/out/"), F.col("event_id").cast("string")).alias("path"), "event_id")
    files = declared.where("event_id % 10 > 0").select("path")
    return S.missing_artifacts(snapshots(spark, sf_dir), declared.drop("event_id"), files).select("job_id", "missing", "status")


# ------------------------------------------------------------------- channels, presets

STORED = """st AS (SELECT 'C' || c_custkey AS channel_id, c_name AS nickname, '' AS sec_uid, 'vi' AS target_lang, 'movie' AS style, c_acctbal > 0 AS enabled, c_custkey AS last_check FROM customer WHERE c_custkey % 2 = 0)"""


def stored_channels(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("channel_id"), F.col("c_name").alias("nickname"), F.lit("").alias("sec_uid"),
        F.lit("vi").alias("target_lang"), F.lit("movie").alias("style"), (F.col("c_acctbal") > 0).alias("enabled"), F.col("c_custkey").alias("last_check"))


@query("ups4_channel_upsert", with_(STORED) + """, ch AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'new name' ELSE '' END AS nick FROM customer WHERE c_custkey % 3 = 0)
    SELECT coalesce(channel_id, 'c' || k) AS channel_id, coalesce(nullif(nick, ''), nickname, 'c' || k) AS nickname, CASE WHEN k IS NOT NULL THEN 'en' ELSE target_lang END AS target_lang, k IS NOT NULL OR enabled AS enabled, coalesce(last_check, 0) AS last_check
    FROM st FULL OUTER JOIN ch ON channel_id = 'C' || k""")
def _channels(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    cid = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    first = rows.select(cid.alias("channel_id"), F.when(F.col("c_custkey") % 5 == 0, "new name").otherwise("").alias("nickname"), F.lit("").alias("sec_uid"), F.lit("id").alias("target_lang"), F.lit("fun").alias("style"), F.lit(1).alias("seq"))
    second = first.withColumn("channel_id", F.concat(F.lit(" "), cid_upper())).withColumn("nickname", F.lit(" ")).withColumn("target_lang", F.lit("en")).withColumn("seq", F.lit(2))
    out = S.channel_upsert(stored_channels(spark, sf_dir), first.unionByName(second))
    return out.select("channel_id", "nickname", "target_lang", "enabled", "last_check")


def cid_upper():
    return F.upper("channel_id")


@query("ups4_channel_remove", with_(STORED) + "SELECT channel_id, nickname FROM st WHERE last_check % 3 > 0")
def _remove(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("channel_id"))
    return S.channel_remove(stored_channels(spark, sf_dir), gone).select("channel_id", "nickname")


@query("ups4_channel_patch", with_(STORED) + "SELECT channel_id, CASE WHEN last_check % 3 = 0 THEN 'literal' ELSE style END AS style, CASE WHEN last_check % 3 = 0 THEN false ELSE enabled END AS enabled FROM st")
def _patch(spark, sf_dir):
    patches = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("channel_id"), F.lit("literal").alias("style"), F.lit(False).alias("enabled"), F.lit(1).alias("seq"))
    return S.channel_patch(stored_channels(spark, sf_dir), patches).select("channel_id", "style", "enabled")


@query("ups5_preset_upsert", """WITH u AS (SELECT 'p_' || p_partkey % 50 AS key, arg_max(left(p_name || p_partkey, 50), p_partkey) AS name, max(p_partkey) AS n FROM part WHERE p_partkey % 7 > 0 GROUP BY 1)
    SELECT 'p_' || p_partkey AS key, coalesce(u.name, 'old') AS name, CAST(CASE WHEN u.key IS NULL THEN 0 ELSE 1 END AS INTEGER) AS extras FROM part LEFT JOIN u ON u.key = 'p_' || p_partkey""")
def _presets(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    region = lambda w: F.struct(*[F.lit(v).alias(k) for k, v in (("x_ratio", 0.1), ("y_ratio", 0.2))], w.alias("w_ratio"), F.lit(0.3).alias("h_ratio"))
    good, wide = region(F.lit(0.5)), region(F.lit(0.95))
    old = part.select(F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("key"), F.lit("old").alias("name"), good.alias("sub_region"), F.slice(F.array(good), 1, 0).alias("extra_regions"))
    changes = part.select(F.concat(F.lit(" P "), (F.col("p_partkey") % 50).cast("string")).alias("key"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"),
                          F.when(F.col("p_partkey") % 7 > 0, good).otherwise(wide).alias("sub_region"), F.array(wide, good, good).alias("extra_regions"), F.col("p_partkey").alias("seq"))
    return S.preset_upsert(old, changes).select("key", "name", F.size("extra_regions").alias("extras"))


@query("ups5_preset_delete", "SELECT DISTINCT p_brand AS key FROM part WHERE p_brand <> 'Brand#1'")
def _preset_delete(spark, sf_dir):
    presets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct()
    return S.preset_delete(presets, presets.where("key IN ('Brand#1', 'default')"))


@query("ups6_history_add", with_(WORKS) + "SELECT work_id FROM history UNION SELECT work_id FROM works")
def _history(spark, sf_dir):
    return S.history_add(history_from_orders(spark, sf_dir), works_from_orders(spark, sf_dir))


@query("ups7_review_save", """WITH e AS (SELECT l_orderkey AS job_id, min(l_partkey * 1000 + l_suppkey) AS seq FROM lineitem WHERE l_linenumber = 3 GROUP BY 1)
    SELECT o_orderkey AS job_id, CASE WHEN e.job_id IS NULL THEN 'draft' ELSE 'edit ' || seq END AS content, CAST(3 + CASE WHEN e.job_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS revision, e.job_id IS NOT NULL AS accepted FROM orders LEFT JOIN e ON e.job_id = o_orderkey""")
def _review(spark, sf_dir):
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("draft").alias("content"), F.lit(3).alias("revision"))
    seq = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("base_revision"), seq.alias("seq"), F.concat(F.lit("edit "), seq.cast("string")).alias("content"))
    return S.review_save(drafts, edits)


def delivery_jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "delivered").otherwise("pending").alias("delivery_status"),
        F.col("o_orderkey").cast("string").alias("delivery_path"), (F.col("o_custkey") % 7).cast("int").alias("attempts"), (F.lit(1000) + F.col("o_orderkey") % 3).cast("bigint").alias("next_attempt"))


def delivery_files(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").cast("string").alias("path"), big(F.floor(F.col("o_totalprice") * 120)).alias("size"))


DELIVERY = """SELECT job_id, CASE WHEN due AND stuck THEN 'manual_required' WHEN due AND sent THEN 'delivered' ELSE st END AS delivery_status, CAST(CASE WHEN due AND NOT stuck THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
    CASE WHEN due AND NOT stuck THEN 1001 + CAST(least(86400, 3600 * pow(2, attempts)) AS BIGINT) ELSE nx END AS next_attempt FROM (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'delivered' ELSE 'pending' END AS st, o_custkey % 7 AS attempts, 1000 + o_orderkey % 3 AS nx,
    o_orderstatus <> 'P' AND o_orderkey % 3 <= 1 AS due, o_orderkey % 5 = 0 OR floor(o_totalprice * 120) > 51904512 OR o_custkey % 7 >= 5 AS stuck, o_orderkey % 2 = 0 AS sent FROM orders) x"""


@query("ups10_delivery_step", DELIVERY)
def _delivery(spark, sf_dir):
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 2 == 0).alias("sent"))
    return S.delivery_step(delivery_jobs(spark, sf_dir), results, delivery_files(spark, sf_dir), 1001).drop("delivery_path")


# ----------------------------------------------------------------------------- packages


def package_items(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("source").alias("batch_id"), F.col("doc_id").cast("string").alias("item_id"), F.sha2("text", 256).alias("source_sha256"), F.sha2("lang", 256).alias("video_sha256"),
        F.when(F.col("lang") != "es", F.col("n_chars")).otherwise(0).alias("video_bytes"), F.when(F.col("quality") == 1, " Licensed").when(F.col("quality") == 0, "").alias("channel_rights"),
        (F.col("doc_id") % 5 > 0).alias("strict"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("fallback_used"))


PACKAGES = """pk AS (SELECT d.doc_id, 'dysrt_' || left(sha256(source || '|' || d.doc_id || '|' || sha256(text) || '|' || sha256(lang)), 24) AS package_id, CASE WHEN quality = 1 THEN 'licensed' ELSE 'review_required' END AS rights_status,
  d.doc_id % 5 > 0 AND NOT coalesce(toxic = 1, false) AS ok FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang <> 'es' AND n_chars > 0)"""


@query("job4_publish_gate", with_(PACKAGES) + """SELECT package_id, rights_status, CASE WHEN ok THEN 'approved' ELSE 'awaiting_review' END AS review_status, CASE WHEN ok AND rights_status = 'licensed' THEN 'passed' ELSE 'review_required' END AS qc_status,
    CASE doc_id % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'collision' ELSE 'new' END AS outcome FROM pk""")
def _gate(spark, sf_dir):
    items = package_items(spark, sf_dir)
    packages = Q.publish_packages(items)
    stored = packages.withColumn("_n", F.col("item_id").cast("bigint") % 3).where("_n < 2").select(
        "package_id", F.when(F.col("_n") == 0, Q.payload_hash(packages)).otherwise("other").alias("payload_sha256"))
    return P.publish_gate(items, stored).select("package_id", "rights_status", "review_status", "qc_status", "outcome")


@query("snk6_emit_packages", with_(PACKAGES) + "SELECT count(*) AS packages, CAST(0 AS BIGINT) AS fresh, CAST(0 AS BIGINT) AS collisions FROM pk")
def _emit(spark, sf_dir):
    """A second emission of the same packages changes nothing, whatever the clock says."""
    packages = Q.publish_packages(package_items(spark, sf_dir)).withColumn("created_at", F.lit("first"))
    stored = packages.select("package_id", Q.payload_hash(packages).alias("payload_sha256"))
    again = Q.emit_packages(stored, packages.withColumn("created_at", F.lit("second")))
    return again.agg(F.count(F.lit(1)).alias("packages"), F.count_if(F.col("outcome") == "new").alias("fresh"), F.count_if(F.col("outcome") == "collision").alias("collisions"))


@query("agg17_package_collisions", with_(PACKAGES) + "SELECT package_id, CAST(2 AS BIGINT) AS rows FROM pk WHERE doc_id % 4 = 0")
def _collisions(spark, sf_dir):
    packages = Q.publish_packages(package_items(spark, sf_dir))
    other = packages.where("item_id % 4 < 2").withColumn("rights_status", F.when(F.col("item_id") % 4 == 0, "changed").otherwise(F.col("rights_status")))
    return Q.package_collisions(packages.unionByName(other))


# --------------------------------------------------------------------------------- jobs


def fallback_fusion(spark, sf_dir):
    return P.fuse_corpus(phrases_from_conversations(spark, sf_dir), fusion_answers(spark, sf_dir, broken=True), "en")


FUSED_PARTS = (PHRASES, """g AS (SELECT track_id, (cue_id - 1) // 2 AS gn, min(start_ms) AS s, max(end_ms) AS e, arg_max(start_ms, cue_id) - arg_min(end_ms, cue_id) AS pause, count(*) AS n FROM cues GROUP BY ALL),
    w AS (SELECT track_id, bool_or((track_id % 5 <> 1 OR gn <> 3) AND ((n > 1 AND pause > 800) OR e - s > 10000)) AS slow, bool_or(track_id % 5 = 2 AND gn = 2) AS dup, bool_or(track_id % 5 = 1 AND gn = 3) AS gone FROM g GROUP BY track_id)""")


@query("job1_fuse_status", with_(*FUSED_PARTS) + "SELECT track_id, slow OR dup OR gone AS used_fallback FROM w")
def _fuse_status(spark, sf_dir):
    return fallback_fusion(spark, sf_dir).status.select("track_id", "used_fallback")


# Tracks whose answer keeps the contract take its groups, the others are grouped by their own cues.
FUSED = with_(*FUSED_PARTS, f"""ow AS (SELECT track_id, cue_id, cue_id AS g, start_ms AS gs, end_ms AS ge, text AS t FROM cues WHERE cue_id = 1
    UNION ALL SELECT track_id, cue_id, CASE WHEN m THEN g ELSE cue_id END, CASE WHEN m THEN gs ELSE start_ms END, end_ms, CASE WHEN m THEN t || text ELSE text END
    FROM (SELECT c.*, r.g, r.gs, r.t, c.start_ms - r.ge BETWEEN 0 AND 350 AND c.end_ms - r.gs <= 6000 AND length(r.t || c.text) <= 52 AND NOT {CLOSED.format('r.t')} AS m
      FROM ow r JOIN cues c ON c.track_id = r.track_id AND c.cue_id = r.cue_id + 1) x),
    fu AS (SELECT track_id, (cue_id - 1) // 2 + 1 AS group_no, arg_min(text, cue_id) AS text, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms
      FROM cues WHERE track_id IN (SELECT track_id FROM w WHERE NOT (slow OR dup OR gone)) GROUP BY ALL
      UNION ALL SELECT track_id, g, arg_max(t, cue_id), 'M1', min(gs), arg_max(ge, cue_id) FROM ow WHERE track_id IN (SELECT track_id FROM w WHERE slow OR dup OR gone) GROUP BY track_id, g)""",
    split_sql("fu", "st"), joined_sql("st", "ds", True), joined_sql("ds", "tt", False), recursive=True)


@query("job1_fuse_display", FUSED + 'SELECT track_id, group_no, part, text AS translation, speaker, start_ms, end_ms FROM ds')
def _fuse_display(spark, sf_dir):
    return fallback_fusion(spark, sf_dir).display.select("track_id", "group_no", "part", "translation", "speaker", "start_ms", "end_ms")


@query("job1_fuse_tts", FUSED + 'SELECT track_id, group_no, part, text AS translation, speaker, start_ms, end_ms FROM tt')
def _fuse_tts(spark, sf_dir):
    return fallback_fusion(spark, sf_dir).tts.select("track_id", "group_no", "part", "translation", "speaker", "start_ms", "end_ms")


@query("job2_strict_gate", with_(ITEMS) + """SELECT batch_id, line, part, supp, NOT bad AS passed, CASE WHEN bad THEN array_to_string(list_filter([CASE WHEN progress % 4 > 0 THEN 'fallback ' || progress % 4 END, CASE WHEN line % 3 > 0 THEN 'unchanged ' || line % 3 END,
    CASE WHEN status = 'partial' THEN 'needs review' END, CASE WHEN status = 'failed' THEN 'provider said no' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM
    (SELECT *, part % 2 = 0 AND supp % 3 > 0 AND ((supp % 2 = 0 AND (progress % 4 > 0 OR status = 'failed')) OR line % 3 > 0 OR status = 'partial') AS bad FROM items) x""")
def _strict(spark, sf_dir):
    rows = items_from_lineitem(spark, sf_dir).select(
        "batch_id", "line", "part", "supp", (F.col("part") % 2 == 0).alias("strict"), (F.col("supp") % 3 == 0).alias("allow_partial"), F.when(F.col("supp") % 2 == 0, "ai").otherwise("google").alias("method"),
        (F.col("progress") % 4).alias("fallbacks"), (F.col("line") % 3).alias("unchanged"), (F.col("status") == "partial").alias("needs_review"), F.when(F.col("status") == "failed", "provider said no").alias("warning"))
    return B.strict_gate(rows).select("batch_id", "line", "part", "supp", "passed", "reasons")


@query("job3_review_routing", with_(ITEMS) + """SELECT batch_id, line, part, supp, route, CASE WHEN route <> 'continue' THEN reason END AS reason FROM (SELECT *, CASE WHEN u > 0 AND NOT later THEN 'partial' WHEN reason IS NOT NULL AND later THEN 'awaiting_review' ELSE 'continue' END AS route FROM
    (SELECT *, CASE WHEN u > 0 THEN 'untranslated' WHEN line % 5 > 2 THEN 'fallback_lines' WHEN status = 'failed' THEN 'fusion_fallback' WHEN status = 'partial' THEN 'fusion_review' WHEN supp % 2 = 0 THEN 'requested' END AS reason FROM
    (SELECT *, progress % 3 AS u, part % 2 = 0 OR part % 3 = 0 AS later FROM items) x) y) z""")
def _routing(spark, sf_dir):
    rows = items_from_lineitem(spark, sf_dir).select(
        "batch_id", "line", "part", "supp", (F.col("supp") % 2 == 0).alias("pause"), (F.col("progress") % 3).alias("untranslated"), F.greatest(F.lit(0), F.col("line") % 5 - 2).alias("fallbacks"),
        (F.col("status") == "failed").alias("fusion_fallback"), (F.col("status") == "partial").alias("fusion_review"), (F.col("part") % 2 == 0).alias("tts"), (F.col("part") % 3 == 0).alias("burn"))
    return P.review_routing(rows).select("batch_id", "line", "part", "supp", "route", "reason")


@query("job5_reconcile_completion", """SELECT 'job' || o_orderkey AS job_id, CASE WHEN ok THEN 'done' ELSE st END AS status, ok AS recovered FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' WHEN o_orderstatus = 'F' THEN 'processing' ELSE 'queued' END AS st,
    length('job' || o_orderkey) >= 6 AND o_orderstatus <> 'O' AND o_custkey % 11 > 0 AND (o_custkey % 2 = 0 OR o_custkey % 3 > 0) AND o_custkey % 5 > 0 AND o_custkey % 7 > 0 AS ok FROM orders) x""")
def _reconcile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("job_id", F.concat(F.lit("job"), F.col("o_orderkey").cast("string"))).withColumn("path", F.concat(F.lit("/out/"), F.col("job_id"), F.lit("/final.mp4")))
    c = F.col("o_custkey")
    jobs = orders.select(
        "job_id", F.when(F.col("o_orderstatus") == "P", "interrupted").when(F.col("o_orderstatus") == "F", "processing").otherwise("queued").alias("status"), F.lit("step_5_burn").alias("active_step"),
        (c % 11 == 0).alias("cancel"), F.lit("en").alias("lang"), F.create_map(F.lit("burn_sub"), F.lit(True), F.lit("tts"), c % 2 > 0).alias("steps"),
        F.create_map(F.lit("tts"), F.when(c % 3 > 0, "done").otherwise("error")).alias("results"), F.lit("done").alias("render_status"), F.col("path").alias("render_path"), (c + 1).alias("render_size"))
    files = orders.where("o_custkey % 5 > 0").select("path", (c + 1).alias("size"), F.lit(1000.0).alias("mtime"))
    probes = orders.select("path", F.when(c % 7 > 0, 3.5).alias("duration_s"), F.lit(True).alias("has_video"), F.lit(True).alias("has_audio"))
    return P.reconcile_completion(jobs, files, probes, 2000, "/out").select("job_id", "status", "recovered")


@query("job6_source_selection", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'provided' WHEN v THEN 'vision_estimate' WHEN a THEN 'audio_estimate' END AS origin, CASE WHEN doc_id % 7 = 0 THEN 'side' WHEN v THEN text WHEN a THEN lang END AS content FROM
    (SELECT *, doc_id % 3 < 2 AND doc_id % 4 > 0 AS v, doc_id % 3 > 0 AND doc_id % 5 > 0 AS a FROM documents) x""")
def _selection(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(n % 3 == 0, "gemini").when(n % 3 == 1, "hybrid").otherwise("whisper").alias("engine"), F.when(n % 7 == 0, "side").alias("sidecar"),
        F.when(n % 4 > 0, F.col("text")).alias("vision"), F.when(n % 5 > 0, F.col("lang")).alias("audio"))
    return P.source_selection(rows).select("doc_id", "origin", "content")


@query("job7_display_to_tts", with_(PHRASES, """lo AS (SELECT track_id, cue_id AS group_no, text, CASE WHEN cue_id % 5 > 0 THEN upper(speaker) ELSE 'M1' END AS speaker, start_ms, end_ms FROM cues)""",
    split_sql("lo", "st"), joined_sql("st", "ds", True), joined_sql("ds", "tt", False), recursive=True) +
    "SELECT track_id, group_no, part, text AS translation, speaker, start_ms, end_ms FROM tt")
def _display_to_tts(spark, sf_dir):
    speakers = phrases_from_conversations(spark, sf_dir).where("cue_id % 5 > 0").select("track_id", F.col("cue_id").alias("position"), "speaker")
    out = P.display_to_tts(srt_docs(spark, sf_dir), speakers)
    return out.select("track_id", "group_no", "part", "translation", "speaker", "start_ms", "end_ms")


@query("job8_retry_plan", """SELECT o_orderkey, o_orderstatus <> 'O' AS retry, o_custkey % 2 = 0 AND NOT (o_custkey % 3 > 0 AND (o_custkey % 4 = 0 OR o_custkey % 5 = 0)) AS run_extract_sub, o_custkey % 7 > 0 AND o_custkey % 6 = 0 AS run_download, NOT (o_custkey % 6 > 0 AND o_custkey % 8 = 0) AS run_clean_video,
    CASE WHEN o_custkey % 6 > 0 AND o_custkey % 8 = 0 THEN 'pure_burn' END AS render_mode FROM orders""")
def _retry(spark, sf_dir):
    c = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderstatus") == "F", "error").otherwise("processing").alias("status"), (c % 3 > 0).alias("srt_present"), (c % 4).alias("unchanged"),
        (c % 5 == 0).alias("edited"), (c % 6 > 0).alias("video_present"), (c % 8 == 0).alias("clean_is_video"), (c % 2 == 0).alias("extract_sub"), (c % 7 > 0).alias("download"), F.lit(True).alias("clean_video"))
    return P.retry_plan(rows).select("o_orderkey", "retry", "run_extract_sub", "run_download", "run_clean_video", "render_mode")


@query("udf2_run_items", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'no input' END AS error, CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 2 END AS made FROM orders")
def _run(spark, sf_dir):
    def work(item):
        if item["o_orderstatus"] == "P":
            raise ValueError("no input")
        return {"made": item["o_custkey"] * 2}

    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return P.run_items(items, work, "made long").select("o_orderkey", "status", "error", "made")


@query("udf3_translate_batches", with_(PHRASES) + "SELECT track_id, (cue_id - 1) // 15 AS batch_no, string_agg(((cue_id - 1) % 15 + 1) || '. ' || text, chr(10) ORDER BY cue_id) AS raw, CAST(NULL AS VARCHAR) AS error FROM cues GROUP BY ALL")
def _translate(spark, sf_dir):
    from cueloom.operators.cues import batch_by_count

    batched = batch_by_count(phrases_from_conversations(spark, sf_dir))
    return P.translate_batches(batched, lambda lines: "\n".join(f"{i}. {t}" for i, t in enumerate(lines, 1)))


@query("udf6_parse_srt_table_function", with_(PHRASES) + "SELECT track_id, CAST(cue_id AS INTEGER) AS pos, text FROM cues")
def _udtf(spark, sf_dir):
    from cueloom.functions.srt import register_udtf

    register_udtf(spark)
    srt_docs(spark, sf_dir).createOrReplaceTempView("srt_docs")
    return spark.sql("""
        SELECT track_id, CAST(pos + coalesce(before, 0) AS INT) AS pos, text
        FROM srt_docs JOIN (
          SELECT track_id, part, sum(count(*)) OVER (PARTITION BY track_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM srt_docs, LATERAL parse_srt(content) GROUP BY track_id, part) USING (track_id, part), LATERAL parse_srt(content)""")


# ------------------------------------------------------------------------------ streams


@query("stm1_monitor_stream", with_(WORKS) + f"SELECT work_id, channel_id FROM works WHERE CAST(create_time - work_id % 86400 AS BIGINT) >= {NOW - 24 * 400 * 3600}")
def _monitor(spark, sf_dir):
    rows = X.file_stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("channel_id"), F.col("o_orderdate").alias("create_ts"))
    # The feed repeats every work on a second page.
    pages = rows.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
    return X.append_all(X.monitor_stream(pages, NOW, 24 * 400).select("work_id", "channel_id"), "monitor")


def zoned(rows):
    """Times without a zone as timestamps."""
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


@query("stm2_claim_stream", CLAIM_SQL)
def _claim_stream(spark, sf_dir):
    # The feed shows a work again half a year later, in another batch.
    shown = table(spark, sf_dir, "orders").withColumn("shown", F.explode(F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 180))))
    rows = X.sliced_stream(shown, "shown").select(
        F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("work_id"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("source_url"), F.concat(F.lit("work "), F.col("o_orderpriority")).alias("source_json"))
    return X.claim_stream(rows, full_ledger(spark, sf_dir), F.lit(STAMP)).select(*CLAIM_COLUMNS)


SESSION = """d AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM d),
se AS (SELECT user_id AS track_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, n)"""


def _session_columns(df):
    return df.select("track_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("stm3_session_cues", with_(SESSION) + "SELECT * FROM se")
def _session(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _session_columns(X.session_cues(rows, "6 hours"))


@query("stm3_session_stream", with_(SESSION) + "SELECT * FROM se WHERE end_us <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)")
def _session_stream(spark, sf_dir):
    """Only sessions the watermark has passed are final."""
    rows = X.file_stream(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts").withWatermark("ts", "0 seconds")
    return _session_columns(X.append_all(X.session_cues(rows, "6 hours"), "sessions"))


HOPS = """h AS (SELECT epoch_us(ts) AS t, epoch_us(ts) // 60000000 * 60000000 AS w FROM events), x AS (SELECT w, t FROM h UNION ALL SELECT w - 60000000, t FROM h WHERE t - w < 1000000)"""


@query("stm4_hop_windows", with_(HOPS) + "SELECT w AS start_us, w + 61000000 AS end_us, count(*) AS events FROM x GROUP BY w HAVING w + 61000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)")
def _hops(spark, sf_dir):
    rows = X.file_stream(spark, sf_dir, "events").withWatermark("ts", "0 seconds")
    return X.append_all(X.hop_windows(rows), "hops").select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("stm5_tumbling_energy", """SELECT user_id AS track_id, epoch_us(ts) // 50000 * 50000 AS start_us, sqrt(avg(CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) * CAST(floor(value) AS BIGINT))) AS rms, count(*) AS samples FROM events
    GROUP BY 1, 2 HAVING start_us + 50000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)""")
def _tumbling(spark, sf_dir):
    rows = X.file_stream(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts", big(F.floor("value")).alias("v")).withWatermark("ts", "0 seconds")
    return X.append_all(X.tumbling_energy(rows), "energy").select("track_id", F.unix_micros("start").alias("start_us"), "rms", "samples")


@query("stm6_run_confirm_stream", with_(CUES, RUNS) + "SELECT track_id, start_ms, end_ms, frames, has_unknown FROM runs")
def _run_stream(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3)
    start = F.floor((F.unix_micros("ts") - F.lit(1_704_067_200_000_000)) / F.lit(60_000)).cast("bigint")
    frames = X.sliced_stream(zoned(table(spark, sf_dir, "events")), "event_id").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_no"), start.alias("t_ms"), kind.cast("bigint").alias("pattern_id"), (F.col("event_type") == "purchase").alias("known"))
    return X.run_confirm_stream(frames)


@query("stm7_job_state_stream", with_(JOBS, LATEST) + "SELECT job_id, updated, status, progress, cancel FROM la")
def _job_stream(spark, sf_dir):
    log = X.sliced_stream(zoned(table(spark, sf_dir, "events")), "ts").select(
        F.col("user_id").alias("job_id"), F.unix_micros("ts").alias("updated"), "event_id", F.col("event_type").alias("status"), F.floor("value").cast("int").alias("progress"),
        (F.col("event_type") == "error").alias("cancel"), (F.col("event_type") == "signup").alias("reset"))
    start = spark.createDataFrame([], "job_id bigint, updated bigint, status string, progress int, cancel boolean")
    return X.job_state_stream(log, ["status", "progress"], ["updated", "event_id"], start)


@query("stm8_message_stream", MESSAGES_SQL)
def _message_stream(spark, sf_dir):
    """Frames are written as JSON lines first, then read as a stream."""
    from cueloom.sources.readers import read_messages

    base = X.run_folder(spark, "frames")
    message_frames(spark, sf_dir).write.json(base)
    return X.append_all(read_messages(spark, base), "messages")


@query("stm9_chunk_arrivals", """WITH rc AS (SELECT l_orderkey AS session_id, CAST(l_linenumber + l_partkey % 4 - 1 AS BIGINT) AS i, l_shipdate AS ts FROM lineitem WHERE l_linenumber + l_partkey % 4 - 1 < 3),
    w AS (SELECT session_id, i, min(ts) AS ts FROM rc GROUP BY ALL), s AS (SELECT session_id, min(ts) AS since FROM w GROUP BY ALL), m AS (SELECT max(ts) AS now FROM rc),
    k AS (SELECT session_id, since, count(*) FILTER (ts <= since + INTERVAL 45 DAY) AS received FROM w JOIN s USING (session_id) GROUP BY ALL)
    SELECT session_id, received, CASE WHEN received = 3 THEN 'complete' ELSE 'expired' END AS event FROM k, m WHERE received = 3 OR now > since + INTERVAL 45 DAY""")
def _arrivals(spark, sf_dir):
    """Slices of time, so that most sessions have receipts in several batches."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    rows = X.sliced_stream(zoned(lines), "l_shipdate", slices=4).select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") + F.col("l_partkey") % 4 - 1).alias("chunk_index"), F.lit(3).cast("bigint").alias("total_chunks"), F.col("l_shipdate").alias("ts"))
    return X.chunk_arrivals(rows, ttl_s=45 * 86_400, mark_ttl_s=10_000 * 86_400)


@query("stm10_delivery_timer", """WITH RECURSIVE j AS (
      SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'delivered' ELSE 'pending' END AS st, CAST(o_custkey % 7 AS BIGINT) AS tries, CAST(1000 + o_orderkey % 3 AS BIGINT) AS nx,
        o_orderkey % 5 = 0 OR floor(o_totalprice * 120) > 51904512 AS unfit, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS good FROM orders
      UNION ALL
      SELECT job_id, CASE WHEN unfit OR tries >= 5 THEN 'manual_required' WHEN tries >= good THEN 'delivered' ELSE 'pending' END, CASE WHEN unfit OR tries >= 5 THEN tries ELSE tries + 1 END,
        CASE WHEN unfit OR tries >= 5 THEN nx ELSE nx + CAST(least(86400, 3600 * pow(2, tries)) AS BIGINT) END, unfit, good
      FROM j WHERE st = 'pending' AND nx <= (SELECT max(1001 + r_regionkey * 20000) FROM region)),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY st = 'pending', tries DESC) AS k FROM j)
    SELECT job_id, st AS delivery_status, CAST(tries AS INTEGER) AS attempts, nx AS next_attempt FROM r WHERE k = 1""")
def _timer(spark, sf_dir):
    """Five ticks over a day in three batches: some jobs are tried again and again, some until a person has to look."""
    ticks = X.sliced_stream(table(spark, sf_dir, "region"), "r_regionkey").select((F.lit(1001) + F.col("r_regionkey") * 20_000).cast("bigint").alias("now"))
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 4 == 0, 0).when(F.col("o_orderkey") % 4 == 1, 3).alias("sent_from"))
    return X.delivery_timer(ticks, delivery_jobs(spark, sf_dir), results, delivery_files(spark, sf_dir)).drop("delivery_path")
