"""Works, channels, batches and translated lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUES, ITEMS, PHRASES, WORKS, big, query, sql_round, with_
from catalog.scalars import MEDIA_LINK, media_link, raw_works
from cueloom.adapters import (
    cues_from_events, history_from_orders, items_from_lineitem, ledger_from_orders, phrases_from_conversations,
    table, works_from_orders,
)
from cueloom.operators import batches as B
from cueloom.operators import quality as Q
from cueloom.operators import works as W
from cueloom.sources import readers, sinks

NOW = 1_009_843_200  # the end of the order calendar
HOURS = 24 * 400

# ------------------------------------------------------------------------------- works


@query("jn1_anti_history", with_(WORKS) + "SELECT work_id, channel_id FROM works WHERE work_id NOT IN (SELECT work_id FROM history)")
def _anti(spark, sf_dir):
    return W.anti_history(works_from_orders(spark, sf_dir), history_from_orders(spark, sf_dir)).select("work_id", "channel_id")


@query("jn2_claimable", with_(WORKS) + "SELECT w.channel_id, w.work_id FROM works w LEFT JOIN ledger l USING (channel_id, work_id) WHERE l.status IS NULL OR l.status = 'FAILED'")
def _claimable(spark, sf_dir):
    return W.claimable(works_from_orders(spark, sf_dir), ledger_from_orders(spark, sf_dir)).select("channel_id", "work_id")


@query("flt4_recent_unseen", with_(WORKS) + f"SELECT work_id, create_time FROM works WHERE create_time >= {NOW - HOURS * 3600} AND work_id NOT IN (SELECT work_id FROM history)")
def _recent(spark, sf_dir):
    return W.recent_unseen(works_from_orders(spark, sf_dir), history_from_orders(spark, sf_dir), NOW, HOURS).select("work_id", "create_time")


@query("flt5_catalog_search", with_(WORKS) + f"SELECT work_id, likes, duration_s FROM works WHERE create_time >= {NOW - 180 * 86400} AND duration_s >= 60 AND duration_s < 300 AND kind = 'video' ORDER BY likes DESC, work_id LIMIT 25")
def _search(spark, sf_dir):
    return W.catalog_search(works_from_orders(spark, sf_dir), NOW, "likes", "half_year", "medium", "video", 25).select("work_id", "likes", "duration_s")


@query("srt1_newest_works", with_(WORKS) + "SELECT channel_id, work_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY create_time DESC, work_id) AS rank FROM works) x WHERE rank <= 5")
def _newest(spark, sf_dir):
    return W.newest_works(works_from_orders(spark, sf_dir), 5).select("channel_id", "work_id", "rank")


@query("srt2_oldest_first", with_(WORKS) + "SELECT work_id, create_time FROM works ORDER BY create_time, work_id")
def _oldest(spark, sf_dir):
    return W.oldest_first(works_from_orders(spark, sf_dir)).select("work_id", "create_time")


@query("srt3_stable_paths", "SELECT url AS relative_path FROM pages ORDER BY lower(url), url")
def _paths(spark, sf_dir):
    return readers.stable_paths(table(spark, sf_dir, "pages").select(F.col("url").alias("relative_path")))


@query("srt4_take_n", "SELECT l_orderkey // 100 AS page, l_orderkey % 100 * 10000000 + l_partkey * 10 + l_linenumber AS pos, l_suppkey FROM lineitem ORDER BY 1, 2, 3 LIMIT 40")
def _take(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("page"), (F.col("l_orderkey") % 100 * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_suppkey")
    return W.take_n(rows, 40)


def _pages_of_works(spark, sf_dir):
    """Lines as sightings of a part on the page numbered by the order."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work_id"), F.col("l_orderkey").alias("page")).agg(big(F.max("l_linenumber")).alias("line"))


@query("win24_keep_last", """WITH p AS (SELECT l_partkey AS work_id, l_orderkey AS page, CAST(max(l_linenumber) AS BIGINT) AS line FROM lineitem GROUP BY ALL)
    SELECT work_id, max(page) AS page, arg_max(line, page) AS line FROM p GROUP BY work_id""")
def _last(spark, sf_dir):
    return W.keep_last(_pages_of_works(spark, sf_dir))


@query("set4_union_pages", "SELECT o_orderkey AS work_id, o_orderstatus AS page FROM orders")
def _union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderstatus").alias("page"))
    return W.union_pages(*[orders.where(F.col("page") == p) for p in ("F", "O", "P")])


CHANNELS = """ch AS (SELECT 'c' || c_custkey AS channel_id, c_name AS nickname, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'vi' WHEN 'BUILDING' THEN '' END AS target_lang, c_acctbal > 0 AS enabled FROM customer)"""


def channels(spark, sf_dir):
    lang = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "vi").when(F.col("c_mktsegment") == "BUILDING", "")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("channel_id"), F.col("c_name").alias("nickname"),
        lang.alias("target_lang"), (F.col("c_acctbal") > 0).alias("enabled"))


@query("jn8_works_with_config", with_(WORKS, CHANNELS) + "SELECT w.work_id, coalesce(nullif(target_lang, ''), 'en') AS target_lang, 'manual' AS approval_policy FROM works w JOIN ch ON 'c' || w.channel_id = ch.channel_id WHERE enabled")
def _config(spark, sf_dir):
    works = works_from_orders(spark, sf_dir).withColumn("channel_id", F.concat(F.lit("C"), F.col("channel_id").cast("string")))
    return W.with_config(works, channels(spark, sf_dir), {"target_lang": "en"}, {"target_lang": "vi", "approval_policy": "manual"}).select(
        "work_id", "target_lang", "approval_policy")


@query("agg4_monitor_summary", with_(WORKS, CHANNELS) + "SELECT (SELECT count(*) FROM ch) AS total, (SELECT count(*) FROM ch WHERE enabled) AS enabled, (SELECT count(*) FROM history) AS downloaded")
def _monitor(spark, sf_dir):
    return W.monitor_summary(channels(spark, sf_dir), history_from_orders(spark, sf_dir))


@query("agg4_scan_summary", with_(WORKS) + "SELECT channel_id, count(*) AS scanned, count(*) FILTER (work_id NOT IN (SELECT work_id FROM history)) AS \"new\", count(*) FILTER (kind = 'album') AS errors FROM works GROUP BY channel_id")
def _scan(spark, sf_dir):
    seen = history_from_orders(spark, sf_dir).withColumn("_h", F.lit(True))
    rows = works_from_orders(spark, sf_dir).join(seen, "work_id", "left")
    return W.scan_summary(rows.withColumn("is_new", F.col("_h").isNull()).withColumn("failed", F.col("kind") == "album"))


@query("jn14_nest_replies", """WITH c AS (SELECT l_orderkey AS a, l_linenumber = 1 AS top, l_partkey * 1000 + l_suppkey AS cid FROM lineitem), o AS (SELECT a, min(cid) AS cid FROM c WHERE top GROUP BY a),
    r AS (SELECT c.a, o.cid, c.cid AS reply FROM c JOIN o ON c.a = o.a WHERE NOT top)
    SELECT o.a AS aweme_id, o.cid, count(reply) AS n_replies, coalesce(string_agg(CAST(reply AS VARCHAR), ',' ORDER BY reply), '') AS replies FROM o LEFT JOIN r ON r.a = o.a GROUP BY ALL""")
def _nest(spark, sf_dir):
    """First lines of an order are comments, the others answer them."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("aweme_id"), (F.col("l_linenumber") == 1).alias("top"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("cid"))
    outer = lines.where("top").groupBy("aweme_id").agg(F.min("cid").alias("cid"))
    inner = lines.where("NOT top").join(outer.select("aweme_id", F.col("cid").alias("parent_cid")), "aweme_id")
    comments = outer.withColumn("parent_cid", F.lit(None).cast("bigint")).unionByName(inner.select("aweme_id", "cid", "parent_cid"))
    out = W.nest_replies(comments.withColumn("text", F.col("cid").cast("string")))
    return out.select("aweme_id", "cid", big("n_replies").alias("n_replies"), F.array_join(F.transform("replies", lambda r: r["cid"].cast("string")), ",").alias("replies"))


@query("jn18_match_user", """WITH u AS (SELECT n_name AS query, c_custkey AS user_id, c_custkey AS pos, c_custkey % 40 = 7 AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT query, CASE WHEN bool_or(hit) THEN min(user_id) FILTER (hit) ELSE min(user_id) END AS user_id, bool_or(hit) AS exact FROM u GROUP BY query""")
def _match(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hit = F.col("c_custkey") % 40 == 7
    users = rows.select(F.col("n_name").alias("query"), F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("pos"),
                        F.when(hit, F.lower("n_name")).otherwise("other").alias("unique_id"), F.lit(None).cast("string").alias("short_id"))
    return W.match_user(users)


@query("agg8_best_media_url", f"""WITH u AS (SELECT page_id % 10 AS k, page_id AS pos, {MEDIA_LINK} AS url FROM pages WHERE page_id % 3 = 0)
    SELECT k, arg_max(url, row(CAST(regexp_extract(url, 'br=(\\d+)', 1) AS BIGINT), length(url), -pos)) AS url FROM u GROUP BY k""")
def _best(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("k"), F.col("page_id").alias("pos"), media_link().alias("url"))
    return W.best_media_url(urls, ["k"])


@query("agg20_ordered_distinct", "SELECT regexp_extract(url, '://([^/]+)', 1) AS host, min(page_id) AS first_pos FROM pages GROUP BY host")
def _distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    return W.ordered_distinct(rows, [], "host", "page_id")


@query("set5_candidate_union", "WITH c AS (SELECT page_id % 7 AS k, url, 0 AS list, page_id AS pos FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id % 7, url, 1, page_id FROM pages) SELECT k, url, CAST(arg_min(list, row(list, pos)) AS INTEGER) AS list, arg_min(pos, row(list, pos)) AS pos FROM c GROUP BY k, url")
def _candidates(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("k"), "url", F.col("page_id").alias("pos"))
    return W.candidate_union([pages.where("pos % 2 = 0"), pages], ["k"])


@query("src4_read_works", "SELECT CAST(o_orderkey AS VARCHAR) AS aweme_id, CAST(o_custkey % 5 AS INTEGER) AS page FROM orders WHERE o_custkey > 0")
def _read_works(spark, sf_dir):
    """Feed entries packed on pages and unpacked again; customer 0 has works without an id."""
    raw = raw_works(spark, sf_dir).withColumn("_c", F.col("author.follower_count"))
    spoilt = raw.withColumn("aweme_id", F.when(F.col("_c") > 0, F.col("aweme_id")).otherwise(" "))
    entry = F.struct(*[c for c in raw.columns if c != "_c"])
    pages = spoilt.groupBy((F.col("_c") % 5).cast("int").alias("page"), "_c").agg(F.collect_list(entry).alias("aweme_list"))
    return readers.works_of_pages(pages).select("aweme_id", "page")


@query("src6_read_job_log", "SELECT user_id AS job_id, epoch_us(ts) AS updated FROM events ORDER BY updated DESC")
def _log(spark, sf_dir):
    from cueloom.adapters import jobs_from_events

    return readers.newest_first(jobs_from_events(spark, sf_dir)).select("job_id", "updated")


@query("src7_media_of_net_log", f"SELECT page_id % 10 AS tab, {MEDIA_LINK} AS url, min(page_id) AS first_pos FROM pages WHERE page_id % 3 = 0 AND page_id % 5 > 0 GROUP BY ALL")
def _net(spark, sf_dir):
    body = F.to_json(F.struct(F.struct(
        F.lit("Network.responseReceived").alias("method"),
        F.struct(F.struct(F.when(F.col("page_id") % 5 == 0, 404).otherwise(206).alias("status"), media_link().alias("url"), F.lit("video/mp4").alias("mimeType")).alias("response")).alias("params"),
    ).alias("message")))
    log = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("tab"), F.col("page_id").alias("pos"), body.alias("message"))
    broken = log.withColumn("message", F.lit("{Network.responseReceived"))
    return readers.media_of_net_log(log.unionByName(broken), ["tab"])


@query("src8_list_artifacts", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, '/out/' || o_orderkey || x AS path FROM orders, (VALUES ('/a.srt'), ('/b.mp3')) v(x) WHERE o_orderstatus <> 'P' OR x = '/a.srt'")
def _artifacts(spark, sf_dir):
    n = F.col("o_orderkey").cast("string")
    at = lambda name: F.concat(F.lit("/out/"), n, F.lit(name))
    doc = F.struct(
        F.struct(F.struct(at("/a.srt").alias("path")).alias("en")).alias("srt_files"),
        F.struct(F.struct(F.struct(F.when(F.col("o_orderstatus") != "P", at("/b.mp3")).otherwise("/elsewhere/b.mp3").alias("audio_path")).alias("deep")).alias("x")).alias("tts_en"),
        F.struct(at("/hidden").alias("path")).alias("other"))
    return readers.list_artifacts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.to_json(doc).alias("document")), "/out")


@query("src9_inventory_outputs", """WITH f AS (SELECT l_orderkey AS job_id, l_linenumber AS k, CAST(floor(l_quantity) AS BIGINT) AS size, '/out/' || l_orderkey || '/' || CASE l_linenumber WHEN 1 THEN 'e_vi.srt' WHEN 2 THEN 'e.srt' WHEN 3 THEN 'tts_en.mp3' WHEN 4 THEN 'e_id_sub.mp4' WHEN 5 THEN 'burned_x.mp4' ELSE 'note.txt' END AS path FROM lineitem)
    SELECT job_id, CASE k WHEN 1 THEN 'srt' WHEN 2 THEN 'srt' WHEN 3 THEN 'tts' ELSE 'video' END AS kind, CASE k WHEN 1 THEN 'vi' WHEN 2 THEN 'zh' WHEN 3 THEN 'en' WHEN 4 THEN 'id' ELSE 'vi' END AS lang, path, count(*) AS files, 'interrupted' AS job_status FROM f WHERE k <= 5 GROUP BY ALL""")
def _inventory(spark, sf_dir):
    names = {1: "e_vi.srt", 2: "e.srt", 3: "tts_en.mp3", 4: "e_id_sub.mp4", 5: "burned_x.mp4"}
    name = F.lit("note.txt")
    for k, v in names.items():
        name = F.when(F.col("l_linenumber") == k, v).otherwise(name)
    media = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("/out/"), F.col("l_orderkey").cast("string"), F.lit("/"), name).alias("path"), big(F.floor("l_quantity")).alias("size"))
    return readers.inventory_outputs(media).drop("size")


@query("snk5_manifest_rows", "SELECT l_orderkey AS batch_id, '{\"batch_id\":' || l_orderkey || ',\"line\":' || l_linenumber || ',\"supp\":' || l_suppkey || '}' AS value FROM lineitem")
def _manifest(spark, sf_dir):
    return sinks.manifest_rows(items_from_lineitem(spark, sf_dir).select("batch_id", "line", "supp"), ["batch_id"])


@query("snk7_export_works", "SELECT CAST(o_orderkey AS VARCHAR) AS \"作品id\", 'work' || o_orderpriority AS \"作品标题\", coalesce(CAST(nullif(o_custkey % 3, 0) AS VARCHAR), 'None') AS \"点赞数量\" FROM orders")
def _export(spark, sf_dir):
    rows = works_from_orders(spark, sf_dir).select(
        "work_id", F.concat(F.lit("work\x07"), F.regexp_replace("title", "work ", "")).alias("title"),
        F.nullif(F.col("channel_id") % 3, F.lit(0).cast("bigint")).alias("digg_count"))
    return sinks.export_works(rows)


@query("snk8_work_details", with_(WORKS) + """SELECT CAST(work_id AS VARCHAR) AS work_id, CAST(line AS INTEGER) AS line, title, value, '{"work_id":' || work_id || ',"digg_count":' || likes || '}' AS info FROM
    (SELECT work_id, likes, 0 AS line, '作品id' AS title, CAST(work_id AS VARCHAR) AS value FROM works UNION ALL SELECT work_id, likes, 1, '点赞数量', CAST(likes AS VARCHAR) FROM works) x""")
def _details(spark, sf_dir):
    rows = works_from_orders(spark, sf_dir).select("work_id", F.col("likes").alias("digg_count"))
    return sinks.work_details(rows).withColumn("work_id", F.col("work_id").cast("string"))


# ----------------------------------------------------------------------------- batches


@query("agg2_status_counts", with_(ITEMS) + "SELECT batch_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in B.ITEM_STATES) + " FROM items GROUP BY batch_id")
def _counts(spark, sf_dir):
    return B.status_counts(items_from_lineitem(spark, sf_dir), ["batch_id"])


@query("agg3_batch_status", with_(ITEMS, """a AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
      coalesce(arg_min(progress, row(line, part, supp, size)) FILTER (status = 'processing'), 0) AS cur FROM items GROUP BY batch_id)""") + """
    SELECT o_orderkey AS batch_id, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed,
    CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN failed > 0 AND done > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN total IS NULL THEN 100 ELSE CAST(trunc((done + cur / 100.0::DOUBLE) / total * 100) AS INTEGER) END AS progress FROM orders LEFT JOIN a ON batch_id = o_orderkey""")
def _status(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderstatus") == "P").alias("cancelled_batch"))
    return B.batch_status(items_from_lineitem(spark, sf_dir), batches, ["line", "part", "supp", "size"])


def _files(spark, sf_dir):
    """Lines as video files: a folder per ship month, some with equal stems."""
    name = F.concat(F.lit("Ep "), (F.col("l_partkey") % 20).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".MP4").otherwise(".mkv"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("batch_id"), F.concat(F.lit("D"), F.month("l_shipdate").cast("string"), F.lit("/"), name).alias("relative_path")).agg(
        F.sha2(F.min("l_orderkey").cast("string"), 256).alias("sha256"))


FILES = """f AS (SELECT l_suppkey AS batch_id, 'D' || month(l_shipdate) || '/Ep ' || (l_partkey % 20) || CASE WHEN l_linenumber % 2 = 0 THEN '.MP4' ELSE '.mkv' END AS relative_path, sha256(CAST(min(l_orderkey) AS VARCHAR)) AS sha256 FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, regexp_replace(regexp_extract(relative_path, '([^/]*)\\.[^.]+$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS stem, lower(regexp_extract(relative_path, '\\.([^.]+)$', 1)) AS ext, lower(regexp_extract(relative_path, '^(.*)/', 1)) AS folder FROM f)"""


@query("win23_dedupe_stems", "WITH " + FILES + "SELECT batch_id, relative_path, CASE WHEN count(*) OVER (PARTITION BY batch_id, folder, lower(stem)) > 1 THEN stem || '_' || ext || '_' || left(sha256, 8) ELSE stem END AS output_stem FROM g")
def _stems(spark, sf_dir):
    return B.dedupe_stems(_files(spark, sf_dir)).select("batch_id", "relative_path", "output_stem")


@query("win30_item_numbering", "WITH " + FILES + "SELECT batch_id, relative_path, batch_id || '_' || printf('%04d', row_number() OVER (PARTITION BY batch_id ORDER BY lower(relative_path), relative_path)) AS item_id FROM g")
def _numbering(spark, sf_dir):
    return B.number_items(_files(spark, sf_dir)).select("batch_id", "relative_path", "item_id")


@query("jn4_attach_sidecar", """SELECT o_orderkey AS work_id, CASE WHEN o_orderstatus = 'F' THEN '/in/' || o_orderkey || '.zh.srt' WHEN o_orderstatus = 'O' THEN '/in/' || o_orderkey || '.srt' END AS sidecar FROM orders""")
def _sidecar(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string")).alias("stem"))
    marked = orders.where("o_orderstatus = 'F'").select(F.concat("stem", F.lit(".zh.srt")).alias("path"))
    plain = orders.where("o_orderstatus <> 'P'").select(F.concat("stem", F.lit(".srt")).alias("path"))
    media = orders.select(F.col("o_orderkey").alias("work_id"), F.concat("stem", F.lit(".mp4")).alias("path"))
    return B.attach_sidecar(media, marked.union(plain)).select("work_id", "sidecar")


@query("jn5_changed_sources", "SELECT CAST(o_orderkey AS VARCHAR) AS source_path, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'size' ELSE 'mtime' END AS change FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def _changed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = F.col("o_orderkey").cast("string")
    manifest = orders.select(path.alias("source_path"), F.col("o_custkey").alias("source_size"), F.col("o_totalprice").alias("source_mtime"))
    media = orders.where("o_orderstatus <> 'P'").select(
        path.alias("path"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("size"),
        (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 0.5).otherwise(0.0)).alias("mtime"))
    return B.changed_sources(manifest, media).select("source_path", "change")


@query("flt10_path_allowed", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '/data/a/' WHEN '2-HIGH' THEN '/data/out/' WHEN '3-MEDIUM' THEN '/data/ab/' ELSE '/tmp/' END || o_orderkey AS path FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')")
def _allowed(spark, sf_dir):
    p = F.col("o_orderpriority")
    folder = F.when(p == "1-URGENT", "/data/a/").when(p == "2-HIGH", "/data/out/").when(p == "3-MEDIUM", "/data/ab/").otherwise("/tmp/")
    media = table(spark, sf_dir, "orders").select(F.concat(folder, F.col("o_orderkey").cast("string")).alias("path"))
    return B.path_allowed(media, ["/data/a", "/tmp/", "/data/out"], "/data/out")


@query("ups8_resume_items", with_(ITEMS) + "SELECT batch_id, line, part, supp, CASE WHEN status IN ('failed', 'partial') THEN 'queued' ELSE status END AS status, CAST(CASE WHEN status IN ('failed', 'partial') THEN 0 ELSE progress END AS INTEGER) AS progress, CASE WHEN status NOT IN ('failed', 'partial') THEN 'e' END AS error FROM items")
def _resume(spark, sf_dir):
    return B.resume_items(items_from_lineitem(spark, sf_dir).withColumn("error", F.lit("e"))).select("batch_id", "line", "part", "supp", "status", "progress", "error")


@query("ups8_recover_stale", with_(ITEMS) + "SELECT batch_id, line, part, supp, CASE WHEN status = 'processing' AND batch_id % 2 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN status = 'processing' AND batch_id % 2 = 0 THEN 'Worker interrupted' END AS error FROM items")
def _recover(spark, sf_dir):
    items = items_from_lineitem(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    dead = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("batch_id"))
    return B.recover_stale(items, dead).select("batch_id", "line", "part", "supp", "status", "error")


@query("ups9_pending_items", with_(ITEMS) + "SELECT batch_id, line, part, supp, attempts + 1 AS attempts FROM items WHERE status <> 'done'")
def _pending(spark, sf_dir):
    return B.pending_items(items_from_lineitem(spark, sf_dir)).select("batch_id", "line", "part", "supp", "attempts")


SESSIONS = """se AS (SELECT o_orderkey AS session_id, 7 + o_custkey % 3 AS total_chunks, CAST(1000 AS BIGINT) AS chunk_size, (7 + o_custkey % 3) * 1000 - 300 + CASE WHEN o_custkey % 11 = 0 THEN 1000 ELSE 0 END AS total_size, o_orderstatus = 'P' AS finished FROM orders),
ck AS (SELECT l_orderkey AS session_id, CAST(l_linenumber + l_partkey % 4 - 1 AS BIGINT) AS chunk_index, CASE WHEN l_suppkey % 5 = 0 THEN 700 ELSE 1000 END AS bytes FROM lineitem)"""


def sessions(spark, sf_dir):
    total = F.lit(7).cast("bigint") + F.col("o_custkey") % 3
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), total.alias("total_chunks"), F.lit(1000).cast("bigint").alias("chunk_size"),
        (total * 1000 - 300 + F.when(F.col("o_custkey") % 11 == 0, 1000).otherwise(0)).alias("total_size"), (F.col("o_orderstatus") == "P").alias("finished"))


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") + F.col("l_partkey") % 4 - 1).alias("chunk_index"),
        F.when(F.col("l_suppkey") % 5 == 0, 700).otherwise(1000).alias("bytes"))


@query("flt12_chunk_ok", with_(SESSIONS) + """SELECT session_id, chunk_index, bytes, CASE WHEN total_chunks IS NULL THEN 'no_session' WHEN chunk_index < 0 OR chunk_index >= total_chunks THEN 'out_of_range' WHEN finished THEN 'finished'
    WHEN bytes > least(chunk_size, total_size - chunk_index * chunk_size) THEN 'too_large' WHEN bytes < least(chunk_size, total_size - chunk_index * chunk_size) THEN 'too_small' END AS error FROM ck LEFT JOIN se USING (session_id)""")
def _chunk_ok(spark, sf_dir):
    return B.chunk_ok(chunks(spark, sf_dir), sessions(spark, sf_dir)).select("session_id", "chunk_index", "bytes", "error")


@query("agg16_missing_chunks", with_(SESSIONS, """g AS (SELECT DISTINCT session_id, chunk_index FROM ck JOIN se USING (session_id) WHERE chunk_index BETWEEN 0 AND total_chunks - 1),
    al AS (SELECT session_id, total_chunks, total_size, chunk_size, unnest(range(0, total_chunks)) AS i FROM se),
    x AS (SELECT al.*, g.chunk_index IS NULL AS gone FROM al LEFT JOIN g ON g.session_id = al.session_id AND g.chunk_index = al.i)""") +
    "SELECT session_id, count(*) FILTER (gone) AS n_missing, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (gone AND i < 20), '') AS first_missing, min(CAST(ceil(total_size / chunk_size) AS BIGINT)) = min(total_chunks) AS declared_ok FROM x GROUP BY session_id")
def _missing_chunks(spark, sf_dir):
    out = B.missing_chunks(chunks(spark, sf_dir), sessions(spark, sf_dir), 20)
    return out.select("session_id", "n_missing", F.array_join("first_missing", ",").alias("first_missing"), "declared_ok")


@query("flt11_media_limits", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unreadable' WHEN o_custkey > 1000 THEN 'too_large' WHEN o_orderkey % 600 > 500 THEN 'too_long' END AS error FROM orders")
def _limits(spark, sf_dir):
    probe = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 600).alias("duration_s"), F.col("o_custkey").alias("size"))
    return B.media_limits(probe, 1000, 500).select("o_orderkey", "error")


@query("val2_validate_region", """SELECT p_partkey, p_partkey % 97 / 97.0::DOUBLE + p_partkey % 83 / 83.0::DOUBLE <= 1.0 AND p_partkey % 89 / 89.0::DOUBLE + p_partkey % 79 / 79.0::DOUBLE <= 1.0 AND p_partkey % 83 > 0 AND p_partkey % 79 > 0 AS valid FROM part""")
def _region_ok(spark, sf_dir):
    from cueloom.functions.values import valid_region

    r = [F.col("p_partkey") % m / F.lit(float(m)) for m in (97, 89, 83, 79)]
    return table(spark, sf_dir, "part").select("p_partkey", valid_region(*r).alias("valid"))


@query("val3_batch_options", """SELECT o_orderkey, o_orderstatus <> 'P' AS recursive, CASE WHEN o_custkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS region_mode, CASE WHEN o_custkey % 4 = 0 AND o_custkey % 3 > 0 THEN 0.1::DOUBLE END AS x_ratio,
    array_to_string(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'bad_output_mode' END, CASE WHEN o_custkey % 7 = 0 THEN 'unknown_extension' END, CASE WHEN o_custkey % 4 = 0 AND o_custkey % 3 = 0 THEN 'region_required' END,
      CASE WHEN o_custkey % 3 > 0 AND o_custkey % 5 = 0 THEN 'bad_region' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders""")
def _options(spark, sf_dir):
    region = F.col("o_custkey") % 3 > 0
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "No").when(F.col("o_orderstatus") == "F", " YES ").alias("recursive"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "film").when(F.col("o_orderpriority") == "2-HIGH", " SRT_only ").alias("output_mode"),
        F.when(F.col("o_custkey") % 7 == 0, "mp4,gif").alias("extensions"), F.when(F.col("o_custkey") % 4 == 0, "Manual").otherwise("auto").alias("region_mode"),
        F.when(region, 0.1).alias("x_ratio"), F.when(region, 0.2).alias("y_ratio"), F.when(region, F.when(F.col("o_custkey") % 5 == 0, 0.95).otherwise(0.5)).alias("w_ratio"), F.when(region, 0.3).alias("h_ratio"))
    return B.validate_batch_options(rows).select("o_orderkey", "recursive", "region_mode", "x_ratio", F.array_join("errors", ",").alias("errors"))


@query("val3_run_options", """SELECT o_orderkey, o_orderstatus <> 'F' AS step_tts, o_orderstatus <> 'F' AND o_orderstatus <> 'P' AS step_burn_sub, CASE WHEN o_custkey % 6 = 0 THEN 700.0::DOUBLE ELSE 60.0::DOUBLE END AS margin,
    array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'no_step' END, CASE WHEN o_custkey % 6 = 0 THEN 'bad_margin' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'video_needed' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders""")
def _run_options(spark, sf_dir):
    steps = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("tts"), F.lit("no"))).when(F.col("o_orderstatus") == "P", F.create_map(F.lit("tts"), F.lit("1")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", steps.alias("steps"), F.when(F.col("o_orderpriority") == "1-URGENT", "srt_only").alias("source_type"), F.when(F.col("o_custkey") % 6 == 0, 700).alias("margin"))
    return B.validate_run_options(rows).select("o_orderkey", "step_tts", "step_burn_sub", "margin", F.array_join("errors", ",").alias("errors"))


@query("val4_fill_defaults", "SELECT c_custkey, c_mktsegment AS vmode, 'edge' AS tts_engine, CAST(16 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM customer")
def _defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(
        F.col("c_custkey") % 2 == 0, F.create_map(F.lit("vmode"), F.col("c_mktsegment"), F.lit("own"), F.lit("1"))).otherwise(F.create_map(F.lit("vmode"), F.col("c_mktsegment"))).alias("prefs"))
    out = B.fill_defaults(rows)
    return out.select("c_custkey", F.col("prefs")["vmode"].alias("vmode"), F.col("prefs")["tts_engine"].alias("tts_engine"), F.size("prefs").alias("n"))


# ------------------------------------------------------------------------------- lines


def lines(spark, sf_dir):
    """Every third phrase lacks a model line; every sixth lacks the second one too."""
    cues = phrases_from_conversations(spark, sf_dir).drop("speaker")
    said = phrases_from_conversations(spark, sf_dir)
    ai = said.where("cue_id % 3 > 0").select("track_id", "cue_id", F.reverse("text").alias("text"), F.when(F.col("cue_id") % 2 == 0, F.col("speaker")).alias("speaker"))
    second = said.where("cue_id % 6 > 0").select("track_id", "cue_id", F.lower("text").alias("text"))
    return cues, ai, second


LINES = """ln AS (SELECT track_id, cue_id, text, CASE WHEN cue_id % 3 > 0 THEN reverse(text) WHEN cue_id % 6 > 0 THEN lower(text) ELSE text END AS translation,
  CASE WHEN cue_id % 3 > 0 AND cue_id % 2 = 0 THEN speaker ELSE 'M1' END AS speaker, cue_id % 3 = 0 AS fallback FROM cues)"""


def translated(spark, sf_dir):
    return Q.translate_fallback(*lines(spark, sf_dir))


@query("jn15_translate_fallback", with_(PHRASES, LINES) + "SELECT track_id, cue_id, translation, speaker, fallback FROM ln")
def _fallback(spark, sf_dir):
    return translated(spark, sf_dir).select("track_id", "cue_id", "translation", "speaker", "fallback")


@query("agg1_speaker_counts", with_(PHRASES, LINES) + "SELECT track_id, speaker, count(*) AS lines FROM ln GROUP BY ALL")
def _speakers(spark, sf_dir):
    return Q.speaker_counts(translated(spark, sf_dir))


ACCENTS = "[éèêëàâçñáíóúüöä]"


@query("agg15_untranslated", with_(PHRASES, LINES) + f"SELECT track_id, count(*) AS total, count(*) FILTER (translation = text AND regexp_matches(text, '{ACCENTS}')) AS unchanged FROM ln GROUP BY track_id")
def _untranslated(spark, sf_dir):
    return Q.untranslated_summary(translated(spark, sf_dir), ACCENTS)


@query("jn17_review_unresolved", with_(PHRASES, LINES) + f"SELECT track_id, cue_id FROM ln WHERE translation = text AND regexp_matches(text, '{ACCENTS}') AND cue_id % 4 <> 0")
def _unresolved(spark, sf_dir):
    """Every fourth line was edited, and the rest reads as before or is gone."""
    done = translated(spark, sf_dir).select("track_id", "cue_id", "text", "translation")
    flagged = Q.untranslated(done, ACCENTS)
    before = done.select("track_id", "cue_id", F.col("translation").alias("text"))
    after = before.where("cue_id % 7 > 0 OR cue_id % 4 = 0").withColumn("text", F.when(F.col("cue_id") % 4 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.concat(F.lit(" "), F.col("text"))))
    return Q.review_unresolved(flagged, before, after)


FLAGS = f"""fl AS (SELECT track_id, cue_id AS group_no, unnest(list_filter([
  CASE WHEN length(text) / greatest((end_ms - start_ms) / 1000.0::DOUBLE, 0.001::DOUBLE) > 25 THEN {{'severity': 'warning', 'type': 'high_cps', 'value': {sql_round("length(text) / greatest((end_ms - start_ms) / 1000.0::DOUBLE, 0.001::DOUBLE)", 1)}}} END,
  CASE WHEN (end_ms - start_ms) / 1000.0::DOUBLE < 0.65 THEN {{'severity': 'warning', 'type': 'short_duration', 'value': {sql_round("(end_ms - start_ms) / 1000.0::DOUBLE", 2)}}} END,
  CASE WHEN text LIKE '%...' OR lower(regexp_replace(list_last(string_split(text, ' ')), '[^A-Za-z]', '', 'g')) IN ('the','a','an','and','or','to','of','if','with','for') THEN {{'severity': 'severe', 'type': 'sentence_fragment', 'value': CAST(NULL AS DOUBLE)}} END,
  CASE WHEN regexp_matches(text, '{ACCENTS}') THEN {{'severity': 'severe', 'type': 'han_residue', 'value': CAST(NULL AS DOUBLE)}} END], lambda x: x IS NOT NULL)) AS f FROM cues)"""


def flags(spark, sf_dir):
    groups = phrases_from_conversations(spark, sf_dir).withColumnRenamed("cue_id", "group_no").withColumnRenamed("text", "translation")
    return Q.quality_flags(groups, "en", ACCENTS)


@query("agg5_quality_flags", with_(PHRASES, FLAGS) + "SELECT track_id, group_no, f.severity AS severity, f.type AS type, f.value AS value FROM fl")
def _flags(spark, sf_dir):
    return flags(spark, sf_dir)


@query("agg5_quality_summary", with_(PHRASES, FLAGS) + "SELECT c.track_id, count(*) FILTER (f.severity = 'warning') AS warnings, count(*) FILTER (f.severity = 'severe') AS severe, count(*) FILTER (f.severity = 'severe') > 0 AS needs_review FROM (SELECT DISTINCT track_id FROM cues) c LEFT JOIN fl USING (track_id) GROUP BY c.track_id")
def _quality(spark, sf_dir):
    return Q.quality_summary(flags(spark, sf_dir), phrases_from_conversations(spark, sf_dir))


@query("agg11_track_stats", with_(CUES) + f"SELECT text, count(*) AS cues, {sql_round('sum(end_ms - start_ms) / count(*)::DOUBLE', 3)} AS mean_ms FROM cues GROUP BY text")
def _stats(spark, sf_dir):
    return Q.track_stats(cues_from_events(spark, sf_dir), "text")


@query("srt5_first_messages", with_(CUES) + """, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cue_id, text) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM cues)
    SELECT track_id, string_agg(text, '; ' ORDER BY k) FILTER (k <= 5) || max(CASE WHEN n > 5 THEN ' +' || (n - 5) || ' more' ELSE '' END) AS messages FROM r GROUP BY track_id""")
def _first(spark, sf_dir):
    return Q.first_messages(cues_from_events(spark, sf_dir), ["track_id"], F.col("text"), F.col("cue_id"), 5)


def _segments(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    return cues.select("track_id", F.col("cue_id").alias("index"), "start_ms", "text", F.when(F.col("cue_id") % 2 == 0, F.col("speaker")).alias("speaker"))


def _given(spark, sf_dir):
    return phrases_from_conversations(spark, sf_dir).where("cue_id % 5 > 0").select(
        "track_id", F.col("cue_id").alias("position"), F.when(F.col("cue_id") % 3 == 0, "M2").otherwise("N").alias("speaker"))


SPOKEN = "sp AS (SELECT track_id, cue_id AS index, text, CASE WHEN cue_id % 2 = 0 THEN speaker WHEN cue_id % 5 > 0 THEN CASE WHEN cue_id % 3 = 0 THEN 'M2' ELSE 'N' END ELSE 'M1' END AS speaker FROM cues)"
_MAPPED = "VALUES " + ", ".join(str(r[2:]) for r in Q.voice_rows() if r[:2] == ("edge", "en"))
VOICED = f"""mp(speaker, voice, tone) AS ({_MAPPED}), vo AS (SELECT track_id, index, text, sp.speaker, CASE WHEN sp.speaker = 'N' AND track_id % 3 = 0 THEN 'own' ELSE mp.voice END AS voice, CASE WHEN sp.speaker = 'N' AND track_id % 3 = 0 THEN '+0Hz' ELSE mp.tone END AS tone FROM sp LEFT JOIN mp USING (speaker))"""


@query("jn6_attach_speakers", with_(PHRASES, SPOKEN) + "SELECT track_id, index, speaker FROM sp")
def _attach(spark, sf_dir):
    return Q.attach_speakers(_segments(spark, sf_dir), _given(spark, sf_dir)).select("track_id", "index", "speaker")


def _own_voices(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(
        F.col("conv_id").alias("track_id"), F.lit("N").alias("speaker"), F.lit("own").alias("custom_voice"), F.lit(None).cast("string").alias("custom_tone")).distinct()


@query("jn7_resolve_voice", with_(PHRASES, SPOKEN, VOICED) + "SELECT track_id, index, voice, tone FROM vo")
def _voice(spark, sf_dir):
    rows = Q.attach_speakers(_segments(spark, sf_dir), _given(spark, sf_dir))
    return Q.resolve_voice(rows, "edge", "en", custom=_own_voices(spark, sf_dir)).select("track_id", "index", "voice", "tone")


@query("job10_tts_requests", with_(PHRASES, SPOKEN, VOICED) + """SELECT left(sha256(CAST(to_json([text, 'en', 'edge', 'edge-v1', voice, tone, '', 'false']) AS VARCHAR)), 24) AS cache_key, min(text) AS text, min(voice) AS voice, min(tone) AS tone, count(*) AS lines FROM vo GROUP BY 1""")
def _requests(spark, sf_dir):
    from cueloom.plans.jobs import synthesis_plan

    return synthesis_plan(_segments(spark, sf_dir), _given(spark, sf_dir), "edge", "en", "edge-v1", _own_voices(spark, sf_dir))
