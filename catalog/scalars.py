"""Parsers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import PHRASES, SQ, STRIP, TERM, WORDS, big, query, scalar, sql_sentences, with_
from cueloom.adapters import phrases_from_conversations, table
from cueloom.functions import srt, text, urls, values
from cueloom.operators import cues as C
from cueloom.operators.scan import at_most, plan_layout, scan
from cueloom.sources import readers

ACCENTS = "[éèêëàâçñáíóúüöä]"

# ------------------------------------------------------------------------ stamps, lines


def _stamp():
    return F.format_string(
        "%02d:%02d:%02d%s%03d", F.col("user_id") % 100, F.col("event_id") % 70, F.col("event_id") % 63,
        F.when(F.col("event_id") % 2 == 0, ",").otherwise("."), F.col("event_id") % 1000,
    )


scalar(
    "prs2_ts_to_ms", "events", lambda: [F.col("event_id"), srt.ts_to_ms(_stamp()).alias("ms")],
    """event_id, CASE WHEN event_id % 70 < 60 AND event_id % 63 < 60 THEN (user_id % 100) * 3600000
       + (event_id % 70) * 60000 + (event_id % 63) * 1000 + event_id % 1000 END AS ms""",
)
scalar(
    "prs3_ms_to_ts", "events",
    lambda: [F.col("event_id"), srt.ms_to_ts(F.col("event_id") * 7919 - 100_000).alias("stamp")],
    """event_id, printf('%02d:%02d:%02d,%03d', greatest(event_id * 7919 - 100000, 0) // 3600000,
       greatest(event_id * 7919 - 100000, 0) // 60000 % 60, greatest(event_id * 7919 - 100000, 0) // 1000 % 60,
       greatest(event_id * 7919 - 100000, 0) % 1000) AS stamp""",
)


def _tagged():
    return F.concat(F.lit(" ["), F.col("role"), F.lit("] : <i>"), F.col("text"), F.lit("</i> {x}"))


_bare = STRIP.format(r"regexp_replace(' [' || role || '] : <i>' || text || '</i> {x}', '<[^>]+>|\{[^}]+\}', '', 'g')")
_tag = r"^\s*[\[(]([A-Za-z0-9_]+)[\])]\s*:?\s*"
scalar(
    "cln1_clean_line", "conversations",
    lambda: [F.col("conv_id"), F.col("turn"), text.clean_line(_tagged())["text"].alias("line"),
             text.clean_line(_tagged())["speaker"].alias("speaker")],
    f"conv_id, turn, {SQ.format(f'regexp_replace({_bare}, {chr(39)}{_tag}{chr(39)}, {chr(39)*2})')} AS line, "
    f"upper(regexp_extract({_bare}, '{_tag}', 1)) AS speaker",
)

# ----------------------------------------------------------------------------- strings

scalar(
    "str1_split_sentences", "documents",
    lambda: [F.col("doc_id"), big(F.size(text.split_sentences("text"))).alias("n"),
             F.array_join(text.split_sentences("text"), "|").alias("sentences")],
    f"doc_id, len({sql_sentences('text')}) AS n, array_to_string({sql_sentences('text')}, '|') AS sentences",
)
scalar(
    "str2_has_terminal", "documents", lambda: [F.col("doc_id"), text.has_terminal("text").alias("terminal")],
    f"doc_id, regexp_matches({STRIP.format('text')}, '{TERM}$') AS terminal",
)


def _seam():
    left = F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, " ...").otherwise(""))
    right = F.concat(F.when(F.col("turn") % 3 == 0, "… ").otherwise(""), F.reverse("text"))
    return text.join_text(left, right)


_l = STRIP.format("text || CASE WHEN turn % 2 = 0 THEN ' ...' ELSE '' END")
_r = STRIP.format("CASE WHEN turn % 3 = 0 THEN '… ' ELSE '' END || reverse(text)")
scalar(
    "str3_join_text", "conversations", lambda: [F.col("conv_id"), F.col("turn"), _seam().alias("joined")],
    f"""conv_id, turn, {STRIP.format(
        f"CASE WHEN {_l} LIKE '%...' OR {_l} LIKE '%…' THEN rtrim({_l}, '. …') ELSE {_l} END || ' ' || "
        f"CASE WHEN {_r} LIKE '...%' OR {_r} LIKE '…%' THEN ltrim({_r}, '. …') ELSE {_r} END")} AS joined""",
)
scalar(
    "str4_norm_for_match", "documents", lambda: [F.col("doc_id"), text.norm_for_match("text").alias("norm")],
    r"doc_id, replace(lower(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss') AS norm",
)
scalar(
    "str5_norm_ocr", "documents", lambda: [F.col("doc_id"), text.norm_ocr("text").alias("norm")],
    r"doc_id, regexp_replace(regexp_replace(text, '\s', '', 'g'), '^[，。！？,.?!;；:：]+|[，。！？,.?!;；:：]+$', '', 'g') AS norm",
)


# One sign put into a phrase of n leaves n matches, one exchanged leaves n - 1: the ratios are known.
@query("str6_similarity", with_(PHRASES) + r"""SELECT track_id, cue_id, 2.0::DOUBLE * length(text) / (2 * length(text) + 1) AS inserted,
    2.0::DOUBLE * (length(text) - 1) / (2 * length(text)) AS exchanged, length(replace(lower(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')), 'ß', 'ss')) >= 5 AS same FROM cues""")
def _similarity(spark, sf_dir):
    """Every spoken phrase against itself with one sign more, and with one exchanged."""
    third = F.floor(F.length("text") / 3).cast("int")
    head = F.substr(F.col("text"), F.lit(1), third)
    more = F.concat(head, F.lit("7"), F.substr(F.col("text"), third + 1))
    other = F.concat(head, F.lit("7"), F.substr(F.col("text"), third + 2))
    return phrases_from_conversations(spark, sf_dir).select(
        "track_id", "cue_id", text.similarity("text", more).alias("inserted"), text.similarity("text", other).alias("exchanged"),
        F.coalesce(text.same_text("text", more), F.lit(False)).alias("same"))


_stem = (
    r"regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')"
)
scalar(
    "str7_safe_stem", "pages",
    lambda: [F.col("page_id"), text.safe_stem("url").alias("stem"), text.safe_name("url").alias("name")],
    rf"""page_id, left(coalesce(nullif(regexp_replace(regexp_replace({_stem}, '[^A-Za-z0-9À-ỹ一-龥_ .-]+', '_', 'g'),
        '^[ ._]+|[ ._]+$', '', 'g'), ''), 'video'), 80) AS stem,
        coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'video') AS name""",
)
_path = r"""regexp_replace(text, '[\\/:*?"<>| \n\r]+', '', 'g')"""
scalar(
    "str8_norm_path_name", "documents",
    lambda: [F.col("doc_id"), text.norm_path_name("text").alias("name"), text.path_title("text").alias("title"),
             text.path_nick("text").alias("nick")],
    f"doc_id, {_path} AS name, CASE WHEN trim(left({_path}, 40)) = '' THEN '无标题' ELSE left({_path}, 40) END AS title, "
    f"left({_path}, 20) AS nick",
)
scalar(
    "str9_escape_markdown", "pages", lambda: [F.col("page_id"), text.escape_markdown("html").alias("escaped")],
    r"page_id, regexp_replace(html, '([_*\[\]`])', '\\\1', 'g') AS escaped",
)
scalar(
    "str10_script_count", "documents",
    lambda: [F.col("doc_id"), big(text.han_count("text", ACCENTS)).alias("n"), text.has_han("text", ACCENTS).alias("has"),
             text.is_cover_text("text", ACCENTS).alias("cover")],
    f"doc_id, len(regexp_extract_all(text, '{ACCENTS}')) AS n, regexp_matches(text, '{ACCENTS}') AS has, "
    f"len(regexp_extract_all(text, '{ACCENTS}')) >= 2 AS cover",
)
scalar(
    "str11_reading_speed", "conversations",
    lambda: [F.col("conv_id"), F.col("turn"), big(text.word_count("text")).alias("words"),
             text.cps("text", F.col("turn") * 1000).alias("cps")],
    f"conv_id, turn, len({WORDS.format('text')}) AS words, "
    f"length({STRIP.format('text')}) / greatest(turn * 1000 / 1000.0::DOUBLE, 0.001::DOUBLE) AS cps",
)
_last = f"lower(regexp_replace(list_last({WORDS.format('text')}), '[^A-Za-z]', '', 'g'))"
scalar(
    "str12_last_word_fragment", "documents", lambda: [F.col("doc_id"), text.last_word_fragment("text").alias("cut_off")],
    f"doc_id, ({STRIP.format('text')} LIKE '%...' OR {STRIP.format('text')} LIKE '%…' OR coalesce({_last} IN "
    "('the','a','an','and','or','to','of','if','with','for'), false)) AS cut_off",
)


def _message():
    tails = ["API key not valid", "quota exceeded", "permission denied", "model not found", "payload refused",
             "deadline passed", "connection reset", "login needed", "video unavailable", "geo block"]
    out = F.lit("")
    for i, tail in enumerate(tails):
        out = F.when(F.col("event_id") % 10 == i, tail).otherwise(out)
    return F.concat(F.col("event_type"), F.lit(": "), out)


_msg = ("lower(event_type || ': ' || CASE event_id % 10 WHEN 0 THEN 'API key not valid' WHEN 1 THEN 'quota exceeded' "
        "WHEN 2 THEN 'permission denied' WHEN 3 THEN 'model not found' WHEN 4 THEN 'payload refused' "
        "WHEN 5 THEN 'deadline passed' WHEN 6 THEN 'connection reset' WHEN 7 THEN 'login needed' "
        "WHEN 8 THEN 'video unavailable' ELSE 'geo block' END)")


def _has(*parts):
    return "(" + " OR ".join(f"contains({_msg}, '{p}')" for p in parts) + ")"


scalar(
    "str13_classify_error", "events",
    lambda: [F.col("event_id"), text.classify_model_error(_message()).alias("model_error"),
             text.classify_download_error(_message()).alias("download_error")],
    f"""event_id, CASE WHEN {_has('api_key', 'api key')} OR ({_has('invalid')} AND {_has('key')}) THEN 'key'
      WHEN {_has('quota', 'rate limit', 'resource_exhausted')} THEN 'quota' WHEN {_has('permission', 'forbidden')} THEN 'permission'
      WHEN {_has('not found')} AND {_has('model')} THEN 'model' WHEN {_has('too large', 'payload')} THEN 'size'
      WHEN {_has('timeout', 'deadline')} THEN 'timeout' WHEN {_has('connection', 'network')} THEN 'connection' ELSE 'other' END AS model_error,
      CASE WHEN {_has('cookies', 'login')} THEN 'login' WHEN {_has('not found', 'unavailable')} THEN 'not_found'
      WHEN {_has('geo', 'region')} THEN 'geo' ELSE 'other' END AS download_error""",
)
scalar(
    "str14_redact", "documents",
    lambda: [F.col("doc_id"), text.redact(F.concat(F.lit("Token: s3cret, api-key=abc "), F.col("text")), ["abc"]).alias("safe")],
    r"""doc_id, left(regexp_replace(replace('Token: s3cret, api-key=abc ' || text, 'abc', '[REDACTED]'),
        '(?i)(api[_-]?key|key|token|authorization)(\s*[=:]\s*)[^\s,}"]+', '\1\2[REDACTED]', 'g'), 800) AS safe""",
)
scalar(
    "str15_valid_id", "customer",
    lambda: [F.col("c_custkey"), text.valid_id("c_name").alias("raw_ok"),
             text.valid_id(F.concat(F.lit("j_"), F.col("c_custkey").cast("string"))).alias("short_ok")],
    "c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_-]{6,64}') AS raw_ok, "
    "regexp_full_match('j_' || c_custkey, '[A-Za-z0-9_-]{6,64}') AS short_ok",
)


def _performed():
    return F.concat(F.lit("[whisper] "), F.col("text"), F.lit("  [Short_Pause] [mystery][unheard of] [mystery]"))


_p = STRIP.format("'[whisper] ' || text || '  [Short_Pause] [mystery][unheard of] [mystery]'")
scalar(
    "prs15_performance_markup", "conversations",
    lambda: [F.col("conv_id"), F.col("turn"), text.performance_markup(_performed())["text"].alias("line"),
             F.array_join(text.performance_markup(_performed())["cues"], ",").alias("cues")],
    "conv_id, turn, " + STRIP.format(
        "regexp_replace(replace(replace(replace(replace("
        f"{_p}, '[whisper]', '[whispering]'), '[Short_Pause]', '[short pause]'), '[mystery]', ''), '[unheard of]', ''), "
        "'[ \\t]{2,}', ' ', 'g')") + " AS line, 'mystery' AS cues",
)

# -------------------------------------------------------------------------------- urls


def _shared():
    return F.concat(F.lit("7.99 copy "), F.col("url"), F.lit(" open the app, "), F.col("page_id").cast("string"))


_sh = "'7.99 copy ' || url || ' open the app, ' || page_id"
scalar(
    "url1_extract_url", "pages",
    lambda: [F.col("page_id"), urls.extract_url(_shared()).alias("first"), urls.clean_url(_shared()).alias("link"),
             urls.clean_url(F.regexp_replace("url", "^https?://", " ")).alias("bare")],
    rf"""page_id, coalesce(nullif(regexp_extract({_sh}, 'https?://[a-zA-Z0-9.\-_/]+'), ''), trim({_sh})) AS first,
      regexp_replace(regexp_extract({_sh}, '(^|\s)(https?://\S*)', 2), '^[ ,.?!;:"''()\[\]<>]+|[ ,.?!;:"''()\[\]<>]+$', '', 'g') AS link,
      CASE WHEN regexp_matches(trim(regexp_replace(url, '^https?://', ' ')), '^([a-zA-Z0-9-]+\.)+[a-zA-Z]{{2,}}(/.*)?$')
        THEN 'https://' ELSE '' END || trim(regexp_replace(url, '^https?://', ' ')) AS bare""",
)


def _work_link():
    n = F.col("page_id").cast("string")
    return (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://x.example/video/"), n))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://x.example/note/"), n, F.lit("?a=1")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.col("url"), F.lit("&modal_id="), n)).otherwise(F.col("url"))
    )


scalar(
    "url2_work_id", "pages",
    lambda: [F.col("page_id"), urls.work_id_from_url(_work_link())["work_id"].alias("work_id"),
             urls.work_id_from_url(_work_link())["canonical_url"].alias("canonical_url")],
    "page_id, CASE WHEN page_id % 4 < 3 THEN CAST(page_id AS VARCHAR) END AS work_id, "
    "CASE WHEN page_id % 4 < 3 THEN 'https://www.douyin.com/video/' || page_id END AS canonical_url",
)


def media_link():
    n = F.col("page_id")
    host = F.when(n % 3 == 0, "v3.douyinvod.com").when(n % 3 == 1, "media-audio-x.zjcdn.com").otherwise("plain.example")
    return F.concat(F.lit("https://"), host, F.lit("/video/a.mp4?br="), (n * 37 % 500).cast("string"), F.lit("&n="), n.cast("string"))


MEDIA_LINK = (
    "'https://' || CASE page_id % 3 WHEN 0 THEN 'v3.douyinvod.com' WHEN 1 THEN 'media-audio-x.zjcdn.com' "
    "ELSE 'plain.example' END || '/video/a.mp4?br=' || (page_id * 37 % 500) || '&n=' || page_id"
)
scalar(
    "url3_is_media_url", "pages",
    lambda: [F.col("page_id"), urls.is_media_url(media_link()).alias("by_name"),
             urls.is_media_url("url", F.lit("video/mp4")).alias("plain")],
    f"""page_id, page_id % 3 = 0 AS by_name,
      regexp_matches(lower(url), '^https?://') AND NOT regexp_matches(lower(url), 'douyinstatic\\.com|media-audio-')
      AND regexp_matches(lower(url), 'zjcdn\\.com|douyinvod\\.com|bytecdn|video/tos') AS plain""",
)


def _channel_input():
    n = F.col("c_custkey").cast("string")
    opaque = F.concat(F.lit("MS4wLjABAAAA"), F.lpad(n, 24, "x"))
    return (
        F.when(F.col("c_custkey") % 4 == 0, opaque)
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://www.example.com/user/"), opaque))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("see https://v.douyin.com/"), n, F.lit("/ now")))
        .otherwise(F.concat(F.lit(" @"), F.col("c_name")))
    )


scalar(
    "url4_channel_ref", "customer",
    lambda: [F.col("c_custkey"), urls.channel_ref(_channel_input())["kind"].alias("kind"),
             urls.channel_ref(_channel_input())["value"].alias("value")],
    """c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'opaque_id' WHEN 1 THEN 'profile_link' WHEN 2 THEN 'short_link' ELSE 'handle' END AS kind,
      CASE c_custkey % 4 WHEN 0 THEN 'MS4wLjABAAAA' || lpad(CAST(c_custkey AS VARCHAR), 24, 'x')
        WHEN 1 THEN 'MS4wLjABAAAA' || lpad(CAST(c_custkey AS VARCHAR), 24, 'x')
        WHEN 2 THEN 'https://v.douyin.com/' || c_custkey || '/' ELSE c_name END AS value""",
)


def _address():
    k = F.col("event_id")
    return F.concat_ws(".", *[c.cast("string") for c in (k * 7 % 260, k * 13 % 256, k * 3 % 256, k % 256)])


_n = "((event_id * 7 % 260) * 16777216 + (event_id * 13 % 256) * 65536 + (event_id * 3 % 256) * 256 + event_id % 256)"
_closed = " OR ".join(
    f"{_n} BETWEEN {int(urls.ipaddress.IPv4Address(a))} AND {int(urls.ipaddress.IPv4Address(b))}" for a, b in urls._CLOSED_V4
)
scalar(
    "url5_is_public_address", "events",
    lambda: [F.col("event_id"), urls.is_public_address(_address()).alias("public")],
    f"event_id, CASE WHEN event_id * 7 % 260 > 255 THEN false ELSE NOT ({_closed}) END AS public",
)

# ---------------------------------------------------------------- dates, numbers, lists

scalar(
    "dt1_epoch_text", "events",
    lambda: [F.col("event_id"), values.epoch_ms_to_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("t"),
             values.epoch_day(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day")],
    "event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%Y-%m-%d') AS day",
)
scalar(
    "dt2_backoff", "lineitem",
    lambda: [F.col("l_orderkey"), F.col("l_linenumber"), values.backoff_seconds("l_linenumber").alias("wait_s")],
    "l_orderkey, l_linenumber, CAST(least(86400, 3600 * pow(2, l_linenumber)) AS BIGINT) AS wait_s",
)
scalar(
    "dt3_retry_after", "events",
    lambda: [F.col("event_id"), values.retry_after(
        F.concat(F.lit("Please Retry in "), F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string")).otherwise("a "), F.lit("s"))
    ).alias("wait_s")],
    "event_id, CASE WHEN event_id % 5 > 0 THEN least(60.0::DOUBLE, greatest(1.0::DOUBLE, value + 1.0::DOUBLE)) ELSE 30.0::DOUBLE END AS wait_s",
)
scalar(
    "dt4_ass_time", "events",
    lambda: [F.col("event_id"), values.ass_time(F.col("event_id") * 137).alias("t"),
             values.ass_time_from_stamp(srt.ms_to_ts(F.col("event_id") * 7919)).alias("cut")],
    """event_id, printf('%d:%02d:%02d.%02d', event_id * 13700 // 360000, event_id * 13700 // 6000 % 60, event_id * 13700 // 100 % 60, event_id * 13700 % 100) AS t,
      printf('%02d:%02d:%02d.%02d', event_id * 7919 // 3600000, event_id * 7919 // 60000 % 60, event_id * 7919 // 1000 % 60, event_id * 7919 % 1000 // 10) AS cut""",
)


def _word():
    words = ["TRUE", " yes ", "0", "Off", "maybe"]
    out = F.lit(None).cast("string")
    for i, word in enumerate(words):
        out = F.when(F.col("o_orderkey") % 6 == i, word).otherwise(out)
    return out


scalar(
    "mth1_parse_bool", "orders",
    lambda: [F.col("o_orderkey"), values.parse_bool(_word()).alias("off"), values.parse_bool(_word(), True).alias("on")],
    "o_orderkey, o_orderkey % 6 IN (0, 1) AS off, o_orderkey % 6 NOT IN (2, 3) AS \"on\"",
)


def _bounded():
    raw = F.when(F.col("l_linenumber") == 1, "x").when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(F.col("l_quantity").cast("string"))
    return values.bounded_number(raw, 60, 3, 40, True)


scalar(
    "mth2_bounded_number", "lineitem",
    lambda: [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), _bounded()["value"].alias("value"), _bounded()["error"].alias("error")],
    """l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 2 AND l_quantity BETWEEN 3 AND 40 THEN l_quantity END AS value,
      CASE WHEN l_linenumber = 1 THEN 'not_a_number' WHEN l_linenumber = 2 OR l_quantity NOT BETWEEN 3 AND 40 THEN 'out_of_range' END AS error""",
)


def _ratio(column, by):
    return F.col(column) % by / F.lit(float(by))


def _pixels():
    return values.region_to_pixels(
        _ratio("p_partkey", 97), _ratio("p_partkey", 89), _ratio("p_partkey", 83), _ratio("p_partkey", 79),
        F.lit(1080), F.lit(1920),
    )


_px = {
    "x": "greatest(0, least(CAST(trunc(1080 * (p_partkey % 97 / 97.0::DOUBLE)) AS INTEGER), 1076))",
    "y": "greatest(0, least(CAST(trunc(1920 * (p_partkey % 89 / 89.0::DOUBLE)) AS INTEGER), 1916))",
}
_pw = f"greatest(4, least(CAST(trunc(1080 * (p_partkey % 83 / 83.0::DOUBLE)) AS INTEGER), 1080 - {_px['x']}))"
_ph = f"greatest(4, least(CAST(trunc(1920 * (p_partkey % 79 / 79.0::DOUBLE)) AS INTEGER), 1920 - {_px['y']}))"
scalar(
    "mth3_region_to_pixels", "part",
    lambda: [F.col("p_partkey"), *[_pixels()[c].alias(c) for c in "xywh"]],
    f"p_partkey, {_px['x']} - {_px['x']} % 2 AS x, {_px['y']} - {_px['y']} % 2 AS y, "
    f"greatest(4, {_pw} - {_pw} % 2) AS w, greatest(4, {_ph} - {_ph} % 2) AS h",
)
scalar(
    "mth4_font_size", "part",
    lambda: [F.col("p_partkey"), values.font_size(F.col("p_partkey") * 3).alias("size"),
             values.side_margins(F.lit(1080), (F.col("p_partkey") % 300).cast("int"), F.lit(800))["left"].alias("margin_l"),
             values.side_margins(F.lit(1080), (F.col("p_partkey") % 300).cast("int"), F.lit(800))["right"].alias("margin_r")],
    "p_partkey, greatest(20, least(56, CAST(trunc(p_partkey * 3 * 0.038::DOUBLE) AS INTEGER))) AS size, "
    "CAST(greatest(43, p_partkey % 300) AS INTEGER) AS margin_l, CAST(greatest(43, 280 - p_partkey % 300) AS INTEGER) AS margin_r",
)


def _list():
    return F.concat(F.lit("MP4; .mkv, mp4 "), F.when(F.col("o_orderstatus") == "P", "gif").otherwise(""))


scalar(
    "arr1_parse_list", "orders",
    lambda: [
        F.col("o_orderkey"), F.array_join(values.parse_extensions(_list())["value"], ",").alias("suffixes"),
        values.parse_extensions(_list())["error"].alias("error"),
        F.array_join(values.parse_languages(F.when(F.col("o_orderstatus") == "F", '["en","xx","vi","en"]')), ",").alias("langs"),
        F.array_join(values.parse_ids(F.concat_ws(",", F.col("o_custkey").cast("string"), F.lit("z; 7"), F.col("o_custkey").cast("string"))), ",").alias("ids"),
        F.array_join(values.parse_keys(F.concat_ws(",", "o_orderstatus", F.lit(" k "), "o_orderstatus")), ",").alias("keys"),
    ],
    """o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '.mkv,.mp4' END AS suffixes, CASE WHEN o_orderstatus = 'P' THEN 'unknown_extension' END AS error,
      CASE WHEN o_orderstatus = 'F' THEN 'en,vi' ELSE '' END AS langs,
      CASE WHEN o_custkey = 7 THEN '7' WHEN o_custkey < 7 THEN o_custkey || ',7' ELSE '7,' || o_custkey END AS ids,
      o_orderstatus || ',k' AS keys""",
)


def _settings():
    inner = F.create_map(F.lit("voice"), F.col("o_orderstatus"), F.lit("Session_Token"), F.lit("t"))
    return F.create_map(
        F.lit("tts"), inner, F.lit("_owner"), inner, F.concat(F.lit("k"), F.col("o_orderkey").cast("string")), inner,
        F.lit("API_KEY"), inner,
    )


scalar(
    "map1_public_view", "orders",
    lambda: [
        F.col("o_orderkey"),
        F.array_join(F.array_sort(F.map_keys(values.public_view_nested(_settings()))), ",").alias("keys"),
        F.array_join(F.map_keys(F.try_element_at(values.public_view_nested(_settings()), F.lit("tts"))), ",").alias("inner"),
    ],
    "o_orderkey, 'k' || o_orderkey || ',tts' AS keys, 'voice' AS \"inner\"",
)
@query("map1_public_rows", """SELECT o_orderkey, '{"jobs":[{"id":' || o_orderkey || ',"steps":[{"name":"tts","params":{"voice":"v' || o_orderkey % 3 || '"}}]},{"id":2}],"status":"' || o_orderstatus || '"}' AS shown FROM orders""")
def _public_rows(spark, sf_dir):
    """Maps in structs in arrays in structs in arrays, with private keys on every level."""
    step = F.struct(F.lit("tts").alias("name"), F.lit("x").alias("apiToken"), F.create_map(
        F.lit("voice"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")), F.lit("API_KEY"), F.lit("k"), F.lit("_seed"), F.lit("1")).alias("params"))
    jobs = F.array(
        F.struct(F.col("o_orderkey").alias("id"), F.lit("s").alias("_secret"), F.array(step).alias("steps")),
        F.struct(F.lit(2).cast("bigint").alias("id"), F.lit("s").alias("_secret"), F.lit(None).cast("array<struct<name:string,apiToken:string,params:map<string,string>>>").alias("steps")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(jobs.alias("jobs"), F.col("o_orderstatus").alias("status"), F.lit("c").alias("sessionCookie")).alias("state"), F.lit("p").alias("password"))
    return values.public_rows(rows).select("o_orderkey", F.to_json("state").alias("shown"))


scalar(
    "hsh1_identity_key", "conversations",
    lambda: [F.col("conv_id"), F.col("turn"), values.identity_key("text", F.lit("en"), "role", "turn").alias("cache_key"),
             values.package_key(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.sha2("text", 256), F.sha2("role", 256)).alias("package_id")],
    """conv_id, turn, left(sha256(CAST(to_json([text, 'en', role, CAST(turn AS VARCHAR)]) AS VARCHAR)), 24) AS cache_key,
      'dysrt_' || left(sha256(conv_id || '|' || turn || '|' || sha256(text) || '|' || sha256(role)), 24) AS package_id""",
)


@query("lay1_fit_layout", r"""WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, conv_id AS track_id, regexp_replace(nfc_normalize(replace(coalesce(text, ''), chr(13), '')), '^\s+|\s+$', '', 'g') AS t FROM conversations),
    pa AS (SELECT rid, generate_subscripts(ps, 1) AS p, unnest(ps) AS para FROM (SELECT rid, string_split(t, chr(10)) AS ps FROM r)),
    wd AS (SELECT rid, p, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT rid, p, list_filter(regexp_split_to_array(para, '\s+'), lambda x: x <> '') AS ws FROM pa)),
    sz AS (SELECT unnest(range(16, 57)) AS size),
    tk AS (SELECT rid, size, row_number() OVER (PARTITION BY rid, size ORDER BY p, k, c) AS n, chars, opens FROM (
      SELECT rid, size, p, k, 0 AS c, len(w) AS chars, k = 1 AS opens FROM wd, sz WHERE len(w) * (size * 0.58::DOUBLE) <= 888
      UNION ALL SELECT rid, size, p, k, c, least(most, len(w) - c), true FROM (
        SELECT rid, size, p, k, w, most, unnest(range(0, len(w), most)) AS c FROM (
          SELECT *, CAST(floor(888 / (size * 0.58::DOUBLE)) AS BIGINT) AS most FROM wd, sz WHERE len(w) * (size * 0.58::DOUBLE) > 888)))),
    z AS (SELECT rid, size, n, chars, 1 AS lines FROM tk WHERE n = 1
      UNION ALL SELECT rid, size, n, CASE WHEN flows THEN joint ELSE chars END, lines + CASE WHEN flows THEN 0 ELSE 1 END FROM (
        SELECT t.rid, t.size, t.n, t.chars, z.lines, z.chars + 1 + t.chars AS joint, NOT t.opens AND (z.chars + 1 + t.chars) * (t.size * 0.58::DOUBLE) <= 888 AS flows
        FROM z JOIN tk t ON t.rid = z.rid AND t.size = z.size AND t.n = z.n + 1)),
    ln AS (SELECT r.rid, track_id, sz.size, coalesce(max(lines), 1) AS lines FROM r CROSS JOIN sz LEFT JOIN z ON z.rid = r.rid AND z.size = sz.size GROUP BY ALL),
    ft AS (SELECT rid, track_id, max(size) FILTER (lines <= 4 AND lines * size * 1.15::DOUBLE <= 162) AS best FROM ln GROUP BY ALL)
    SELECT track_id, count(*) AS cues, count(*) FILTER (best IS NULL) AS overflow, CAST(min(coalesce(best, 16)) AS INTEGER) AS smallest_size FROM ft GROUP BY track_id""")
def _layout(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn"), "text")
    return C.layout_audit(rows, 900, 170, 56, 16)


# ------------------------------------------------------------------ documents and answers


def srt_docs(spark, sf_dir):
    return C.to_srt(phrases_from_conversations(spark, sf_dir))


TS = ("printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)")
STAMP = f"{TS.format('start_ms')} || ' --> ' || {TS.format('end_ms')}"


@query("prs1_parse_srt", with_(PHRASES) + f"SELECT track_id, CAST(cue_id AS INTEGER) AS pos, CAST(cue_id AS VARCHAR) AS idx, {STAMP} AS stamp, text FROM cues")
def _parse(spark, sf_dir):
    return srt.parse_srt(srt_docs(spark, sf_dir)).drop("part")


@query("prs4_cue_timings", with_(PHRASES) + "SELECT track_id, CAST(cue_id AS INTEGER) AS cue_id, start_ms, end_ms, text FROM cues")
def _timings(spark, sf_dir):
    return srt.cue_timings(srt_docs(spark, sf_dir)).drop("part")


@query("prs5_tts_segments", with_(PHRASES) + """SELECT track_id, CAST(cue_id AS INTEGER) AS seg_no, CAST(cue_id AS INTEGER) AS index, start_ms, end_ms,
    end_ms - start_ms AS duration_ms, text, '[' || speaker || '] ' || text AS raw_text, speaker FROM cues""")
def _segments(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir).withColumn("text", F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("text")))
    return srt.tts_segments(C.to_srt(cues)).drop("part")


@query("prs6_repair_srt", with_(PHRASES) + f"""SELECT track_id, CAST((cue_id - 1) // 20000 AS INTEGER) AS part,
    string_agg(cue_id || chr(10) || {STAMP} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_id) AS content FROM cues GROUP BY ALL""")
def _repair(spark, sf_dir):
    """Answers with fences, wrong numbers, dots and missing hours."""
    short = F.regexp_replace("content", r"(?m)^\d+$", "9")
    short = F.regexp_replace(short, r"00:(\d\d:\d\d),(\d\d\d)", "$1.$2")
    docs = srt_docs(spark, sf_dir).select("track_id", "part", F.concat(F.lit("```srt\n"), short, F.lit("\n```")).alias("raw"))
    return srt.repair_documents(docs)


@query("prs7_count_segments", with_(PHRASES) + "SELECT track_id, CAST(count(*) AS INTEGER) AS segments FROM cues GROUP BY track_id")
def _count(spark, sf_dir):
    return srt_docs(spark, sf_dir).groupBy("track_id").agg(F.sum(srt.count_segments("content")).cast("int").alias("segments"))


def numbered_answers(spark, sf_dir):
    """One answer per batch of 15 lines; the first line is told twice."""
    cues = C.batch_by_count(phrases_from_conversations(spark, sf_dir))
    line = F.format_string("%d. [%s] %s", (F.col("cue_id") - 1) % 15 + 1, F.col("speaker"), F.col("text"))
    return cues.groupBy("track_id", "batch_no").agg(
        F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n1) (X9) told again\n99. beyond\nno number")).alias("raw")
    )


@query("prs8_parse_numbered", with_(PHRASES) + """SELECT track_id, (cue_id - 1) // 15 AS batch_no, (cue_id - 1) % 15 AS "offset",
    CASE WHEN (cue_id - 1) % 15 = 0 THEN 'told again' ELSE text END AS text, speaker FROM cues""")
def _numbered(spark, sf_dir):
    return srt.parse_numbered(numbered_answers(spark, sf_dir), 15)


def pair_groups(cues, broken: bool = False):
    """Groups of two cues in model form; ``broken`` spoils some tracks."""
    groups = cues.groupBy("track_id", F.floor((F.col("cue_id") - 1) / 2).alias("g")).agg(
        F.array_sort(F.collect_list("cue_id")).alias("source_ids"),
        F.min_by("text", "cue_id").alias("translation"), F.min("speaker").alias("speaker"),
    )
    if broken:
        groups = groups.where((F.col("track_id") % 5 != 1) | (F.col("g") != 3)).withColumn(
            "source_ids",
            F.when((F.col("track_id") % 5 == 2) & (F.col("g") == 2), F.concat(F.array(F.lit(1).cast("bigint")), F.col("source_ids"))).otherwise(F.col("source_ids")),
        )
    return at_most(groups.select("track_id", (F.col("g") + 1).cast("int").alias("group_no"), "source_ids", "translation", "speaker"), cues)


def fusion_answers(spark, sf_dir, broken: bool = False):
    """One JSON answer per track; conversations are short, so an answer is small."""
    g = F.struct("source_ids", "translation", "speaker")
    return pair_groups(phrases_from_conversations(spark, sf_dir), broken).groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("group_no", g.alias("g")))).alias("gs")
    ).select("track_id", F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.transform("gs", lambda x: x["g"]).alias("groups"))), F.lit("\n```")).alias("raw"))


@query("prs9_parse_fusion", with_(PHRASES) + """SELECT track_id, CAST((cue_id - 1) // 2 + 1 AS INTEGER) AS group_no,
    string_agg(CAST(cue_id AS VARCHAR), ',' ORDER BY cue_id) AS ids, arg_min(text, cue_id) AS translation, min(speaker) AS speaker,
    CAST(NULL AS VARCHAR) AS error FROM cues GROUP BY track_id, (cue_id - 1) // 2""")
def _fusion(spark, sf_dir):
    return srt.parse_fusion(fusion_answers(spark, sf_dir)).select(
        "track_id", "group_no", F.array_join("source_ids", ",").alias("ids"), "translation", "speaker", "error")


@query("prs10_parse_segmentation", r"""WITH s AS (SELECT conv_id AS track_id, CAST(turn + 1 AS INTEGER) AS index, """ + SQ.format("text") + r""" AS t FROM conversations)
    SELECT track_id, index, t || '|second' AS segments, CAST(NULL AS VARCHAR) AS error FROM s""")
def _segmentation(spark, sf_dir):
    item = F.struct((F.col("turn") + 1).alias("index"), F.array(
        F.to_json(F.struct("text")), F.to_json(F.struct(F.lit("second").alias("text")))).alias("segments"))
    made = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("track_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    # Segments are objects, so the strings of the array are put back as JSON.
    raw = F.concat(F.lit('{"items":['), F.array_join(F.transform("items", lambda e: F.concat(
        F.lit('{"index":'), e["index"].cast("string"), F.lit(',"segments":['), F.array_join(e["segments"], ","), F.lit("]}"))), ","), F.lit("]}"))
    return srt.parse_segmentation(made.select("track_id", raw.alias("raw"))).select(
        "track_id", "index", F.array_join("segments", "|").alias("segments"), "error")


@query("prs11_parse_contact_sheet", """WITH e AS (SELECT user_id, event_id, event_type FROM events), bad AS (SELECT user_id FROM e GROUP BY user_id HAVING user_id % 4 = 0)
    SELECT user_id, CAST(event_id AS VARCHAR) AS frame_id, 'seen ' || event_type AS text, CASE WHEN event_type = 'view' THEN 'ui' ELSE 'none' END AS kind, CAST(NULL AS VARCHAR) AS error
    FROM e WHERE user_id % 4 <> 0 UNION ALL SELECT user_id, NULL, '', 'none', 'duplicate_frame' FROM bad""")
def _contact(spark, sf_dir):
    """An answer per user; every fourth one names a frame twice."""
    kind = F.when(F.col("event_type") == "view", "UI").otherwise("other")
    frame = F.struct(F.col("event_id").cast("string").alias("frame_id"), F.concat(F.lit(" seen  "), F.col("event_type")).alias("text"), kind.alias("kind"))
    made = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(frame).alias("frames"), F.collect_list(F.col("event_id").cast("string")).alias("expected"))
    frames = F.when(F.col("user_id") % 4 == 0, F.concat("frames", F.slice("frames", 1, 1))).otherwise(F.col("frames"))
    return srt.parse_contact_sheet(made.select("user_id", "expected", F.to_json(F.struct(frames.alias("frames"))).alias("raw")))


@query("prs12_finish_reason", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'cut_off' WHEN event_type = 'error' THEN 'empty' END AS error FROM events""")
def _finish(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type").isin("click", "view"), "length").when(F.col("event_type") == "signup", "stop").alias("finish_reason"),
        F.when(F.col("event_type") == "error", "  ").otherwise(F.col("props")).alias("raw"))
    return srt.gate_finish_reason(rows).select("event_id", "error")


def message_frames(spark, sf_dir):
    kinds = F.create_map(*[F.lit(v) for p in {"purchase": 7, "view": 5, "click": 8, "signup": 50001, "error": 99}.items() for v in p])
    body = (
        F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.col("props").alias("text"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.struct(F.array(F.col("event_id").cast("string")).alias("url_list")).alias("url"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(F.col("event_id").alias("itemId"))))
        .otherwise(F.to_json(F.struct(F.col("event_id").alias("read_index"))))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("conversation_id"), F.col("user_id").alias("sender"), F.col("event_id").alias("message_index"),
        kinds[F.col("event_type")].alias("message_type"), body.alias("content"))


MESSAGES_SQL = """SELECT CAST(user_id AS VARCHAR) AS conversation_id, user_id AS sender, event_id AS message_index,
    CASE event_type WHEN 'purchase' THEN 7 WHEN 'view' THEN 5 WHEN 'click' THEN 8 ELSE 50001 END AS message_type,
    CASE event_type WHEN 'purchase' THEN 'text' WHEN 'view' THEN 'sticker' WHEN 'click' THEN 'share' ELSE 'read' END AS kind,
    CASE event_type WHEN 'purchase' THEN props ELSE CAST(event_id AS VARCHAR) END AS value
    FROM events WHERE event_type <> 'error'"""


@query("prs13_decode_messages", MESSAGES_SQL)
def _messages(spark, sf_dir):
    return readers.decode_messages(message_frames(spark, sf_dir))


def raw_works(spark, sf_dir):
    """Orders and their customers as nested feed entries."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n, name = F.col("o_orderkey"), F.col("c_name")
    one = lambda c: F.struct(F.array(c).alias("url_list"))
    return rows.select(
        n.cast("string").alias("aweme_id"), F.col("o_orderpriority").alias("desc"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("create_time"),
        F.when(F.col("o_orderstatus") == "P", 68).when(F.col("o_orderstatus") == "F", 0).otherwise(4).alias("aweme_type"),
        F.lit(None).cast("array<string>").alias("images"),
        F.struct(
            F.concat(F.lit("S"), n.cast("string")).alias("sec_uid"), F.col("c_mktsegment").alias("signature"),
            F.lit(None).cast("bigint").alias("following_count"), F.col("c_custkey").alias("follower_count"),
            F.lit(None).cast("bigint").alias("total_favorited"), F.lit(None).cast("bigint").alias("aweme_count"),
            name.alias("unique_id"), F.lit(None).cast("int").alias("user_age"),
            (F.col("c_nationkey") % 3).alias("gender"), name.alias("nickname"), one(name).alias("avatar_thumb"),
        ).alias("author"),
        F.struct(F.lit(None).cast("string").alias("ip_location")).alias("user"),
        F.struct(one(name).alias("cover"), F.struct(
            F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("uri"), F.array(name).alias("url_list")).alias("play_addr")).alias("video"),
        F.struct(F.lit(None).cast("bigint").alias("admire_count"), *[
            (n % m).alias(c) for c, m in (("digg_count", 11), ("comment_count", 7), ("collect_count", 5), ("share_count", 3))]).alias("statistics"),
        F.array(F.struct(F.col("o_orderstatus").alias("hashtag_name")), F.struct(F.lit("").alias("hashtag_name"))).alias("text_extra"),
    )


@query("prs14_flatten_works", """SELECT CAST(o_orderkey AS VARCHAR) AS work_id, 'https://www.douyin.com/video/' || o_orderkey AS work_url,
    CASE o_orderstatus WHEN 'P' THEN '图集' WHEN 'F' THEN '视频' ELSE '未知' END AS work_type, o_orderpriority AS title,
    o_orderkey % 11 AS digg_count, CAST(0 AS BIGINT) AS admire_count,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://aweme.snssdk.com/aweme/v1/play/?video_id=' || o_orderkey || '&ratio=default' ELSE c_name END AS video_addr,
    o_orderstatus AS topics, CASE c_nationkey % 3 WHEN 1 THEN '男' WHEN 0 THEN '女' ELSE '未知' END AS gender, '未知' AS ip_location,
    c_mktsegment AS user_desc, c_custkey AS follower_count, CAST(NULL AS BIGINT) AS following_count
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def _flat(spark, sf_dir):
    return readers.flatten_works(raw_works(spark, sf_dir)).select(
        "work_id", "work_url", "work_type", "title", "digg_count", "admire_count", "video_addr",
        F.array_join("topics", ",").alias("topics"), "gender", "ip_location", "user_desc", "follower_count", "following_count")


@query("prs16_extract_embedded", r"""SELECT page_id, CAST(page_id * 11 AS VARCHAR) AS room_id, CAST(page_id AS VARCHAR) AS user_id, '2' AS room_status,
    'live ' || page_id AS room_title, CASE WHEN page_id % 2 = 0 THEN 'https://v5.douyinvod.com/' || page_id ELSE '' END AS media
    FROM pages WHERE page_id % 5 <> 0 OR regexp_matches(html, 'zjcdn|douyinvod|bytecdn|roomId')""")
def _embedded(spark, sf_dir):
    """Pages with a live-room script put in front of their whole text."""
    n = F.col("page_id").cast("string")
    script = F.concat(
        F.lit(r'<script>{\"roomInfo\":{\"room\":{\"id_str\":\"1\",\"status\":2,\"status_str\":\"2\",\"title\":\"live '), n,
        F.lit(r'\"}},\"roomId\":\"'), (F.col("page_id") * 11).cast("string"), F.lit(r'\",\"user_unique_id\":\"'), n, F.lit(r'\"}</script> "'),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://v5.douyinvod.com/"), n)).otherwise(""), F.lit('" '))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 != 0, F.concat(script, "html")).otherwise(F.col("html")).alias("html"))
    return readers.extract_embedded(pages).select(
        "page_id", "room_id", "user_id", "room_status", "room_title", F.array_join("media_urls", ",").alias("media"))


