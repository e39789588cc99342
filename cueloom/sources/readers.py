"""Readers: files and logs to tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import is_blank
from cueloom.functions.urls import is_media_url
from cueloom.functions.values import VIDEO_SUFFIXES
from cueloom.operators.quality import voice_map

# Post types that count as a work even without a video block.
WORK_TYPES = [0, 4, 51, 53, 55, 68]
# Subtitle region used when no preset is stored.
DEFAULT_PRESET = ("default", "Mặc định (Sub dưới)", 0.08, 0.81, 0.84, 0.085)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files as ``(track_id, content)``, a leading byte order mark removed."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.srt")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.srt\z", 1)
    return rows.select(
        F.url_decode(name).alias("track_id"), F.regexp_replace("value", r"\A\uFEFF", "").alias("content")
    )


def _local(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/*", "/")


def scan_media(spark: SparkSession, root: str, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    """Video files below a folder with size and time; file contents are never read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(_local(F.col("path")).alias("path"), F.col("length").alias("size"),
                F.unix_micros("modificationTime").alias("_us"))
    )
    base = root.rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.lit(len(base) + 1))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    rows = listed.where(suffix.isin(suffixes or VIDEO_SUFFIXES)).select(
        "path", relative.alias("relative_path"), "size", (F.col("_us") / F.lit(1e6)).alias("mtime")
    )
    return rows if recursive else rows.where(~F.col("relative_path").contains("/"))


def stable_paths(media: DataFrame) -> DataFrame:
    return media.orderBy(F.lower("relative_path"), "relative_path")


def fingerprint(media: DataFrame) -> DataFrame:
    """Add the SHA-256 of each file, read in pieces so its size does not matter."""
    schema = T.StructType([*media.schema.fields, T.StructField("sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                filesystem, place = fs.FileSystem.from_uri(path)
                with filesystem.open_input_stream(place) as stream:
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests)], names=[*batch.schema.names, "sha256"]
            )

    return media.mapInArrow(run, schema)


def fingerprint_contents(files: DataFrame) -> DataFrame:
    """SHA-256 of ``content`` columns already loaded."""
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


_URLS = "struct<url_list:array<string>>"
WORK_SCHEMA = f"""
aweme_id string, desc string, create_time bigint, aweme_type int, images array<string>,
author struct<sec_uid:string,signature:string,following_count:bigint,follower_count:bigint,
  total_favorited:bigint,aweme_count:bigint,unique_id:string,user_age:int,gender:int,nickname:string,
  avatar_thumb:{_URLS}>,
user struct<ip_location:string>,
video struct<cover:{_URLS},play_addr:struct<uri:string,url_list:array<string>>>,
statistics struct<admire_count:bigint,digg_count:bigint,comment_count:bigint,collect_count:bigint,share_count:bigint>,
text_extra array<struct<hashtag_name:string>>
"""
def page_schema() -> T.StructType:
    return T.StructType([
        T.StructField("aweme_list", T.ArrayType(T.StructType.fromDDL(WORK_SCHEMA))),
        T.StructField("page", T.IntegerType()),
    ])



def works_of_pages(pages: DataFrame) -> DataFrame:
    """Works listed on feed pages; posts without id or of other types are skipped."""
    rows = pages.select("page", F.posexplode("aweme_list").alias("pos", "w"))
    kept = ~is_blank("w.aweme_id") & (F.col("w.video").isNotNull() | F.col("w.aweme_type").isin(WORK_TYPES))
    return rows.where(kept).select("page", "pos", "w.*")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return works_of_pages(spark.read.schema(page_schema()).json(path, multiLine=True))


def read_json_config(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """Stored settings; documents of another shape give the default rows, or none."""
    fields = T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    good = rows.where(F.col("_bad").isNull() & F.coalesce(*[F.col(f.name).cast("string") for f in fields]).isNotNull()).drop("_bad")
    if default is None:
        return good
    return default if good.isEmpty() else good


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """Job snapshots, newest first."""
    return newest_first(spark.read.parquet(path))


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("updated"))


_NET = (
    "struct<message:struct<method:string,params:struct<response:struct<"
    "status:double,url:string,mimeType:string>>>>"
)


def media_of_net_log(log: DataFrame, keys: list[str]) -> DataFrame:
    """Stream links in a browser network log (``message`` JSON, ``pos``), first seen first."""
    told = F.col("message").contains("Network.responseReceived")
    m = F.from_json("message", _NET)["message"]
    reply = m["params"]["response"]
    rows = log.where(told).select(
        *keys, "pos", m["method"].alias("method"), reply["status"].alias("status"),
        reply["url"].alias("url"), reply["mimeType"].alias("mime"),
    )
    good = (F.col("method") == "Network.responseReceived") & (F.col("status") >= 200) & (F.col("status") < 400)
    return rows.where(good & is_media_url("url", "mime")).groupBy(*keys, "url").agg(F.min("pos").alias("first_pos"))


# Sections of a job document that hold results, and the fields that name files.
RESULT_SECTIONS = ["srt_files", "step_results"]
RESULT_OBJECTS = ["clean_video", "burned_video", "aligned_srt"]
RESULT_PREFIXES = ["tts_", "burn_"]
FILE_FIELDS = ["path", "audio_path", "srt_path"]


def list_artifacts(jobs: DataFrame, output_root: str) -> DataFrame:
    """Output files that the result sections of a job document name at any depth: ``(job_id, path)``."""
    root = output_root.rstrip("/") + "/"
    sections = F.map_entries(F.from_json("document", "map<string,string>"))

    def holds_results(entry: Column) -> Column:
        named = entry["key"].isin(RESULT_OBJECTS)
        for prefix in RESULT_PREFIXES:
            named = named | entry["key"].startswith(prefix)
        return entry["key"].isin(RESULT_SECTIONS) | (named & entry["value"].startswith("{"))

    # A field within a string value has escaped quotes and is not one.
    field = rf'(?<!\\)"(?:{"|".join(FILE_FIELDS)})"\s*:\s*("(?:[^"\\]|\\.)*")'
    quoted = F.flatten(F.transform(F.filter(sections, holds_results), lambda e: F.regexp_extract_all(e["value"], F.lit(field), F.lit(1))))
    paths = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    found = jobs.select(F.col("job_id").cast("string").alias("job_id"), F.explode(paths).alias("path"))
    return found.where(F.col("path").startswith(root)).distinct()


def inventory_outputs(media: DataFrame) -> DataFrame:
    """Artifacts found on disk per job, for jobs whose record is gone.

    ``media`` is ``(job_id, path, size)``. Such a job counts as interrupted, never as done.
    """
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"\.[^.]+\z", "")
    kind = (
        F.when(name.endswith(".srt"), "srt")
        .when(name.rlike(r"\Atts_.*\.mp3\z"), "tts")
        .when(name.rlike(r"_sub\.mp4\z|\A(\w+_)?burned_.*\.mp4\z|_clean\.mp4\z"), "video")
    )
    by_suffix = F.regexp_extract(stem, r"[_.](vi|en|id)\z", 1)
    inside = F.lit("vi")
    for lang in ("id", "en", "vi"):
        inside = F.when(name.contains(f"_{lang}"), lang).otherwise(inside)
    lang = (
        F.when(kind == "srt", F.coalesce(F.nullif(by_suffix, F.lit("")), F.lit("zh")))
        .when(kind == "tts", F.regexp_replace(stem, r"\Atts_(aligned_)?", ""))
        .otherwise(inside)
    )
    rows = media.withColumn("kind", kind).withColumn("lang", lang).where(F.col("kind").isNotNull())
    kept = rows.where((F.col("kind") != "video") | (F.col("size") > 0))
    return kept.groupBy("job_id", "kind", "lang").agg(
        F.max("path").alias("path"), F.max_by("size", "path").alias("size"), F.count(F.lit(1)).alias("files")
    ).withColumn("job_status", F.lit("interrupted"))


def load_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """Built-in presets and voices as dimension tables of fixed size."""
    key, name, x, y, w, h = DEFAULT_PRESET
    presets = spark.createDataFrame(
        [(key, name, (x, y, w, h), [])],
        "key string, name string, sub_region struct<x_ratio:double,y_ratio:double,w_ratio:double,h_ratio:double>,"
        "extra_regions array<struct<x_ratio:double,y_ratio:double,w_ratio:double,h_ratio:double>>",
    )
    return {"presets": presets, "voices": voice_map(spark)}


# ------------------------------------------------------------------------- work rows

UNKNOWN = "未知"


def flatten_works(raw: DataFrame) -> DataFrame:
    """Feed entries as 27 flat columns. Absent counts are NULL (see ``with_unknowns``)."""
    from cueloom.functions.urls import WORK_PAGE

    a, s, v = "author", "statistics", "video"
    vid = F.nullif(F.col(f"{v}.play_addr.uri"), F.lit(""))
    master = F.concat(F.lit("https://aweme.snssdk.com/aweme/v1/play/?video_id="), vid, F.lit("&ratio=default"))
    topics = F.filter(
        F.transform(F.coalesce("text_extra", F.array().cast("array<struct<hashtag_name:string>>")), lambda t: t["hashtag_name"]),
        lambda t: t.isNotNull() & (t != ""),
    )
    return raw.select(
        F.col("aweme_id").alias("work_id"),
        F.concat(F.lit(WORK_PAGE), F.col("aweme_id")).alias("work_url"),
        F.when(F.col("aweme_type") == 68, "图集").when(F.col("aweme_type") == 0, "视频").otherwise(UNKNOWN).alias("work_type"),
        F.col("desc").alias("title"), "desc",
        F.coalesce(f"{s}.admire_count", F.lit(0)).alias("admire_count"),
        f"{s}.digg_count", f"{s}.comment_count", f"{s}.collect_count", f"{s}.share_count",
        F.coalesce(master, F.get(f"{v}.play_addr.url_list", F.lit(0))).alias("video_addr"),
        F.coalesce("images", F.array().cast("array<string>")).alias("images"), topics.alias("topics"),
        "create_time", F.get(f"{v}.cover.url_list", F.lit(0)).alias("video_cover"),
        F.concat(F.lit("https://www.douyin.com/user/"), F.col(f"{a}.sec_uid")).alias("user_url"),
        F.col(f"{a}.unique_id").alias("user_id"), f"{a}.nickname",
        F.get(f"{a}.avatar_thumb.url_list", F.lit(0)).alias("author_avatar"),
        F.col(f"{a}.signature").alias("user_desc"), f"{a}.following_count", f"{a}.follower_count",
        f"{a}.total_favorited", f"{a}.aweme_count", f"{a}.user_age",
        F.when(F.col(f"{a}.gender") == 1, "男").when(F.col(f"{a}.gender") == 0, "女").otherwise(UNKNOWN).alias("gender"),
        F.coalesce("user.ip_location", F.lit(UNKNOWN)).alias("ip_location"),
    )


def with_unknowns(works: DataFrame) -> DataFrame:
    """Every column as text, absent author facts as the word for unknown."""
    facts = ["user_id", "user_desc", "following_count", "follower_count", "total_favorited", "aweme_count", "user_age"]
    return works.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) if c in facts else F.col(c).cast("string").alias(c)
        for c in works.columns
    ])


# --------------------------------------------------------------------------- messages

# Message types and where their content is found.
MESSAGE_PATHS = {
    7: ("text", "$.text"), 5: ("sticker", "$.url.url_list[0]"), 17: ("voice", "$.resource_url.url_list[0]"),
    27: ("image", "$.resource_url.origin_url_list[0]"), 8: ("share", "$.itemId"), 50001: ("read", "$.read_index"),
}


def decode_messages(frames: DataFrame) -> DataFrame:
    """Typed messages of push frames; works on tables and streams alike."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, (name, path) in MESSAGE_PATHS.items():
        hit = F.col("message_type") == number
        kind = F.when(hit, name).otherwise(kind)
        value = F.when(hit, F.get_json_object("content", path)).otherwise(value)
    return frames.withColumn("kind", kind).withColumn("value", value).where(F.col("kind").isNotNull()).drop("content")


MESSAGE_SCHEMA = "conversation_id string, sender bigint, message_index bigint, message_type int, content string"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Stream of push frames written as JSON lines, decoded."""
    return decode_messages(spark.readStream.schema(MESSAGE_SCHEMA).json(path))


# --------------------------------------------------------------- embedded page data


# Names of the room facts in page scripts, and hosts of stream links.
ROOM_FIELDS = {"room_id": "roomId", "user_id": "user_unique_id", "sec_uid": "sec_uid"}
STREAM_HOSTS = ["zjcdn", "douyinvod", "bytecdn"]


def extract_embedded(pages: DataFrame, html: str = "html") -> DataFrame:
    """Room facts of the JSON inside page scripts, and embedded stream links."""
    hosts = "|".join(STREAM_HOSTS)

    def field(source: Column, name: str, value: str = r'"([^"]*)"') -> Column:
        """The first value that follows the quoted name."""
        return F.nullif(F.regexp_extract(source, rf'"{name}"\s*:\s*{value}', 1), F.lit(""))

    def after(name: str) -> Column:
        place = F.locate(f'"{name}"', F.col("_script"))
        return F.when(place > 0, F.substr(F.col("_script"), place))

    # Scripts hold JSON as string literals, so quotes lose their backslash first.
    has_room, has_link = F.col(html).contains("roomId"), F.col(html).rlike(hosts)
    rows = pages.where(has_room | has_link).withColumn("_script", F.when(has_room, F.replace(F.col(html), F.lit('\\"'), F.lit('"'))))
    links = F.regexp_extract_all(F.col(html), F.lit(rf'(https?://v[^"\s\\]+(?:{hosts})[^"\s\\]*)'), F.lit(1))
    return rows.select(
        *[c for c in pages.columns if c != html],
        *[field(F.col("_script"), key).alias(name) for name, key in ROOM_FIELDS.items()],
        field(F.regexp_extract(after("anchor"), r"\A[^}]*", 0), "id_str").alias("anchor_id"),
        field(after("roomInfo"), "status", r'"?([^,"}]*)').alias("room_status"), field(after("roomInfo"), "title").alias("room_title"),
        F.array_distinct(F.transform(links, lambda u: F.replace(u, F.lit("\\u002F"), F.lit("/")))).alias("media_urls"),
    )
