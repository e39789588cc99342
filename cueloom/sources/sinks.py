"""Writers: tables to files and versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import path_nick, path_title, strip_controls
from cueloom.functions.values import epoch_ms_to_text
from cueloom.operators.cues import KEY, to_srt, track_validity, validate_cues

BOM = "\ufeff"

# Column titles of the exported works table, in order.
WORK_TITLES = {
    "work_id": "作品id", "work_url": "作品url", "work_type": "作品类型", "title": "作品标题", "desc": "描述",
    "admire_count": "admire数量", "digg_count": "点赞数量", "comment_count": "评论数量", "collect_count": "收藏数量",
    "share_count": "分享数量", "video_addr": "视频地址url", "images": "图片地址url列表", "topics": "标签",
    "create_time": "上传时间", "video_cover": "视频封面url", "user_url": "用户主页url", "user_id": "用户id",
    "nickname": "昵称", "author_avatar": "头像url", "user_desc": "用户描述", "following_count": "关注数量",
    "follower_count": "粉丝数量", "total_favorited": "作品被赞和收藏数量", "aweme_count": "作品数量",
    "user_age": "用户年龄", "gender": "性别", "ip_location": "ip归属地",
}


def split_valid(cues: DataFrame, duration_ms: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cues of valid tracks, and the invalid tracks with their first error."""
    checked = track_validity(validate_cues(cues, duration_ms))
    good = cues.join(checked.where("valid").select(KEY), KEY, "left_semi")
    return good, checked.where(~F.col("valid"))


def write_srt_files(cues: DataFrame, path: str, bom: bool = False) -> None:
    """One folder per track with its subtitle text; long tracks have several ordered files."""
    docs = to_srt(cues)
    content = F.concat(F.when((F.col("part") == 0) & F.lit(bom), BOM).otherwise(""), F.col("content"))
    docs.select(KEY, "part", content.alias("value")).repartition(KEY, "part").write.mode("overwrite").partitionBy(
        KEY, "part").text(path)


def write_validated_srt(cues: DataFrame, path: str, duration_ms: str | None = None) -> DataFrame:
    """Write valid tracks with a byte order mark; returns the refused tracks."""
    good, refused = split_valid(cues, duration_ms)
    write_srt_files(good, path, bom=True)
    return refused


def write_version(df: DataFrame, base: str) -> str:
    """Write a new version of a table; readers see it only when its commit marker exists."""
    spark = df.sparkSession
    version = max(committed_versions(spark, base), default=0) + 1
    target = f"{base.rstrip('/')}/v={version:08d}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, base: str) -> DataFrame | None:
    versions = committed_versions(spark, base)
    return spark.read.parquet(f"{base.rstrip('/')}/v={max(versions):08d}") if versions else None


def committed_versions(spark: SparkSession, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        match = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        if match and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(match.group(1)))
    return found


def manifest_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest entries as JSON lines, one per item, next to their batch id."""
    return items.select(*keys, F.to_json(F.struct(*items.columns)).alias("value"))


def write_manifest(items: DataFrame, base: str, keys: list[str]) -> str:
    """Manifest documents as a new version, so a reader never sees half of one."""
    return write_version(manifest_rows(items, keys), base)


def export_works(works: DataFrame) -> DataFrame:
    """All columns as text without control characters, under their export titles."""
    def text(column: str):
        kind = works.schema[column].dataType
        value = F.to_json(column) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.col(column).cast("string")
        return strip_controls(F.coalesce(value, F.lit("None")))

    return works.select(*[text(c).alias(WORK_TITLES.get(c, c)) for c in works.columns])


def write_works_table(works: DataFrame, path: str) -> None:
    export_works(works).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def work_folder(works: DataFrame):
    return F.concat_ws("_", F.concat(path_nick("nickname"), F.lit("_"), F.col("user_id").cast("string"), F.lit("/"), path_title("title")), F.col("work_id").cast("string"))


def work_details(works: DataFrame) -> DataFrame:
    """Title and value of every fact of a work, in order, next to the whole record as JSON."""
    def shown(c: str):
        if c == "create_time":
            return epoch_ms_to_text(c)
        if isinstance(works.schema[c].dataType, T.ArrayType):
            return F.array_join(c, ", ")
        return F.col(c).cast("string")

    pairs = F.array(*[
        F.struct(F.lit(WORK_TITLES.get(c, c)).alias("title"), shown(c).alias("value")) for c in works.columns
    ])
    rows = works.select(
        "work_id", F.to_json(F.struct(*works.columns)).alias("info"), F.posexplode(pairs).alias("line", "p")
    )
    return rows.select("work_id", "line", F.col("p.title").alias("title"), F.col("p.value").alias("value"), "info")


def write_work_details(works: DataFrame, path: str, channel: str = "user_id") -> None:
    works.select(channel, F.to_json(F.struct(*works.columns)).alias("value")).write.mode("overwrite").partitionBy(channel).text(path)


def track_reports(rows: DataFrame, header: DataFrame, order: list[str], part_rows: int = 5_000) -> DataFrame:
    """Per-track report: summary columns plus the rows as an array, in numbered parts."""
    from cueloom.operators.scan import plan_layout, scan

    layout = plan_layout(rows, [KEY], order)
    numbered = scan(rows, layout, {"_n": ("number", None)})
    part = F.floor((F.col("_n") - 1) / part_rows).cast("int")
    body = [c for c in rows.columns if c != KEY]
    packed = numbered.groupBy(KEY, part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", *body))), lambda e: F.struct(*[e[c].alias(c) for c in body])).alias("rows")
    )
    return packed.join(header, KEY, "left")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)
