"""Work feeds: what is new, what may be claimed, and reports over channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import is_blank
from cueloom.functions.urls import is_media_url, media_url_score
from cueloom.operators.scan import plan_layout, scan

# Ledger states in which a work is already being taken care of.
ACTIVE_STATES = ["CLAIMED", "DOWNLOADED", "PROCESSING", "PACKAGE_READY", "IMPORTED", "SCHEDULED", "PUBLISHED"]
WORK_KEY = ["channel_id", "work_id"]


def anti_history(works: DataFrame, history: DataFrame) -> DataFrame:
    return works.join(history.select("work_id"), "work_id", "left_anti")


def recent_unseen(works: DataFrame, history: DataFrame, now: Column | int, hours: int = 72) -> DataFrame:
    """Works of the last ``hours`` with an id that were not processed before."""
    since = (F.lit(now) if isinstance(now, int) else now) - hours * 3600
    fresh = works.where(~is_blank(F.col("work_id").cast("string")) & (F.col("create_time") >= since))
    return anti_history(fresh, history)


def claimable(works: DataFrame, ledger: DataFrame) -> DataFrame:
    busy = ledger.where(F.col("status").isin(ACTIVE_STATES)).select(*WORK_KEY)
    return works.join(busy, WORK_KEY, "left_anti")


def keep_last(works: DataFrame, key: str = "work_id", page: str = "page") -> DataFrame:
    """One row per id, from the last page that lists it."""
    rest = [c for c in works.columns if c != key]
    return works.groupBy(key).agg(F.max_by(F.struct(*rest), page).alias("w")).select(key, "w.*")


def newest_works(works: DataFrame, n: int = 18) -> DataFrame:
    """First ``n`` works of each channel by time; ranks are cut before the shuffle."""
    order = Window.partitionBy("channel_id").orderBy(F.desc("create_time"), "work_id")
    return works.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def oldest_first(works: DataFrame) -> DataFrame:
    return works.orderBy("create_time", "work_id")


# Publication windows in days and duration classes in minutes.
PUBLISHED_DAYS = {"any": None, "day": 1, "week": 7, "half_year": 180}
DURATION_CLASSES = {"any": (None, None), "short": (0, 60), "medium": (60, 300), "long": (300, None)}


def catalog_search(
    works: DataFrame, now: int, sort: str = "relevance", published: str = "any", duration: str = "any",
    kind: str = "any", num: int = 20, keyword: str | None = None,
) -> DataFrame:
    """First ``num`` works that pass the filters; relevance keeps the catalogue order."""
    rows = works
    if PUBLISHED_DAYS[published]:
        rows = rows.where(F.col("create_time") >= now - PUBLISHED_DAYS[published] * 86_400)
    low, high = DURATION_CLASSES[duration]
    if low is not None:
        rows = rows.where(F.col("duration_s") >= low)
    if high is not None:
        rows = rows.where(F.col("duration_s") < high)
    if kind != "any":
        rows = rows.where(F.col("kind") == kind)
    if keyword:
        rows = rows.where(F.lower("title").contains(keyword.lower()))
    order = {
        "relevance": [F.col("work_id")], "likes": [F.desc("likes"), F.col("work_id")],
        "newest": [F.desc("create_time"), F.col("work_id")],
    }[sort]
    return rows.orderBy(*order).limit(num)


def take_n(pages: DataFrame, n: int, page: str = "page", pos: str = "pos") -> DataFrame:
    """First ``n`` entries of a paged list."""
    return pages.orderBy(page, pos).limit(n)


def union_pages(*pages: DataFrame) -> DataFrame:
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def with_config(works: DataFrame, channels: DataFrame, options: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """Works of enabled channels with their settings: channel before option before default."""
    own = channels.where(F.coalesce("enabled", F.lit(True)))
    settings = []
    for name, default in defaults.items():
        given = F.nullif(F.col(f"c.{name}"), F.lit("")) if name in channels.columns else F.lit(None).cast("string")
        settings.append(F.coalesce(given, F.lit(options.get(name)), F.lit(default)).alias(name))
    same = F.lower(F.col("w.channel_id").cast("string")) == F.lower(F.col("c.channel_id").cast("string"))
    return works.alias("w").join(own.alias("c"), same).select("w.*", *settings)


def match_user(users: DataFrame) -> DataFrame:
    """Best search hit per query: equal handle or short id first, else the first result."""
    wanted = F.lower(F.regexp_replace("query", "@", ""))
    exact = (F.lower("unique_id") == wanted) | (F.lower("short_id") == wanted)
    rank = F.struct(F.when(F.coalesce(exact, F.lit(False)), 0).otherwise(1).alias("miss"), F.col("pos"))
    return users.groupBy("query").agg(
        F.min_by("user_id", rank).alias("user_id"), F.bool_or(F.coalesce(exact, F.lit(False))).alias("exact")
    )


REPLIES_PER_PART = 1000


def nest_replies(comments: DataFrame, part_rows: int = REPLIES_PER_PART) -> DataFrame:
    """Outer comments with their replies as an array.

    A comment with very many replies gets several rows, numbered by ``part``; ``n_replies`` is the
    number over all of them.
    """
    outer = comments.where(F.col("parent_cid").isNull()).select("aweme_id", "cid", "text")
    inner = comments.where(F.col("parent_cid").isNotNull()).select(
        "aweme_id", F.col("parent_cid").alias("cid"), F.col("cid").alias("reply_cid"), F.col("text").alias("reply_text")
    )
    layout = plan_layout(inner, ["aweme_id", "cid"], ["reply_cid"])
    numbered = scan(inner, layout, {"_n": ("number", None)})
    part = F.floor((F.col("_n") - 1) / part_rows).cast("int")
    nested = numbered.groupBy("aweme_id", "cid", part.alias("part")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", "reply_cid", "reply_text"))),
            lambda r: F.struct(r["reply_cid"].alias("cid"), r["reply_text"].alias("text")),
        ).alias("replies")
    )
    empty = F.array().cast("array<struct<cid:bigint,text:string>>")
    totals = inner.groupBy("aweme_id", "cid").agg(F.count(F.lit(1)).cast("int").alias("_total"))
    return outer.join(nested, ["aweme_id", "cid"], "left").join(totals, ["aweme_id", "cid"], "left").select(
        "aweme_id", "cid", "text", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(F.col("replies"), empty).alias("replies"), F.coalesce("_total", F.lit(0)).alias("n_replies"),
    )


def monitor_summary(channels: DataFrame, history: DataFrame) -> DataFrame:
    """Channel and history totals in one row; each side is aggregated before they meet."""
    a = channels.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"))
    b = history.agg(F.count(F.lit(1)).alias("downloaded"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def scan_summary(scans: DataFrame) -> DataFrame:
    """Per channel: works seen, new ones and failures of a scan."""
    return scans.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("is_new").alias("new"), F.count_if("failed").alias("errors")
    )


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Distinct values in order of first occurrence (``first_pos``)."""
    return rows.groupBy(*keys, value).agg(F.min(pos).alias("first_pos"))


def candidate_union(sources: list[DataFrame], keys: list[str], value: str = "url") -> DataFrame:
    """Several candidate lists as one, earlier lists first, each value once."""
    tagged = [
        df.select(*keys, value, F.struct(F.lit(i).alias("list"), F.col("pos").cast("bigint").alias("pos")).alias("at"))
        for i, df in enumerate(sources)
    ]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys, value).agg(F.min("at").alias("at")).select(*keys, value, "at.list", "at.pos")


def best_media_url(urls: DataFrame, keys: list[str], url: str = "url", pos: str = "pos") -> DataFrame:
    """Best stream link per key; the first of equal links wins."""
    valid = urls.where(is_media_url(url, F.lit("video/mp4")))
    rank = F.struct(media_url_score(url).alias("s"), (-F.col(pos)).alias("p"))
    return valid.groupBy(*keys).agg(F.max_by(url, rank).alias(url))
