"""Web archive records: writing with payload deduplication, and reading by verified record chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.llm.common import checked, known, staged

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
LEAST_DEDUPED = 100


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_DEDUPED, records_per_file: int = 20_000) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``, each part file an archive.

    Of the rows with equal payloads of ``least`` bytes or more that with the smallest page_id is a response, the others
    are revisits without payload that refer to it. A null payload is an empty one; a null page_id never is the smallest
    unless all are null, and then all are responses; rows repeated whole with the smallest id are all responses. Line
    breaks in an url become spaces. Other columns are not read. An empty table gives archives without records.
    """
    own = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), known("html").alias("payload"))
    own = own.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n", F.octet_length("payload"))
    groups = staged(
        own.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").select("digest", "first"), "warc-groups")
    own = own.join(checked(groups, 100), "digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    payload = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn("page_id")),
        _line("WARC-Refers-To", F.when(again, urn("first"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(BLANK), payload,
    )
    # Each row is a record and the writer's separator is the end of a record.
    own.select(record.alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", records_per_file).text(path)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of a block, where the chain from it leaves the block."""
    pdf = pdf.sort_values("start", kind="stable")
    starts, nexts, out = pdf["start"].tolist(), pdf["succ"].tolist(), {}
    for start, after in zip(reversed(starts), reversed(nexts), strict=True):
        if after == after and after is not None:
            out[start] = out.get(int(after), int(after))
    pdf["leaves"] = pd.array([out.get(s) for s in starts], dtype="Int64")
    return pdf


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which pieces of a block lie on the chains that enter it."""
    pdf = pdf.sort_values("start", kind="stable")
    on = set()
    for start, after, entry in zip(pdf["start"].tolist(), pdf["succ"].tolist(), pdf["entry"].tolist(), strict=True):
        if after == after and after is not None and (entry or start in on):
            on |= {start, int(after)}
    has = pdf["succ"].notna()
    pdf["on"] = [bool(h) and s in on for s, h in zip(pdf["start"].tolist(), has.tolist(), strict=True)]
    return pdf


def verified_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces between two magics with ``on``: a record starts here and is reached from the start of its file.

    Each task gives candidates (offset, offset of the successor by the stated length). Within a block of a file the
    chains are followed at once; over blocks the pointers jump: every round doubles their reach, until no more
    records are reached.
    """
    spark = pieces.sparkSession
    head = F.substring_index("value", BLANK, 1)
    stated = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t\r]*$", 1)
    parsed = pieces.select(
        "file", "block", "piece", F.octet_length("value").cast("long").alias("n"),
        F.when(F.contains("value", F.lit(BLANK)) & (stated != ""), F.octet_length(head) + F.lit(2 * len(BLANK)) + stated.cast("long")).alias("whole"),
    )
    gap = len(MAGIC)
    parsed = staged(parsed, "warc-pieces")
    order = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parsed.groupBy("file", "block").agg(F.sum(F.col("n") + gap).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum(F.col("n") + gap).over(order), F.lit(0)) - gap
    placed = parsed.join(blocks, ["file", "block"]).withColumn("start", start)
    placed = placed.withColumn("succ", F.when(F.col("start") >= 0, F.col("start") + gap + F.col("whole")))
    shape = "file string, block long, piece long, n long, start long, succ long"
    placed = staged(
        placed.select("file", "block", "piece", "n", "start", "succ").groupBy("file", "block").applyInPandas(_exits, f"{shape}, leaves long"), "warc-placed")

    ways = placed.filter("leaves IS NOT NULL").select("file", F.col("start").alias("at"), F.col("leaves").alias("to"))
    entered = ways.select("file", F.col("to").alias("at")).distinct()
    jump = staged(ways.join(entered, ["file", "at"], "left_semi").union(ways.filter("at = 0")).distinct(), "warc-jump")
    reach = staged(jump.filter("at = 0").select("file", "at"), "warc-reach")
    known_rows, new_rows = -1, reach.count()
    while new_rows > known_rows:
        known_rows = new_rows
        further = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reach = staged(reach.union(further).distinct(), "warc-reach")
        new_rows = reach.count()
        if new_rows > known_rows:
            second = jump.select("file", F.col("at").alias("to"), F.col("to").alias("later"))
            jump = staged(jump.join(second, ["file", "to"], "left").select("file", "at", F.coalesce("later", "to").alias("to")), "warc-jump")
    marked = placed.join(reach.select("file", F.col("at").alias("start"), F.lit(True).alias("entry")), ["file", "start"], "left")
    marked = marked.select("file", "block", "piece", "n", "start", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    return staged(marked.groupBy("file", "block").applyInPandas(_reached, f"{shape}, entry boolean, `on` boolean"), "warc-verified")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, large archives read by many tasks.

    Returns page_id, record_type, url, refers_to, payload (binary), payload_bytes and payload_digest; for revisits the
    last two are those stated. Magic within payloads starts no record; a chain ends at the first broken record of its
    file, and what follows is not returned.
    """
    # Where the archives are split depends on the machines there are: pieces are numbered in one reading and kept.
    pieces = staged(spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"), "value"), "warc-values")
    verified = verified_pieces(pieces)
    along = Window.partitionBy("file").orderBy("start")
    owner = F.last(F.when(F.col("on"), F.struct("start", "succ")), ignorenulls=True).over(along)
    # Most records are one piece. The others, and what belongs to no record, are told apart by a narrow table.
    odd = staged(
        verified.withColumn("owner", owner).filter(~F.col("on") | (F.col("succ") != F.col("start") + len(MAGIC) + F.col("n")))
        .select("file", "block", "piece", F.when(F.col("start") < F.col("owner.succ"), F.col("owner.start")).alias("owner"), F.lit(True).alias("odd")),
        "warc-odd")
    told = pieces.join(checked(odd, 300), ["file", "block", "piece"], "left")
    single = told.filter("odd IS NULL").select("value")
    joined = (
        told.filter("owner IS NOT NULL").groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("block", "piece", "value"))).alias("parts"))
        .select(F.array_join(F.col("parts.value"), MAGIC).alias("value"))
    )
    record = single.union(joined).withColumn("head", F.substring_index("value", BLANK, 1))

    def field(name: str, form: str) -> Column:
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*{form}", 1)
        return F.when(found != "", found)

    record = record.select(
        field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"), field("WARC-Type", r"(\w+)").alias("record_type"),
        field("WARC-Target-URI", r"([^\r\n]*)").alias("url"), field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", r"sha256:([0-9a-f]+)").alias("stated"), field("X-Payload-Length", r"(\d+)").cast("long").alias("length"),
        F.expr(f"substring(CAST(value AS BINARY), octet_length(head) + {len(BLANK) + 1}, "
               r"CAST(regexp_extract(head, '(?im)^Content-Length:[ \\t]*(\\d{1,18})', 1) AS INT))").alias("payload"),
    )
    whole = F.col("record_type") == "response"
    return record.select(
        "page_id", "record_type", "url", "refers_to", "payload",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("stated")).alias("payload_digest"),
    )
