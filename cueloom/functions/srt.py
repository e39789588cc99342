"""Subtitle documents: parsing inside one row, so no shuffle is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import _CUT, _col, clean_line, is_blank, squeeze, strip
from cueloom.operators.scan import one_row_each

_LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085\u2028\u2029]"
_BLOCK_BREAK = r"\r?\n\s*\r?\n+"
NO_SUBTITLES = "NO_SUBTITLES_FOUND"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once instead of at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ts_to_ms(c: Column | str) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm``; NULL unless minutes and seconds are below 60."""

    def read(text: Column) -> Column:
        hours, minutes, seconds, millis = (
            F.substring(text, at, n).try_cast("bigint") for at, n in ((1, 2), (4, 2), (7, 2), (10, 3))
        )
        total = hours * 3_600_000 + minutes * 60_000 + seconds * 1000 + millis
        return F.when(text.rlike(r"\A\d{2}:[0-5]\d:[0-5]\d[,.]\d{3}\z"), total)

    return _let(strip(c), read)


def ms_to_ts(c: Column | str) -> Column:
    ms = F.greatest(F.lit(0).cast("bigint"), _col(c).cast("bigint"))
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
    )


def seconds_to_ts(c: Column | str) -> Column:
    """Stamp of a number of seconds, rounded once to whole milliseconds."""
    return ms_to_ts(F.rint(_col(c) * F.lit(1000.0)))


def blocks(content: Column | str) -> Column:
    """Array of ``struct<idx, stamp, text>`` for the well-formed blocks of a document."""
    parts = F.split(strip(F.coalesce(_col(content), F.lit(""))), _BLOCK_BREAK)

    def read(lines: Column) -> Column:
        return F.struct(
            strip(F.get(lines, F.lit(0))).alias("idx"),
            strip(F.get(lines, F.lit(1))).alias("stamp"),
            strip(
                F.array_join(
                    F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda t: F.regexp_replace(t, r"\s+\z", "")), "\n"
                )
            ).alias("text"),
        )

    entries = F.transform(parts, lambda block: _let(F.split(block, _LINE_BREAK), read))
    return F.filter(
        entries,
        lambda e: e["idx"].rlike(r"\A\d+\z") & F.coalesce(e["stamp"].contains("-->"), F.lit(False)) & (e["text"] != ""),
    )


def _timed(entry: Column) -> Column:
    def read(sides: Column) -> Column:
        tail = F.regexp_extract(strip(F.get(sides, F.lit(1))), r"\A(\S+)", 1)
        return F.struct(
            ts_to_ms(F.get(sides, F.lit(0))).alias("start_ms"), ts_to_ms(tail).alias("end_ms"),
            entry["text"].alias("raw_text"),
        )

    return _let(F.split(entry["stamp"], "-->", 2), read)


def _kept_order(entries: Column) -> Column:
    return F.transform(entries, lambda e, i: F.struct((i + 1).alias("index"), _timed(e).alias("t")))


def _exploded(docs: DataFrame, entries: Column) -> DataFrame:
    """Keys, ``pos`` and ``e`` of every entry. An inner generator would compute the array again to see whether it is empty."""
    keys = [c for c in docs.columns if c != "content"]
    return docs.select(*keys, F.posexplode_outer(entries).alias("pos", "e")).where(F.col("pos").isNotNull())


def _over_parts(docs: DataFrame, rows: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """Numbers of rows of documents in several parts go on from part to part.

    ``numbers`` tells for every numbered column how many rows a part has: one small row per part, so that
    the rows themselves are not moved. Only documents in several parts are counted.
    """
    keys = [c for c in docs.columns if c != "content"]
    whole = [k for k in keys if k != "part"]
    if whole == keys or one_row_each(docs, whole):
        return rows
    several = docs.groupBy(*whole).agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").drop("_parts")
    order = Window.partitionBy(*whole).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = docs.join(several, whole, "left_semi").select(*keys, *[n.alias(f"_rows_{c}") for c, n in numbers.items()])
    starts = counted.select(*keys, *[F.sum(f"_rows_{c}").over(order).cast("int").alias(f"_before_{c}") for c in numbers])
    return rows.join(starts, keys, "left").select(*[
        (F.col(c) + F.coalesce(f"_before_{c}", F.lit(0))).alias(c) if c in numbers else F.col(c) for c in rows.columns
    ])


def parse_srt(docs: DataFrame) -> DataFrame:
    """One row per block: ``(…, pos, idx, stamp, text)`` with ``pos`` from 1.

    With a column ``part`` the parts of a document are read as one, in their order.
    """
    keys = [c for c in docs.columns if c != "content"]
    rows = _exploded(docs, blocks("content")).select(*keys, (F.col("pos") + 1).alias("pos"), "e.idx", "e.stamp", "e.text")
    return _over_parts(docs, rows, {"pos": F.size(blocks("content"))})


def repair_documents(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``raw`` of documents in parts repaired as ``content``, blocks numbered over all parts."""
    keys = [c for c in docs.columns if c != raw]
    whole = [k for k in keys if k != "part"]
    order = Window.partitionBy(*whole).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = docs.select(*keys, F.regexp_count(F.coalesce(F.col(raw), F.lit("")), F.lit(r"(?m)^\s*\d+\s*\r?\n[^\r\n]*-->")).alias("_rows"))
    starts = told.select(*keys, F.coalesce(F.sum("_rows").over(order), F.lit(0)).cast("int").alias("_before"))
    return docs.join(starts, keys).select(*keys, repair_srt(raw, F.col("_before")).alias("content"))


def cue_timings(docs: DataFrame) -> DataFrame:
    """Display cues numbered from 1; blocks without a valid positive span are dropped."""
    keys = [c for c in docs.columns if c != "content"]
    timed = F.transform(
        F.transform(blocks("content"), _timed),
        lambda t: F.struct(
            t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms"),
            strip(F.regexp_replace(t["raw_text"], _LINE_BREAK, " ")).alias("text"),
        ),
    )
    cues = F.filter(timed, lambda t: (t["end_ms"] > t["start_ms"]) & (t["text"] != ""))
    rows = _exploded(docs, cues).select(*keys, (F.col("pos") + 1).alias("cue_id"), "e.start_ms", "e.end_ms", "e.text")
    return _over_parts(docs, rows, {"cue_id": F.size(cues)})


def tts_segments(docs: DataFrame) -> DataFrame:
    """Narration segments by start time; ``index`` is the block's place before drops.

    Parts of a document follow each other in time, so their numbers do as well.
    """
    keys = [c for c in docs.columns if c != "content"]
    seen = F.filter(_kept_order(blocks("content")), lambda e: e["t"]["end_ms"] > e["t"]["start_ms"])
    made = F.transform(
        seen,
        lambda e: F.struct(
            e["t"]["start_ms"].alias("start_ms"), e["index"].alias("index"), e["t"]["end_ms"].alias("end_ms"),
            clean_line(e["t"]["raw_text"]).alias("clean"), e["t"]["raw_text"].alias("raw_text"),
        ),
    )
    ordered = F.array_sort(F.filter(made, lambda e: e["clean"]["text"] != ""))
    rows = _exploded(docs, ordered).select(
        *keys,
        (F.col("pos") + 1).alias("seg_no"),
        "e.index", "e.start_ms", "e.end_ms",
        (F.col("e.end_ms") - F.col("e.start_ms")).alias("duration_ms"),
        F.col("e.clean.text").alias("text"), "e.raw_text", F.col("e.clean.speaker").alias("speaker"),
    )
    return _over_parts(docs, rows, {"seg_no": F.size(ordered), "index": F.size(blocks("content"))})


def _repair_stamp(c: Column) -> Column:
    """``MM:SS`` gets hours, dots become commas, hours and minutes two digits, millis three."""

    def hours(parts: Column) -> Column:
        text = F.array_join(parts, ":")
        first, second = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
        return (
            F.when(F.size(parts) == 2, F.concat(F.lit("00:"), text))
            .when(
                (F.size(parts) == 3) & first.isNotNull() & second.isNotNull(),
                F.format_string("%02d:%02d:%s", first, second, F.get(parts, F.lit(2))),
            )
            .otherwise(text)
        )

    def millis(full: Column) -> Column:
        digits = F.rpad(F.left(F.regexp_extract(full, r"\A[^,]*,(\d*)", 1), F.lit(3)), 3, "0")
        return (
            F.when(full.contains(","), F.concat(F.substring_index(full, ",", 1), F.lit(","), digits))
            .when(full.contains(":"), F.concat(full, F.lit(",000")))
            .otherwise(full)
        )

    return _let(F.split(F.translate(strip(c), ".", ","), ":"), lambda parts: _let(hours(parts), millis))


def repair_srt(c: Column | str, before: Column | int = 0) -> Column:
    """Subtitle text of a model answer: no fences, whole stamps, blocks renumbered after ``before`` others."""
    told_before = F.lit(before) if isinstance(before, int) else before
    raw = F.coalesce(_col(c), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)\A\s*```(?:srt)?\s*", ""), r"\s*```\s*\z", "")
    lines = F.transform(F.split(strip(bare), _LINE_BREAK), strip)
    stamped = F.transform(
        lines,
        lambda ln: F.when(
            ln.contains("-->") & (F.size(F.split(ln, "-->")) == 2),
            F.concat(
                _repair_stamp(F.substring_index(ln, "-->", 1)), F.lit(" --> "),
                _repair_stamp(F.regexp_extract(F.substring_index(ln, "-->", -1), r"\A\s*(\S+)", 1)),
            ),
        ).otherwise(ln),
    )
    following = F.slice(stamped, 2, F.size(stamped))
    # A number line is one with a time line after it. Cutting there makes the new number the
    # position of the piece.
    marked = F.array_join(
        F.zip_with(
            stamped, following,
            lambda ln, nxt: F.when(ln.rlike(r"\A\d+\z") & F.coalesce(nxt.contains("-->"), F.lit(False)), F.lit(_CUT)).otherwise(ln),
        ),
        "\n",
    )
    pieces = F.transform(
        F.split(marked, _CUT), lambda p, i: F.when(i == 0, p).otherwise(F.concat((i + told_before).cast("string"), p))
    )
    built = strip(F.array_join(pieces, ""))
    return F.when((raw == "") | raw.contains(NO_SUBTITLES), F.lit("")).otherwise(built)


def count_segments(c: Column | str) -> Column:
    return F.regexp_count(
        F.coalesce(_col(c), F.lit("")), F.lit(r"(?m)^\d+\s*$\n\d{2}:\d{2}:\d{2}[,.]\d{3}\s+-->")
    )


# ------------------------------------------------------------------- model answers


def _unfenced(c: Column | str) -> Column:
    raw = strip(F.coalesce(_col(c), F.lit("")))
    return F.regexp_replace(F.regexp_replace(raw, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")


def _outer(text: Column, opening: str, closing: str) -> Column:
    """The text from the first opening to the last closing bracket, NULL without both."""
    found = F.regexp_extract(text, rf"(?s)[{opening}].*[{closing}]", 0)
    return F.nullif(found, F.lit(""))


def parse_numbered(answers: DataFrame, batch_size: Column | int, raw: str = "raw") -> DataFrame:
    """Numbered lines of an answer: ``(…, offset, text, speaker)``; a later duplicate wins."""
    keys = [c for c in answers.columns if c != raw]
    size = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    pattern = r"\A\s*(\d+)[.)]\s*(?:\[([A-Za-z0-9_]+)\]|\(([A-Za-z0-9_]+)\))?\s*(.*?)\s*\z"
    inside = r"\A\s*[\[(]([A-Za-z0-9_]+)[\])]\s*(.*)\z"

    def read(line: Column) -> Column:
        tag = F.upper(F.concat(F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 3)))
        value = strip(F.regexp_extract(line, pattern, 4))
        late = (tag == "") & value.rlike(inside)
        return F.struct(
            (F.regexp_extract(line, pattern, 1).try_cast("bigint") - 1).alias("offset"),
            F.when(late, strip(F.regexp_extract(value, inside, 2))).otherwise(value).alias("text"),
            F.when(late, F.upper(F.regexp_extract(value, inside, 1))).otherwise(tag).alias("tag"),
        )

    lines = F.transform(F.split(F.coalesce(F.col(raw), F.lit("")), _LINE_BREAK), read)
    valid = F.filter(lines, lambda e: (e["offset"] >= 0) & (e["offset"] < size) & (e["text"] != ""))

    # The lines are a column of their own: inside a lambda an expression would be computed again
    # for every element. A speaker given on an earlier duplicate stays when the later names none.
    def latest(offset: Column) -> Column:
        same = F.filter("_valid", lambda e: e["offset"] == offset)
        spoken = F.filter(same, lambda e: e["tag"].isin("M1", "F1", "M2", "F2", "N"))
        return F.struct(
            offset.alias("offset"),
            F.try_element_at(same, F.lit(-1))["text"].alias("text"),
            F.try_element_at(spoken, F.lit(-1))["tag"].alias("speaker"),
        )

    numbered = F.array_sort(F.array_distinct(F.transform("_valid", lambda e: e["offset"])))
    return answers.withColumn("_valid", valid).select(*keys, F.explode(F.transform(numbered, latest)).alias("e")).select(
        *keys, "e.offset", "e.text", "e.speaker"
    )


_GROUP = "array<struct<source_ids:array<bigint>,translation:string,speaker:string>>"


def parse_fusion(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Groups of a fusion answer with ``group_no`` from 1; unusable answers give one error row."""
    keys = [c for c in answers.columns if c != raw]
    body = _outer(_unfenced(raw), r"{\[", r"}\]")
    wrapped = F.from_json(body, f"struct<groups:{_GROUP}>")["groups"]
    listed = F.when(body.startswith("["), F.from_json(body, _GROUP)).otherwise(wrapped)
    error = F.when(body.isNull(), "no_json").when(F.coalesce(F.size(listed), F.lit(0)) < 1, "no_groups")
    rows = answers.select(*keys, listed.alias("groups"), error.alias("error"))
    return rows.select(*keys, "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("groups"))).alias("pos", "g")).select(
        *keys, (F.col("pos") + 1).alias("group_no"), "g.source_ids", "g.translation", "g.speaker", "error"
    )


def parse_segmentation(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Replacement segments per item number; bad items are skipped, the last duplicate wins."""
    keys = [c for c in answers.columns if c != raw]
    body = _outer(_unfenced(raw), "{", "}")
    items = F.from_json(body, "struct<items:array<string>>")["items"]

    def read(item: Column) -> Column:
        listed = F.from_json(F.get_json_object(item, "$.segments"), "array<string>")
        texts = F.transform(listed, lambda s: squeeze(F.when(strip(s).startswith("{"), F.get_json_object(s, "$.text")).otherwise(s)))
        return F.struct(
            F.get_json_object(item, "$.index").try_cast("int").alias("index"),
            F.filter(texts, lambda t: t != "").alias("segments"),
        )

    parsed = F.filter(F.transform(items, read), lambda e: (e["index"] > 0) & (F.size(e["segments"]) > 0))
    numbers = F.array_sort(F.array_distinct(F.transform("_parsed", lambda e: e["index"])))
    last = F.transform(numbers, lambda n: F.struct(
        n.alias("index"),
        F.try_element_at(F.filter("_parsed", lambda e: e["index"] == n), F.lit(-1))["segments"].alias("segments"),
    ))
    error = F.when(body.isNull(), "no_json").when(items.isNull(), "no_items")
    rows = answers.select(*keys, error.alias("error"), parsed.alias("_parsed")).select(*keys, "error", last.alias("made"))
    return rows.select(*keys, "error", F.explode_outer("made").alias("e")).select(*keys, "e.index", "e.segments", "error")


KINDS = ["dialogue", "title", "watermark", "ui", "none"]


def parse_contact_sheet(answers: DataFrame, raw: str = "raw", expected: str = "expected") -> DataFrame:
    """Read frames of a contact sheet. Each answer must hold every expected id exactly once."""
    keys = [c for c in answers.columns if c not in (raw, expected)]
    body = _outer(_unfenced(raw), "{", "}")
    frames = F.from_json(body, "struct<frames:array<struct<frame_id:string,text:string,kind:string>>>")["frames"]
    known = F.filter(frames, lambda f: F.array_contains(F.col(expected), f["frame_id"]))
    ids = F.transform("_known", lambda f: f["frame_id"])
    missing = F.array_except(F.col(expected), ids)
    error = (
        F.when(~F.col("_json"), "no_json").when(F.col("_known").isNull(), "no_frames")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_frame")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.slice(missing, 1, 8), ", ")))
    )
    read = answers.select(*keys, expected, body.isNotNull().alias("_json"), known.alias("_known"))
    rows = read.select(*keys, error.alias("error"), "_known").select(
        *keys, "error", F.when(F.col("error").isNull(), F.col("_known")).alias("made")
    )
    kind = F.lower(F.coalesce(F.col("f.kind"), F.lit("none")))
    return rows.select(*keys, "error", F.explode_outer("made").alias("f")).select(
        *keys, "f.frame_id", F.coalesce(squeeze("f.text"), F.lit("")).alias("text"),
        F.when(kind.isin(KINDS), kind).otherwise("none").alias("kind"), "error",
    )


def gate_finish_reason(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Mark answers that were cut off or hold no text."""
    reason = F.col("finish_reason")
    error = F.when(reason.isNotNull() & (reason != "stop"), "cut_off").when(is_blank(raw), "empty")
    return answers.withColumn("error", error)


@F.udtf(returnType=T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("idx", T.StringType()),
    T.StructField("stamp", T.StringType()), T.StructField("text", T.StringType()),
]))
class SrtBlocks:
    """SQL table function over one document: ``SELECT * FROM parse_srt(content)``."""

    def eval(self, content: str):
        import re

        position = 0
        for block in re.split(_BLOCK_BREAK, (content or "").strip()):
            lines = block.splitlines()
            if len(lines) > 2 and re.fullmatch(r"\d+", lines[0].strip()) and "-->" in lines[1]:
                text = "\n".join(line.rstrip() for line in lines[2:]).strip()
                if text:
                    position += 1
                    yield position, lines[0].strip(), lines[1].strip(), text


def register_udtf(spark) -> None:
    spark.udtf.register("parse_srt", SrtBlocks)


SRT_DOC = T.StructType([T.StructField("track_id", T.StringType()), T.StructField("content", T.StringType())])
