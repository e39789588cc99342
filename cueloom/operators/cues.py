"""Cue tracks: validity, shifting, budgets, batches and subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.srt import ms_to_ts
from cueloom.functions.text import is_blank, strip, word_count
from cueloom.functions.values import (
    ass_time_from_stamp, fit_layout, py_round,
)
from cueloom.operators.scan import Layout, at_most, fold, plan_layout, scan

KEY = "track_id"
# Cues joined into one string; a longer track becomes several numbered parts.
PART_ROWS = 20_000

# Spoken words per second by target language.
WORDS_PER_SECOND = {"en": 2.6}
WORDS_PER_SECOND_OTHER = 3.4
# Longest subtitle in words by target language.
MAX_WORDS = {"en": 18, "vi": 22, "id": 20}
MAX_WORDS_OTHER = 18


def by_time(cues: DataFrame) -> Layout:
    return plan_layout(cues, [KEY], ["start_ms", "cue_id"])


def by_number(cues: DataFrame) -> Layout:
    return plan_layout(cues, [KEY], ["cue_id"])


def validate_cues(cues: DataFrame, duration_ms: str | None = None, layout: Layout | None = None) -> DataFrame:
    """Add ``errors`` to every cue. A cue is checked against the latest end before it."""
    layout = layout or by_number(cues)
    stamped = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    seen = scan(cues, layout, {"_latest": ("max_before", F.when(stamped, F.col("end_ms")))})
    late = F.col(duration_ms) + 1000 if duration_ms else F.lit(None).cast("bigint")
    checks = [
        F.when(~stamped, "bad_stamp"),
        F.when(F.col("end_ms") <= F.col("start_ms"), "end_not_after_start"),
        F.when(F.col("start_ms") < F.col("_latest"), "overlaps_earlier"),
        F.when(F.col("end_ms") > late, "past_duration"),
        F.when(is_blank("text"), "blank_text"),
    ]
    return seen.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull())).drop("_latest")


def track_validity(flagged: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """One row per track; with ``tracks`` given, those without any cue are invalid."""
    first = F.when(F.size("errors") > 0, F.struct("cue_id", F.get("errors", F.lit(0)).alias("error")))
    summary = flagged.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("cues"), F.sum(F.size("errors")).alias("n_errors"), F.min(first).alias("_first"),
    )
    if tracks is not None:
        summary = tracks.select(KEY).distinct().join(summary, KEY, "left")
    return summary.select(
        KEY, F.coalesce("cues", F.lit(0)).alias("cues"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.when(F.col("cues").isNull(), "no_entry").otherwise(F.col("_first.error")).alias("first_error"),
        (F.col("cues").isNotNull() & (F.col("n_errors") == 0)).alias("valid"),
    )


def shift_cues(cues: DataFrame, shifts: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Move tracks earlier by ``shift_ms``; cues ending within 80 ms of the cut go away."""
    by = F.coalesce("shift_ms", F.lit(0))
    active = by > 20
    moved = cues.join(shifts.select(KEY, "shift_ms"), KEY, "left").select(
        *[c for c in cues.columns if c not in ("start_ms", "end_ms")],
        F.when(active, F.greatest(F.lit(0), F.col("start_ms") - by)).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(active, F.col("end_ms") - by).otherwise(F.col("end_ms")).alias("end_ms"),
        active.alias("_active"),
    )
    kept = moved.where(~F.col("_active") | (F.col("end_ms") > 80)).drop("_active")
    numbered = scan(kept, layout or by_number(kept), {"_n": ("number", None)})
    return numbered.withColumn("cue_id", F.col("_n")).drop("_n")


def word_budget(cues: DataFrame, lang: str, layout: Layout | None = None) -> DataFrame:
    """Seconds until the next cue and the words that can be spoken in them."""
    ahead = scan(cues, layout or by_number(cues), {"_next": ("next", F.col("start_ms"))})
    free = F.coalesce("_next", F.col("end_ms") + 2000) - F.col("start_ms")
    seconds = F.greatest(F.lit(0.8), py_round(free / F.lit(1000.0), 1))
    rate = WORDS_PER_SECOND.get(lang, WORDS_PER_SECOND_OTHER)
    return (
        ahead.withColumn("available_s", seconds)
        .withColumn("word_budget", F.greatest(F.lit(2), (F.col("available_s") * F.lit(rate)).cast("int")))
        .drop("_next")
    )


def over_budget(text: Column | str, budget: Column | str) -> Column:
    limit = F.col(budget) if isinstance(budget, str) else budget
    return word_count(text) > F.greatest(limit + 2, (limit * F.lit(1.35)).cast("int"))


def accept_compression(old: Column | str, new: Column | str) -> Column:
    """The shorter wording only when it has strictly fewer words."""
    before = F.col(old) if isinstance(old, str) else old
    after = F.col(new) if isinstance(new, str) else new
    return F.when(after.isNotNull() & (word_count(after) < word_count(before)), after).otherwise(before)


def needs_segmentation(text: Column | str, lang: str) -> Column:
    n = word_count(text)
    clause = (F.col(text) if isinstance(text, str) else text).rlike(
        r"(?i),|;|:|\b(and|but|because|if|when|while|so)\b"
    )
    return F.when(n > MAX_WORDS.get(lang, MAX_WORDS_OTHER), True).when(n <= 14, False).otherwise(clause)


def batch_by_count(cues: DataFrame, size: int = 15, layout: Layout | None = None) -> DataFrame:
    numbered = scan(cues, layout or by_number(cues), {"_n": ("number", None)})
    return numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / size)).drop("_n")


def batch_by_size(
    cues: DataFrame, max_chars: int = 4500, max_rows: int = 50, layout: Layout | None = None
) -> DataFrame:
    """Greedy batches under a character and a row cap; ``batch_first`` is the first cue's id."""
    layout = layout or by_number(cues)
    sized = cues.withColumn("_chars", F.length("text") + 1)

    def step(state, row):
        cue, chars = row
        first, used, rows = state or (cue, 0, 0)
        if rows and (used + chars > max_chars or rows >= max_rows):
            first, used, rows = cue, 0, 0
        return (first, used + chars, rows + 1), (first,)

    return fold(sized, layout, ["cue_id", "_chars"], step, [("batch_first", "bigint")]).drop("_chars")


def sample_cues(cues: DataFrame, fps: float = 25.0, layout: Layout | None = None) -> DataFrame:
    """About a dozen cues spread over each track, with the frame in the middle of the cue."""
    counted = scan(cues, layout or by_number(cues), {"_n": ("number", None), "_all": ("count_all", None)})
    every = F.greatest(F.lit(1), F.floor(F.col("_all") / 12))
    picked = counted.where(((F.col("_n") - 1) % every == 0) & ((F.col("_n") - 1) / every < 15))
    middle = (F.col("start_ms") + F.col("end_ms")) / F.lit(2000.0)
    framed = picked.select(KEY, "cue_id", (middle * F.lit(fps)).cast("bigint").alias("frame"))
    return framed.groupBy(KEY, "frame").agg(F.min("cue_id").alias("cue_id"))


def even_samples(tracks: DataFrame, count: int = 15) -> DataFrame:
    """Instants spread over the middle of each track's duration."""
    start = F.least(F.lit(2.0), F.col("duration_s") * F.lit(0.1))
    return tracks.select(
        KEY, "duration_s", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample_no")
    ).select(
        KEY, "sample_no",
        (start + F.col("duration_s") * F.lit(0.8) * F.col("sample_no") / F.lit(count - 1)).alias("t"),
    )


def numbered_blocks(cues: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Non-blank cues as subtitle blocks with their running number ``n``."""
    start = F.greatest(F.lit(0), F.col("start_ms"))
    kept = at_most(cues.where(~is_blank("text")), cues)
    rows = scan(kept, layout or by_number(kept), {"n": ("number", None)})
    stamp = F.concat(ms_to_ts(start), F.lit(" --> "), ms_to_ts(F.greatest(start, F.col("end_ms"))))
    return at_most(rows.withColumn(
        "block", F.concat_ws("\n", F.col("n").cast("string"), stamp, strip("text"), F.lit(""))
    ), rows)


def _parts(rows: DataFrame, number: str, value: str, separator: str, out: str, part_rows: int) -> DataFrame:
    part = F.floor((F.col(number) - 1) / part_rows).cast("int")
    return at_most(rows.groupBy(KEY, part.alias("part")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(number, value))), lambda e: e[value]), separator
        ).alias(out)
    ), rows, every=part_rows)


def to_srt(cues: DataFrame, layout: Layout | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Subtitle documents ``(track_id, part, content)``.

    Ordinary tracks have the single part 0; the parts of a very long one, joined by line
    feeds, are the document. No task ever holds more than ``part_rows`` cues of a string.
    """
    return _parts(numbered_blocks(cues, layout), "n", "block", "\n", "content", part_rows)


def to_ass(
    cues: DataFrame, region: tuple[float, float, float, float] = (0.08, 0.86, 0.84, 0.09),
    width: int = 1080, height: int = 1920, layout: Layout | None = None, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Styled subtitle documents; the header opens part 0 of every track."""
    kept = at_most(cues.where(~is_blank("text")), cues)
    rows = scan(kept, layout or by_number(kept), {"n": ("number", None)})
    x, y, w, h = region
    left, top, wide, tall = int(width * x), int(height * y), int(width * w), int(height * h)
    size = max(20, min(56, int(height * 0.038)))
    least = int(width * 0.04)
    margins = (max(least, left), max(least, width - left - wide))
    centre = (round(left + wide / 2), round(top + tall / 2))
    styled = rows.withColumn(
        "_fit",
        fit_layout(
            F.translate(F.regexp_replace(strip("text"), "\r", ""), "\\{}", "＼｛｝"),
            F.lit(wide), F.lit(tall), F.lit(size), F.lit(max(12, int(height * 0.013))),
        ),
    )
    line = F.concat(
        F.lit("Dialogue: 0,"), ass_time_from_stamp(ms_to_ts("start_ms")), F.lit(","),
        ass_time_from_stamp(ms_to_ts("end_ms")), F.lit(",BurnSub,,0,0,0,,"),
        F.format_string("{\\an5\\pos(%d,%d)\\q2\\fs%d}", F.lit(centre[0]), F.lit(centre[1]), F.col("_fit.font_size")),
        F.array_join("_fit.lines", "\\N"),
    )
    head = ass_header(width, height, size, margins)
    parts = _parts(styled.withColumn("line", line), "n", "line", "\n", "content", part_rows)
    return parts.withColumn(
        "content", F.when(F.col("part") == 0, F.concat(F.lit(head + "\n"), F.col("content"))).otherwise(F.col("content"))
    )


def ass_header(width: int, height: int, size: int, margins: tuple[int, int]) -> str:
    """Fixed format: script header with the one style used for burnt subtitles."""
    style = (
        f"Style: BurnSub,Arial,{size},&H00FFFFFF,&H0000FFFF,&H00000000,&H80000000,-1,0,0,0,100,100,0.5,0,1,"
        f"3.0,1.2,8,{margins[0]},{margins[1]},0,1"
    )
    return "\n".join([
        "[Script Info]", "Title: Burned Subtitle", "ScriptType: v4.00+", f"PlayResX: {width}",
        f"PlayResY: {height}", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]",
        "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, "
        "Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, "
        "MarginL, MarginR, MarginV, Encoding",
        style, "", "[Events]",
        "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    ])


def layout_audit(cues: DataFrame, width: int, height: int, largest: int, smallest: int = 16) -> DataFrame:
    """How many cues of a track do not fit their region even at the smallest size."""
    fitted = cues.withColumn("_fit", fit_layout("text", F.lit(width), F.lit(height), F.lit(largest), F.lit(smallest)))
    return fitted.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("cues"), F.count_if("_fit.overflow").alias("overflow"),
        F.min("_fit.font_size").alias("smallest_size"),
    )


