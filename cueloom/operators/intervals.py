"""Interval sets over tracks. Times are whole milliseconds; seconds appear only in output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.operators.cues import KEY, PART_ROWS
from cueloom.operators.scan import Layout, at_most, islands, plan_layout, scan


def merge_intervals(
    cues: DataFrame, gap_ms: int = 1200, pad_start_ms: int = 150, pad_end_ms: int = 180,
    layout: Layout | None = None,
) -> DataFrame:
    """Padded cues merged where the next one starts within ``gap_ms`` of the latest end.

    Every padded interval lasts at least 100 ms. Returns ``(track_id, interval_no, s_ms,
    e_ms, cues)``, disjoint and in order.
    """
    start = F.greatest(F.lit(0), F.col("start_ms") - pad_start_ms)
    padded = at_most(cues.select(
        KEY, "cue_id", start.cast("bigint").alias("s"),
        F.greatest(start + 100, F.col("end_ms") + pad_end_ms).cast("bigint").alias("e"),
    ), cues)
    layout = layout.on(order=["s", "cue_id"]) if layout else plan_layout(padded, [KEY], ["s", "cue_id"])
    return _merge(padded, layout, gap_ms)


def union_intervals(base: DataFrame, extra: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Both sets as one; intervals that touch are joined."""
    both = base.select(KEY, "s_ms", "e_ms").unionByName(extra.select(KEY, "s_ms", "e_ms"))
    rows = at_most(both.select(KEY, F.col("s_ms").alias("s"), F.col("e_ms").alias("e")), base, extra)
    layout = layout or plan_layout(rows, [KEY], ["s", "e"])
    return _merge(rows, layout, 0)


def _merge(rows: DataFrame, layout: Layout, gap_ms: int) -> DataFrame:
    reach = scan(rows, layout, {"_reach": ("max_before", F.col("e"))})
    opens = F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + gap_ms)
    return at_most(
        islands(reach, layout, opens, "interval_no")
        .groupBy(KEY, "interval_no")
        .agg(F.min("s").alias("s_ms"), F.max("e").alias("e_ms"), F.count(F.lit(1)).alias("cues")), rows)


def in_seconds(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("s", F.col("s_ms") / F.lit(1000.0)).withColumn("e", F.col("e_ms") / F.lit(1000.0))


def enable_expr(intervals: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``between(t,s,e)`` clauses joined by plus signs, in numbered parts for long tracks."""
    clause = F.concat(
        F.lit("between(t,"), _seconds_text("s_ms"), F.lit(","), _seconds_text("e_ms"), F.lit(")")
    )
    part = F.floor((F.col("interval_no") - 1) / part_rows).cast("int")
    rows = intervals.select(KEY, part.alias("part"), F.struct("interval_no", clause.alias("c")).alias("x"))
    return rows.groupBy(KEY, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "+").alias("expr")
    )


def _seconds_text(column: str):
    ms = F.col(column)
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)


def interval_sets(intervals: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Intervals of a track as an ordered array, in numbered parts for long tracks."""
    part = F.floor((F.col("interval_no") - 1) / part_rows).cast("int")
    return intervals.groupBy(KEY, part.alias("part")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("s_ms", "e_ms"))), lambda x: F.struct(x["s_ms"], x["e_ms"])
        ).alias("intervals")
    )


def covered(points: DataFrame, intervals: DataFrame, t: str = "t_ms", tie: str = "frame_no") -> DataFrame:
    """Add ``covered``: some interval holds the point, ends included.

    Points and intervals go through one ordered pass: a point is covered exactly when the
    latest end among the intervals opened up to it reaches it. No pairs are formed, so long
    intervals and crowded tracks cost nothing extra.
    """
    opened = intervals.select(KEY, F.col("s_ms").alias("_at"), F.lit(0).alias("_side"),
                              F.lit(-1).cast("bigint").alias("_tie"), F.col("e_ms").alias("_end"))
    asked = points.select(KEY, F.col(t).cast("bigint").alias("_at"), F.lit(1).alias("_side"),
                          F.col(tie).cast("bigint").alias("_tie"), F.lit(None).cast("bigint").alias("_end"),
                          F.struct(*[c for c in points.columns if c != KEY]).alias("_row"))
    both = at_most(asked.unionByName(opened, allowMissingColumns=True), points, intervals)
    layout = plan_layout(both, [KEY], ["_at", "_side", "_tie"])
    passed = scan(both, layout, {"_reach": ("max_before", F.col("_end"))})
    return passed.where(F.col("_side") == 1).select(
        KEY, "_row.*", F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)).alias("covered"),
        F.col("_reach").isNotNull().alias("after_any"),
    )


def frames_in_intervals(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Frames inside an interval. A track without intervals counts every frame."""
    flagged = covered(frames, intervals).drop("after_any")
    having = intervals.select(KEY).distinct().withColumn("_has", F.lit(True))
    return (
        flagged.join(having, KEY, "left")
        .withColumn("has_sub", F.col("covered") | F.col("_has").isNull())
        .drop("_has", "covered")
    )


def frames_outside(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Frames no interval covers."""
    return covered(frames, intervals).where(~F.col("covered")).drop("covered", "after_any")


def nearby_references(frames: DataFrame, refs: DataFrame, window_ms: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """References within ``window_ms`` of each frame, as the slice ``[lo, hi)`` of the ordered list.

    ``lo`` counts references that end too early and ``hi`` those that start soon enough, so
    two running counts replace a band join. ``keys`` may add columns both sides must share,
    such as the pattern of a reference.
    """
    keys = keys or [KEY]
    rest = [c for c in frames.columns if c not in keys]

    def side(df, at, rank, ends, starts):
        return df.select(*keys, at.cast("bigint").alias("_at"), F.lit(rank).alias("_rank"), F.lit(-1).cast("bigint").alias("_tie"),
                         F.lit(ends).cast("bigint").alias("_ends"), F.lit(starts).cast("bigint").alias("_starts"))

    # A frame is asked twice: ends strictly before t-w, starts up to t+w.
    ends = side(refs, F.col("e_ms") + window_ms, 2, 1, 0)
    starts = side(refs, F.col("s_ms") - window_ms, 0, 0, 1)
    asked = frames.select(*keys, F.col("t_ms").cast("bigint").alias("_at"), F.lit(1).alias("_rank"),
                          F.col("frame_no").cast("bigint").alias("_tie"), F.lit(0).cast("bigint").alias("_ends"),
                          F.lit(0).cast("bigint").alias("_starts"), F.struct(*rest).alias("_row"))
    both = asked.unionByName(ends, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    layout = plan_layout(both, keys, ["_at", "_rank", "_tie"])
    counted = scan(both, layout, {"lo": ("sum_before", F.col("_ends")), "hi": ("sum_before", F.col("_starts"))})
    return counted.where(F.col("_rank") == 1).select(*keys, "_row.*", "lo", "hi")
