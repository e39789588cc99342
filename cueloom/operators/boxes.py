"""Recognised text boxes: which ones are subtitles or titles, and where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import strip
from cueloom.functions.values import py_round
from cueloom.operators.cues import KEY
from cueloom.operators.scan import Layout, at_most, fold, plan_layout, quantiles

# Where subtitles are assumed when too little was read.
FALLBACK_REGION = (0.08, 0.86, 0.84, 0.09)


def corners(observations: DataFrame) -> DataFrame:
    """Edges of ``box array<struct<x,y>>`` as ``x0, y0, x1, y1``."""
    xs, ys = F.transform("box", lambda p: p["x"]), F.transform("box", lambda p: p["y"])
    return observations.select(
        *[c for c in observations.columns if c != "box"],
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
    )


def subtitle_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    tall, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return boxes.where((tall >= 14) & (wide >= width * 0.06) & (F.col("y0") >= height * 0.60))


def title_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    tall, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    top, bottom = int(height * 0.04), int(height * 0.35)
    return boxes.where(
        (F.length(strip("text")) >= 3) & (wide >= width * 0.15) & (tall >= 18)
        & (F.col("y0") >= top) & (F.col("y1") <= bottom)
    )


def subtitle_region(boxes: DataFrame, tracks: DataFrame, width: int, height: int) -> DataFrame:
    """Band that holds a track's subtitles, from robust bounds of its boxes."""
    found = subtitle_boxes(boxes, width, height)
    counts = found.groupBy(KEY).agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("frame").alias("frames_with_text"))
    edges = found.select(KEY, F.explode(F.array(*[
        F.struct(F.lit(c).alias("edge"), F.col(c).cast("double").alias("v")) for c in ("x0", "y0", "x1", "y1")
    ])).alias("e")).select(KEY, "e.edge", "e.v")
    cuts = quantiles(edges, [KEY, "edge"], "v", {"middle": 0.5, "low": 0.15, "high": 0.85})
    bounds = {"_top": ("y0", "middle"), "_bottom": ("y1", "middle"), "_right": ("x1", "high"), "_left": ("x0", "low")}
    facts = cuts.groupBy(KEY).agg(*[
        F.max(F.when(F.col("edge") == edge, F.col(point))).alias(name) for name, (edge, point) in bounds.items()
    ]).join(counts, KEY)
    top, bottom = F.col("_top").cast("int"), F.col("_bottom").cast("int")
    pad = F.greatest(F.lit(8), ((bottom - top) * F.lit(0.22)).cast("int"))
    y0, y1 = F.greatest(F.lit(0), top - pad), F.least(F.lit(height), bottom + pad)
    tall = F.greatest(F.lit(int(height * 0.05)), F.least(y1 - y0, F.lit(int(height * 0.12))))
    span = (F.col("_right") - F.col("_left") + F.lit(width * 0.08)).cast("int")
    wide = F.greatest(F.lit(int(width * 0.60)), F.least(span, F.lit(int(width * 0.88))))
    wide = wide - wide % 2
    left = F.greatest(F.lit(0), ((F.lit(width) - wide) / 2).cast("int"))
    found_region = facts.where(F.col("frames_with_text") >= 2).select(
        KEY, py_round(left / F.lit(width), 3).alias("x_ratio"), py_round(y0 / F.lit(height), 3).alias("y_ratio"),
        py_round(wide / F.lit(width), 3).alias("w_ratio"), py_round(tall / F.lit(height), 3).alias("h_ratio"),
        "samples", "frames_with_text",
    )
    every = tracks.select(KEY).distinct().join(found_region, KEY, "left")
    x, y, w, h = FALLBACK_REGION
    return every.select(
        KEY, F.coalesce("x_ratio", F.lit(x)).alias("x_ratio"), F.coalesce("y_ratio", F.lit(y)).alias("y_ratio"),
        F.coalesce("w_ratio", F.lit(w)).alias("w_ratio"), F.coalesce("h_ratio", F.lit(h)).alias("h_ratio"),
        F.when(F.col("samples").isNull(), "fixed_fallback").otherwise("detected").alias("method"),
    )


def primary_title(boxes: DataFrame, width: int, height: int, order: list[str]) -> DataFrame:
    """Largest title box of a track; the first one in reading order wins a tie."""
    found = title_boxes(boxes, width, height)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rank = F.struct((-area).alias("area"), *order)
    best = found.groupBy(KEY).agg(F.min_by(F.struct("text", "x0", "y0", "x1", "y1"), rank).alias("b"))
    pad_x = int(width * 0.04)
    pad_y = ((F.col("b.y1") - F.col("b.y0")) * F.lit(0.25)).cast("int")
    x0, x1 = F.greatest(F.lit(0), F.col("b.x0") - pad_x), F.least(F.lit(width), F.col("b.x1") + pad_x)
    y0, y1 = F.greatest(F.lit(0), F.col("b.y0") - pad_y), F.least(F.lit(height), F.col("b.y1") + pad_y)
    return best.select(
        KEY, strip("b.text").alias("text"),
        py_round(x0 / F.lit(width), 3).alias("x_ratio"), py_round(y0 / F.lit(height), 3).alias("y_ratio"),
        py_round((x1 - x0) / F.lit(width), 3).alias("w_ratio"), py_round((y1 - y0) / F.lit(height), 3).alias("h_ratio"),
    )


def group_text_rows(boxes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Boxes of a frame in text rows by vertical centre; rows below three boxes are dropped.

    ``boxes`` is ``(track_id, frame, box_no, center, height)``.
    """
    keys = [KEY, "frame"]
    medians = quantiles(boxes, keys, "height", {"_median": 0.5})
    usual = at_most(boxes.join(medians, keys).where(
        F.col("height").between(F.col("_median") * 0.6, F.col("_median") * 1.5)
    ), boxes)
    layout = layout or plan_layout(usual, keys, ["center", "box_no"])

    def step(state, row):
        number, center, median = row
        if state is None or abs(center - state[1] / state[2]) > median * 0.35:
            return (number, center, 1), (number,)
        first, total, count = state
        return (first, total + center, count + 1), (first,)

    led = fold(usual, layout, ["box_no", "center", "_median"], step, [("row_first", "bigint")])
    return led.groupBy(*keys, "row_first").agg(
        F.count(F.lit(1)).alias("boxes"), F.min("center").alias("top"), F.max("center").alias("bottom")
    ).where(F.col("boxes") >= 3)


CELL = 32


def style_match(lines: DataFrame, styles: DataFrame, width: int) -> DataFrame:
    """Per observation: does every line look like some learned style of its track?

    ``lines`` is ``(track_id, obs_id, h, cy, cx)`` and ``styles`` ``(track_id, h, cy, cx)``.
    Both sides are reduced to distinct shapes and meet in grid cells, and the semi join stops
    at the first match, so no pairs are produced.
    """
    reach_x = max(20.0, width * 0.22)
    reach_y = F.greatest(F.lit(4.0), F.col("h") * 0.5)

    def cell(value: Column) -> Column:
        return F.floor(value / CELL).cast("bigint")

    shapes = styles.select(KEY, "h", "cy", "cx").distinct()
    spread = shapes.select(
        KEY, F.col("h").alias("sh"), F.col("cy").alias("sy"), F.col("cx").alias("sx"),
        F.explode(F.sequence(cell(F.col("cy") - reach_y), cell(F.col("cy") + reach_y))).alias("_y"),
    ).select("*", F.explode(F.sequence(cell(F.col("sx") - reach_x), cell(F.col("sx") + reach_x))).alias("_x"))
    seen = lines.select(KEY, "h", "cy", "cx").distinct().withColumn("_y", cell(F.col("cy"))).withColumn("_x", cell(F.col("cx")))
    a, b = seen.alias("a"), spread.alias("b")
    near = (
        (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col("a._y") == F.col("b._y")) & (F.col("a._x") == F.col("b._x"))
        & F.col("a.h").between(F.col("b.sh") * 0.65, F.col("b.sh") * 1.45)
        & (F.abs(F.col("a.cy") - F.col("b.sy")) <= F.greatest(F.lit(4.0), F.col("b.sh") * 0.5))
        & (F.abs(F.col("a.cx") - F.col("b.sx")) <= reach_x)
    )
    matched = a.join(b, near, "left_semi").select(KEY, "h", "cy", "cx", F.lit(True).alias("_hit"))
    return lines.join(matched, [KEY, "h", "cy", "cx"], "left").groupBy(KEY, "obs_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.bool_and(F.coalesce("_hit", F.lit(False))).alias("matches"),
    )
