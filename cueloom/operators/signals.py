"""Peaks, clusters, runs and cuts in per-track measurement series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import is_cover_text
from cueloom.functions.values import py_round
from cueloom.operators.cues import KEY
from cueloom.operators.scan import islands, plan_layout, quantiles, scan


def peaks(metrics: DataFrame, q: float = 0.70) -> DataFrame:
    """Local maxima of each signal that reach its own quantile.

    ``metrics`` is ``(track_id, signal, t_ms, sample_no, value)``; values count as floats.
    """
    keys = [KEY, "signal"]
    rows = metrics.withColumn("value", F.col("value").cast("float").cast("double"))
    layout = plan_layout(rows, keys, ["t_ms", "sample_no"])
    seen = scan(rows, layout, {
        "_prev": ("prev", F.col("value")), "_next": ("next", F.col("value")), "_n": ("count_all", None),
    })
    limits = quantiles(rows, keys, "value", {"threshold": q})
    inner = F.col("_prev").isNotNull() & F.col("_next").isNotNull() & (F.col("_n") >= 3)
    high = (F.col("value") >= F.col("threshold")) & (F.col("value") >= F.col("_prev")) & (F.col("value") > F.col("_next"))
    return seen.where(inner).join(limits, keys).where(high).select(*keys, "t_ms", "sample_no", "value", "threshold")


def nms_clusters(found: DataFrame, within_ms: int = 220) -> DataFrame:
    """Peaks of all signals of a track closer than ``within_ms`` become one weighted instant."""
    layout = plan_layout(found, [KEY], ["t_ms", "sample_no"])
    apart = scan(found, layout, {"_prev": ("prev", F.col("t_ms"))})
    opens = F.col("_prev").isNull() | (F.col("t_ms") - F.col("_prev") > within_ms)
    weight = F.greatest(F.col("value") / F.greatest(F.col("threshold"), F.lit(1e-9)), F.lit(1.0))
    return (
        islands(apart, layout, opens, "cluster_no")
        .withColumn("_w", weight)
        .groupBy(KEY, "cluster_no")
        .agg(
            py_round(F.sum(F.col("t_ms") / F.lit(1000.0) * F.col("_w")) / F.sum("_w"), 3).alias("t"),
            # At most one entry per signal name.
            F.array_sort(F.collect_set("signal")).alias("signals"), F.count(F.lit(1)).alias("peaks"),
        )
    )


def guard_intervals(candidates: DataFrame, tracks: DataFrame, gap_s: float = 1.2, min_s: float = 0.16) -> DataFrame:
    """Sampling intervals between candidate instants, long gaps filled with regular steps.

    ``candidates`` is ``(track_id, t)`` and ``tracks`` ``(track_id, duration_s)``, in seconds.
    """
    gap_ms = round(gap_s * 1000)
    total = F.rint(F.col("duration_s") * 1000).cast("bigint")
    inner = candidates.join(tracks.select(KEY, "duration_s"), KEY).where(
        (F.col("t") > 0) & (F.col("t") < F.col("duration_s"))
    ).select(KEY, F.rint(F.col("t") * 1000).cast("bigint").alias("p"))
    ends = tracks.select(KEY, F.explode(F.array(F.lit(0).cast("bigint"), total)).alias("p"))
    points = inner.unionByName(ends).distinct()
    layout = plan_layout(points, [KEY], ["p"])
    pairs = scan(points, layout, {"_right": ("next", F.col("p"))}).where(F.col("_right").isNotNull())
    steps = F.ceil((F.col("_right") - F.col("p")) / F.lit(gap_ms)) - 1
    split = pairs.select(KEY, "p", "_right", F.explode(F.sequence(F.lit(0).cast("bigint"), steps)).alias("k"))
    a, b = F.col("p") + F.col("k") * gap_ms, F.least(F.col("_right"), F.col("p") + (F.col("k") + 1) * gap_ms)
    sa, sb = F.col("start_ms") / F.lit(1000.0), F.col("end_ms") / F.lit(1000.0)
    return (
        split.select(KEY, a.alias("start_ms"), b.alias("end_ms"))
        .where(sb - sa >= min_s)
        .withColumn("sample_ms", F.rint((sa + sb) * 500).cast("bigint"))
    )


def confirm_runs(frames: DataFrame, frame_ms: int = 40) -> DataFrame:
    """Runs of consecutive frames with one pattern, kept when known or three frames long.

    ``frames`` is ``(track_id, frame_no, t_ms, pattern_id, known)``; a NULL pattern breaks a
    run. The run ends at the first frame that no longer matches.
    """
    layout = plan_layout(frames, [KEY], ["frame_no"])
    seen = scan(frames, layout, {"_prev": ("prev", F.col("pattern_id")), "_next_t": ("next", F.col("t_ms"))})
    opens = F.col("pattern_id").isNotNull() & (
        F.col("_prev").isNull() | (F.col("_prev") != F.col("pattern_id"))
    )
    runs = islands(seen, layout, opens, "run_no").where(F.col("pattern_id").isNotNull())
    return (
        runs.groupBy(KEY, "run_no")
        .agg(
            F.min("t_ms").alias("start_ms"),
            F.max(F.coalesce("_next_t", F.col("t_ms") + frame_ms)).alias("end_ms"),
            F.count(F.lit(1)).alias("frames"), F.bool_or("known").alias("_known"),
            F.bool_or(~F.col("known")).alias("has_unknown"),
        )
        .where(F.col("_known") | (F.col("frames") >= 3))
        .drop("_known")
    )


def guard_report(frames: DataFrame) -> DataFrame:
    """Frame counts of a guarded clean-up."""
    return frames.groupBy(KEY).agg(
        F.count_if(F.col("has_sub") | F.col("recovered")).alias("inpainted"),
        F.count_if("recovered").alias("recovered"),
        F.count_if(F.col("pattern_id").isNotNull() & ~F.col("has_sub")).alias("outside_track"),
    )


def template_coverage(samples: DataFrame) -> DataFrame:
    """Share of sampled cues that gave a usable reference."""
    return samples.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if("usable").alias("templates"),
        F.count_if(~F.col("usable")).alias("missing"),
        F.avg(F.col("usable").cast("double")).alias("coverage"),
    )


def intro_cut(
    diffs: DataFrame, speech: DataFrame | None = None, cover_text: DataFrame | None = None,
    limit_s: float = 4.0, require_cover: bool = False, han: str | None = None,
) -> DataFrame:
    """First sharp cut in the opening seconds after a still picture, per track.

    ``diffs`` is ``(track_id, frame_no, t, d, corr)``. Only the opening is read, so a track
    contributes a bounded number of frames and plain windows are enough.
    """
    opening = diffs.where(F.col("t") <= limit_s)
    track = Window.partitionBy(KEY)
    ordered = track.orderBy("frame_no")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    still = (F.col("d") < 1.4) & (F.col("corr") > 0.95)
    rows = opening.withColumn("_mean", F.avg("d").over(track)).withColumn("_sd", F.stddev_pop("d").over(track))
    rows = rows.withColumn("_still", still).withColumn("_no", F.row_number().over(ordered))
    rows = rows.withColumn("_moved", F.max(F.when(~F.col("_still"), F.col("_no"))).over(before))
    if speech is not None:
        rows = rows.join(speech.select(KEY, "first_speech"), KEY, "left")
    else:
        rows = rows.withColumn("first_speech", F.lit(None).cast("double"))
    run = F.col("_no") - 1 - F.coalesce("_moved", F.lit(0))
    sharp = (F.col("d") > F.greatest(F.lit(14.0), F.col("_mean") + 2 * F.col("_sd"))) | (F.col("corr") < 0.72)
    weaker = (F.col("d") > F.greatest(F.lit(12.0), F.col("_mean") + 1.5 * F.col("_sd"))) | (F.col("corr") < 0.75)
    spoken = F.col("first_speech")
    by_picture = ~F.col("_still") & sharp & ((run >= 6) | F.col("t").between(0.4, 3.5))
    by_speech = (spoken >= 1.0) & F.col("t").between(F.lit(0.4), spoken - 0.08) & weaker
    early = F.when((spoken.isNotNull()) & (spoken != 0), F.col("t") <= F.greatest(F.lit(0.4), spoken - 0.05)).otherwise(True)
    chosen = (by_picture | F.coalesce(by_speech, F.lit(False))) & F.col("t").between(0.35, limit_s) & early
    cuts = rows.groupBy(KEY).agg(F.min(F.when(chosen, F.col("t"))).alias("cut"))
    if require_cover:
        read = is_cover_text("text", han) if han else is_cover_text("text")
        shown = cover_text.groupBy(KEY).agg(F.bool_or(read).alias("_cover"))
        cuts = cuts.join(shown, KEY, "left").withColumn("cut", F.when(F.col("_cover"), F.col("cut"))).drop("_cover")
    return cuts.select(KEY, py_round(F.coalesce("cut", F.lit(0.0)), 2).alias("cut_s"))


def rms_windows(samples: DataFrame, size: int = 800) -> DataFrame:
    """Energy of full windows of ``size`` samples."""
    window = F.floor(F.col("sample_no") / size)
    return (
        samples.groupBy(KEY, window.alias("window_no"))
        .agg(F.sqrt(F.avg(F.col("v").cast("double") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == size).drop("_n")
    )


def speech_onset(energies: DataFrame, window_s: float = 0.05) -> DataFrame:
    """Start of speech from window energies, NULL for quiet tracks."""
    facts = energies.groupBy(KEY).agg(
        F.max("rms").alias("_max"),
        # At most eight values enter this quantile.
        F.percentile(F.when(F.col("window_no") < 8, F.col("rms")), F.lit(0.5)).alias("_base"),
    )
    limit = F.greatest(F.lit(600.0), F.col("_base") * 2.2)
    loud = (F.col("rms") > limit) & (F.col("window_no") >= 4) & (F.col("_max") >= 350)
    found = energies.join(facts, KEY).groupBy(KEY).agg(F.min(F.when(loud, F.col("window_no"))).alias("w"))
    return found.select(KEY, py_round(F.col("w") * F.lit(window_s), 2).alias("first_speech"))


def paired_benchmark(runs: DataFrame) -> DataFrame:
    """Median seconds of both variants of a case, and their ratio."""
    middle = quantiles(runs, ["case", "variant"], "seconds", {"m": 0.5})
    medians = middle.groupBy("case").agg(
        F.max(F.when(F.col("variant") == "baseline", F.col("m"))).alias("_a"),
        F.max(F.when(F.col("variant") == "candidate", F.col("m"))).alias("_b"),
    )
    return medians.select(
        "case", py_round("_a", 6).alias("baseline_seconds"), py_round("_b", 6).alias("candidate_seconds"),
        py_round(F.col("_a") / F.greatest(F.col("_b"), F.lit(1e-9)), 3).alias("speedup"),
    )


