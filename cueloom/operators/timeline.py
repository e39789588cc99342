"""Narration on a time line without overlaps, and display times refined by frames."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import may_be_same, norm_for_match, same_normalised, same_text
from cueloom.functions.values import py_round
from cueloom.operators.cues import KEY
from cueloom.operators.scan import BLOCK, UNKNOWN, Layout, fold, plan_layout, scan, spread

BORROW_MS = 350
SPEED_TOLERANCE_MS = 15
OVERFLOW_TOLERANCE_MS = 25
# How a cue's times came out, by moved (m), start verified (s) and end verified (e).
REFINED = {"mse": "refined", "ms-": "refined_start_only", "m-e": "refined_end_only", "-se": "verified_unchanged"}


class CursorMap:
    """The end of a block of narration as a function of where the narration before it ended.

    A segment turns the cursor into its own end: a constant while the cursor is too early to matter, the cursor plus the
    segment's length while there is room or while there is none at full speed, and its limit between them. So a block is
    a piecewise linear function with slopes 0 and 1; pieces that come to the same end are one from there on.
    """

    LOWEST, MOST = -(1 << 62), 20_000

    def __init__(self, played, margin_ms: int, max_speed: float) -> None:
        self.played, self.margin, self.max_speed = played, margin_ms, max_speed
        # Ends that don't depend on the entering cursor any more: end -> class; classes may become one another's.
        self.ends: dict[int, int] = {}
        self.same: list[int] = []
        self.first: int | None = None  # the class of a cursor that isn't set
        self.slopes: list[tuple[int, int | None, int]] = [(self.LOWEST, None, 0)]  # from, to (None: no end), what is added
        self.flat: list[tuple[int, int, tuple]] = []

    def _end(self, begin: int, limit: int, length: int) -> int:
        return begin + self.played(length, limit - begin)

    def _class(self, ends: dict[int, int], end: int) -> int:
        if end not in ends:
            ends[end] = len(self.same)
            self.same.append(ends[end])
        return ends[end]

    def feed(self, row: tuple) -> None:
        lead, limit, length = row
        if length is None:
            return
        ends: dict[int, int] = {}
        for end, name in self.ends.items():
            after = self._end(max(lead, end + self.margin), limit, length)
            if after in ends:
                self.same[name] = ends[after]
            else:
                ends[after] = name
        if self.first is None:
            self.first = self._class(ends, self._end(lead, limit, length))
        # Rooms up to ``least`` are narrated at full speed, those from ``most`` on at natural speed.
        least, most = int(length / self.max_speed) + 2, length - SPEED_TOLERANCE_MS
        while least > 1 and length / least < self.max_speed:
            least -= 1
        slopes = []
        for low, high, added in self.slopes:
            shift = added + self.margin
            parts = [(lead - shift, "early")]
            if most <= 1:
                parts.append((None, "natural"))
            else:
                parts += [(limit - most - shift, "natural"), (limit - least - 1 - shift, "fitted"), (None, "fast")]
            for upto, kind in parts:
                stop = high if upto is None else upto if high is None else min(upto, high)
                if stop is not None and stop < low:
                    continue
                if kind == "early":
                    self.flat.append((low, stop, ("end", self._class(ends, self._end(lead, limit, length)))))
                elif kind == "fitted":
                    # Rounding of the speed decides between the limit and the millisecond after it.
                    self.flat.append((low, stop, ("fitted", shift, limit, length, self._class(ends, limit), self._class(ends, limit + 1))))
                else:
                    slopes.append((low, stop, shift + (length if kind == "natural" else self.played(length, 1))))
                if stop is None or stop == high:
                    break
                low = stop + 1
        if len(self.flat) + len(slopes) > self.MOST:
            # Cursors that come so late aren't followed any further.
            slopes = []
        self.ends, self.slopes = ends, slopes

    def closed(self) -> tuple:
        ends = {name: end for end, name in self.ends.items()}

        def of(name: int) -> int:
            while self.same[name] != name:
                name = self.same[name]
            return ends[name]

        flat = [(low, high, (*told[:-2], of(told[-2]), of(told[-1])) if told[0] == "fitted" else (told[0], of(told[1]))) for low, high, told in self.flat]
        return None if self.first is None else of(self.first), sorted(flat), self.slopes

    def leave(self, closed: tuple, cursor: int | None) -> int | None | str:
        first, flat, slopes = closed
        if cursor is None:
            return first
        at = bisect_right(flat, cursor, key=lambda piece: piece[0]) - 1
        if at >= 0 and cursor <= flat[at][1]:
            told = flat[at][2]
            if told[0] == "end":
                return told[1]
            _, shift, limit, length, fits, late = told
            return {limit: fits, limit + 1: late}.get(self._end(cursor + shift, limit, length), UNKNOWN)
        for low, high, added in slopes:
            if low <= cursor and (high is None or cursor <= high):
                return cursor + added
        return UNKNOWN


def schedule_timeline(
    segments: DataFrame, margin_ms: int = 60, max_speed: float = 1.65, mode: str = "smart_sync",
    borrow: bool = True, layout: Layout | None = None,
) -> DataFrame:
    """Place narration of ``raw_ms`` length per segment; nothing overlaps, nothing is cut.

    Adds actual start and end, speed, overlap, overflow and status. A segment without audio
    fails and leaves the cursor alone.
    """
    layout = layout or plan_layout(segments, [KEY], ["start_ms", "index"])
    strict = mode == "strict_sub"
    start, end, raw = F.col("start_ms"), F.col("end_ms"), F.when(F.col("raw_ms") > 0, F.col("raw_ms"))
    # All that doesn't depend on the narration before: how early a segment may start, and where its room ends.
    early = F.lit(0) if strict or not borrow else F.greatest(F.lit(0), F.least(F.lit(BORROW_MS), raw - (end - start)))
    ahead = scan(segments, layout, {"_next": ("next", start)})
    limit = F.coalesce(F.col("_next") - margin_ms, end)
    terms = ahead.withColumns({
        "_raw": raw, "_lead": F.greatest(F.lit(0), start - F.coalesce(early, F.lit(0))).cast("bigint"),
        "_limit": (F.least(limit, end) if strict else limit).cast("bigint"),
    })

    def played(length: int, room: int) -> int:
        room = max(1, room)
        return length if length - room <= SPEED_TOLERANCE_MS else math.ceil(length / min(length / room, max_speed))

    def step(cursor, row):
        lead, limit_ms, length = row
        if length is None:
            return cursor, (None, cursor)
        begin = lead if cursor is None else max(lead, cursor + margin_ms)
        return begin + played(length, limit_ms - begin), (begin, cursor)

    placed = fold(
        terms, layout, ["_lead", "_limit", "_raw"], step, [("_begin", "bigint"), ("_cursor", "bigint")], clustered=True,
        summary=lambda: CursorMap(played, margin_ms, max_speed))
    # Everything else follows from where a segment begins.
    begin, room = F.col("_begin"), F.greatest(F.lit(1), F.col("_limit") - F.col("_begin"))
    speed = F.when(begin.isNull() | (F.col("_raw") - room <= SPEED_TOLERANCE_MS), F.lit(1.0)).otherwise(
        F.least(F.col("_raw") / room.cast("double"), F.lit(float(max_speed))))
    shown = placed.withColumn("_speed", speed).withColumn(
        "_finish", begin + F.ceil(F.col("_raw").cast("double") / F.col("_speed")))
    spill = F.coalesce(F.greatest(F.lit(0), F.col("_finish") - F.col("_limit")), F.lit(0)).cast("bigint")
    status = F.when(begin.isNull(), "failed").when(spill > OVERFLOW_TOLERANCE_MS, "timing_overflow").when(
        F.col("_speed") > 1, "speed_adjusted").otherwise("natural_fit")
    return shown.select(
        *segments.columns, F.coalesce(begin, start).alias("actual_start_ms"), F.coalesce("_finish", start).cast("bigint").alias("actual_end_ms"),
        F.coalesce(F.greatest(F.lit(0), F.col("_cursor") - begin), F.lit(0)).cast("bigint").alias("overlap_ms"),
        spill.alias("overflow_ms"), status.alias("status"), py_round("_speed", 3).alias("speed_factor"),
    )


def placed_cues(placements: DataFrame) -> DataFrame:
    """Cues of the narration track: every segment that was placed."""
    return placements.where(F.col("status") != "failed").select(
        KEY, F.col("index").alias("cue_id"), F.col("actual_start_ms").alias("start_ms"),
        F.col("actual_end_ms").alias("end_ms"), "text",
    )


def tts_summary(placements: DataFrame, target: str | None = None) -> DataFrame:
    """Outcome of a narrated track; the failed and overflowing rows stay a table of their own.

    ``target`` names a column with the length in ms that the track has to fill at least.
    """
    failed, spilled = F.col("status") == "failed", F.col("status") == "timing_overflow"
    last = F.max(F.when(~failed, F.col("actual_end_ms")))
    return placements.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(failed).alias("failed"),
        F.count_if(spilled).alias("overflowing"),
        F.count_if(F.col("status") == "speed_adjusted").alias("speed_adjusted"),
        F.sum("overlap_ms").alias("overlap_ms"),
        F.greatest(F.coalesce(last, F.lit(0)), F.max("end_ms"), *([F.max(target)] if target else [])).alias("total_ms"),
        F.when(F.bool_or(failed | spilled), "partial").otherwise("done").alias("status"),
    )


def review_rows(placements: DataFrame) -> DataFrame:
    return placements.where(F.col("status").isin("failed", "timing_overflow")).select(KEY, "index", "status")


# ----------------------------------------------------------------- observed boundaries


def cue_windows(cues: DataFrame, tracks: DataFrame, max_shift_s: float = 2.0, layout: Layout | None = None) -> DataFrame:
    """Frames to look at for each cue: around it, up to halfway to its neighbours.

    ``tracks`` gives ``fps`` and ``frame_count``.
    """
    layout = layout or plan_layout(cues, [KEY], ["cue_id"])
    centre = F.col("start_ms") + F.col("end_ms")
    near = scan(cues, layout, {
        "_before": ("prev", centre), "_after": ("next", centre), "next_start": ("next", F.col("start_ms")),
    }).join(tracks.select(KEY, "fps", "frame_count"), KEY)
    top = F.col("frame_count") - 1

    def frame(ms: Column) -> Column:
        return F.rint(ms * F.col("fps") / F.lit(1000.0)).cast("bigint")

    def halfway(total: Column) -> Column:
        return F.rint(total * F.col("fps") / F.lit(2000.0)).cast("bigint")

    a = F.greatest(F.lit(0), F.least(top, frame(F.col("start_ms"))))
    b = F.greatest(F.col("a"), F.least(top, frame(F.col("end_ms"))))
    reach = F.greatest(F.lit(1), F.rint(F.col("fps") * F.lit(max_shift_s))).cast("bigint")
    lo = F.greatest(F.lit(0), F.col("a") - F.col("reach"), F.coalesce(halfway(F.col("_before")), F.lit(0)))
    hi = F.least(top, F.col("b") + F.col("reach"), F.coalesce(halfway(F.col("_after")), top))
    middle = F.least(F.col("hi"), F.greatest(F.col("lo"), F.rint((F.col("a") + F.col("b")) / F.lit(2.0)).cast("bigint")))
    return (
        near.withColumn("a", a).withColumn("b", b).withColumn("reach", reach)
        .withColumn("lo", lo).withColumn("hi", hi).withColumn("middle", middle).drop("_before", "_after")
    )


def text_observed(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a cue's text is read on a frame: ``keys`` plus ``seen``.

    ``pairs`` holds the rows read on the frame (``row_no, observed, confidence``) next to the
    cue's ``text``. Sure readings may differ a little, unsure ones must be equal, and if no
    row matches, the rows of the frame are tried as one.
    """

    # A text often stays on many frames: what is read on a frame is judged once for all frames of the cue that show it.
    *of, at = keys
    level = F.when(F.col("confidence") >= 0.2, 2).when(F.col("confidence") >= 0.03, 1).when(F.col("confidence").isNotNull(), 0)
    rows = pairs.where(F.col("observed").isNotNull()).select(*keys, "text", "row_no", "observed", level.alias("level"))
    rows = rows.repartition(*of) if of else rows
    # The few rows of one frame.
    read = F.array_sort(F.collect_list(F.struct("row_no", "observed", "level")))
    frames = rows.groupBy(*keys).agg(
        F.first("text").alias("text"), F.transform(read, lambda e: F.struct(e["observed"], e["level"])).alias("_read"))
    shows = [*of, "text", "_read"]
    groups = frames.groupBy(*shows).agg(F.collect_list(at).alias("_at"))
    joined = F.struct(F.array_join(F.transform("_read", lambda e: e["observed"]), "").alias("observed"), F.array_min(F.transform("_read", lambda e: e["level"])).alias("level"))
    tried = F.when(F.size("_read") > 1, F.array_append(F.array_distinct("_read"), joined)).otherwise(F.col("_read"))
    each = groups.withColumn("_one", F.explode(tried)).select(*shows, "_at", "_one.observed", "_one.level")
    cue, seen_text = norm_for_match("text"), norm_for_match("observed")
    exact = (F.col("level") >= 1) & (F.length(cue) >= 4) & (cue == seen_text)
    accepted = F.when(F.col("level") >= 2, F.coalesce(same_text("text", "observed"), F.lit(False))).otherwise(exact)
    judged = each.withColumn("_ok", accepted).groupBy(*shows).agg(F.bool_or("_ok").alias("seen"), F.first("_at").alias("_at"))
    return judged.select(*of, F.explode("_at").alias(at), "seen")


# Frames are told by block: one bit for each of 64.
_BLOCK_FRAMES = 64


def _bit(frame: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), frame.bitwiseAND(F.lit(_BLOCK_FRAMES - 1)).cast("int"))


def _shows(bits: Column, frame: Column) -> Column:
    return F.getbit(bits, frame.bitwiseAND(F.lit(_BLOCK_FRAMES - 1)).cast("int")) == 1


def _readings(observations: DataFrame) -> DataFrame:
    """What is read in every block of frames, normalised, with its level and the frames that show it.

    The rows of a frame that has several are there as one besides. A row that comes twice with the same number and text
    counts once.
    """
    level = F.when(F.col("confidence") >= 0.2, 2).when(F.col("confidence") >= 0.03, 1).when(F.col("confidence").isNotNull(), 0)
    frame = F.col("frame_idx").cast("bigint")
    rows = observations.where(F.col("text").isNotNull()).select(
        KEY, F.shiftright(frame, 6).alias("_block"), "row_no", F.col("text").alias("observed"), level.alias("level"), _bit(frame).alias("_bits"))
    # The frames of a row become one number before the shuffle, so that it is not sent once per frame.
    once = rows.groupBy(KEY, "_block", "row_no", "observed", "level").agg(F.bit_or("_bits").alias("_bits"))
    # The rows of 64 frames.
    blocks = once.groupBy(KEY, "_block").agg(F.array_sort(F.collect_list(F.struct("row_no", "observed", "level", "_bits"))).alias("_rows"))
    none = F.lit(0).cast("bigint")
    several = F.aggregate(
        "_rows", F.struct(none.alias("one"), none.alias("more")),
        lambda so, r: F.struct(so["one"].bitwiseOR(r["_bits"]).alias("one"), so["more"].bitwiseOR(so["one"].bitwiseAND(r["_bits"])).alias("more")),
        lambda so: so["more"])

    def as_one(frame: Column) -> Column:
        shown = F.filter("_rows", lambda r: _shows(r["_bits"], frame))
        return F.struct(
            F.array_join(F.transform(shown, lambda r: r["observed"]), "").alias("observed"),
            F.array_min(F.transform(shown, lambda r: r["level"])).alias("level"), _bit(frame).alias("_bits"))

    single = F.transform("_rows", lambda r: F.struct(r["observed"].alias("observed"), r["level"].alias("level"), r["_bits"].alias("_bits")))
    frames = F.filter(F.sequence(F.lit(0), F.lit(_BLOCK_FRAMES - 1)), lambda n: _shows(F.col("_several"), n))
    each = blocks.withColumn("_several", several).select(KEY, "_block", F.explode(F.concat(single, F.transform(frames, as_one))).alias("_one"))
    return each.where(F.col("_one.level") >= 1).select(
        KEY, "_block", norm_for_match("_one.observed").alias("_seen"), F.col("_one.level").alias("level"), F.col("_one._bits").alias("_bits"),
    ).where(F.length("_seen") >= 2).groupBy(KEY, "_block", "_seen", "level").agg(F.bit_or("_bits").alias("_bits"))


def _sightings(windows: DataFrame, observations: DataFrame) -> DataFrame:
    """Frames of its window on which a cue is read, as ``text_observed`` judges them: KEY, cue_id and ``_mark`` (block, bits).

    A text is judged once for all frames of a block that show it; neither cues nor readings are sent once per frame.
    """
    start = F.col("_block") * _BLOCK_FRAMES
    low = (F.greatest(F.col("lo"), start) - start).cast("int")
    high = (F.least(F.col("hi"), start + (_BLOCK_FRAMES - 1)) - start).cast("int")
    every = F.lit(-1).cast("bigint")
    inside = F.call_function("shiftleft", every, low).bitwiseAND(
        F.call_function("shiftrightunsigned", every, F.lit(_BLOCK_FRAMES - 1) - high))
    wanted = windows.where((F.col("hi") > F.col("lo")) & F.col("cue_id").isNotNull()).select(
        KEY, "cue_id", norm_for_match("text").alias("_cue"), "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 6), F.shiftright("hi", 6))).alias("_block"),
    ).where(F.length("_cue") >= 2).select(KEY, "_block", "cue_id", "_cue", inside.alias("_inside"))
    cue, seen, shown = F.col("_cue"), F.col("_seen"), F.col("_inside").bitwiseAND(F.col("_bits"))
    pairs = wanted.join(_readings(observations), [KEY, "_block"]).where((shown != 0) & may_be_same(cue, seen))
    exact = (F.length(cue) >= 4) & (cue == seen)
    judged = pairs.withColumn("_ok", F.when(F.col("level") >= 2, same_normalised(cue, seen)).otherwise(exact)).where("_ok")
    # Few marks of a cue share a block, and they are put together where they meet the cue.
    return judged.select(KEY, "cue_id", F.struct("_block", shown.alias("_bits")).alias("_mark"))


def _frames_seen(marks: Column | str) -> Column:
    """The frames of a window that the marks of its cue tell, in order."""

    def of_block(mark: Column) -> Column:
        start = mark["_block"] * _BLOCK_FRAMES
        frames = F.sequence(F.greatest(F.col("lo"), start), F.least(F.col("hi"), start + (_BLOCK_FRAMES - 1)))
        return F.filter(frames, lambda f: _shows(mark["_bits"], f))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(marks, of_block))))


def _anchor(seen: Column | str) -> Column:
    """Of start, middle and end the seen frame nearest to the middle."""
    spots = F.array_distinct(F.array("a", "middle", F.greatest(F.col("a"), F.col("b") - 1)))
    read = F.filter(spots, lambda f: F.array_contains(seen, f))
    return F.array_min(F.transform(read, lambda f: F.struct(F.abs(f - F.col("middle")).alias("off"), f.alias("frame"))))["frame"]


def anchors(windows: DataFrame, observations: DataFrame) -> DataFrame:
    """Frame nearest to the middle, among start, middle and end, on which the cue is read."""
    marks = _sightings(windows, observations).groupBy(KEY, "cue_id").agg(F.collect_list("_mark").alias("_marks"))
    near = windows.select(KEY, "cue_id", "a", "b", "middle", "lo", "hi").join(marks, [KEY, "cue_id"])
    found = near.withColumn("_on", _frames_seen("_marks")).select(KEY, "cue_id", _anchor("_on").alias("anchor"))
    return found.where(F.col("anchor").isNotNull())


def refine_boundaries(
    cues: DataFrame, tracks: DataFrame, observations: DataFrame, max_shift_s: float = 2.0,
    layout: Layout | None = None,
) -> DataFrame:
    """Cue times moved to the frames on which the text appears and disappears.

    Each side counts only with an absent frame next to it inside the window (or at the end of
    the video); text on every frame proves nothing; times never cross the neighbours.
    """
    layout = layout or plan_layout(cues, [KEY], ["cue_id"])
    windows = cue_windows(cues, tracks, max_shift_s, layout).select(
        KEY, "cue_id", "text", "start_ms", "end_ms", "next_start", "fps", "frame_count", "a", "b", "reach", "lo", "hi", "middle")
    # A cue and what was seen of it come together on the way to the walk over the cues of a track. What was seen is dealt
    # as the cues already are, so that these stay where they lie.
    part = layout.partition()
    marks = layout.tag(_sightings(windows, observations))
    cue_rows = layout.tag(windows.withColumn("_cue", F.lit(True)))
    rows = spread(cue_rows, part, layout.rows).unionByName(spread(marks, part, layout.rows), allowMissingColumns=True)
    own = Window.partitionBy(*part).orderBy(*layout.order).rangeBetween(Window.currentRow, Window.currentRow)
    marked = rows.withColumn("_marks", F.collect_list("_mark").over(own)).where("_cue").drop("_cue", "_mark", BLOCK)
    anchored = marked.withColumn("_on", _frames_seen("_marks")).withColumn("anchor", _anchor("_on"))
    # The frames without a gap around the anchor: what is seen of a gapless run lies as far behind its place in the list.
    place = F.col("anchor") - F.array_position("_on", F.col("anchor"))
    bounded = anchored.withColumn("_run", F.filter("_on", lambda f, i: f - i - 1 == place))
    top = F.col("frame_count") - 1
    first, last = F.array_min("_run"), F.array_max("_run")
    first = F.when(((first > F.col("lo")) | (F.col("lo") == 0)) & (first <= F.least(F.col("hi"), F.col("a") + F.col("reach"))), first)
    last = F.when(((last < F.col("hi")) | (F.col("hi") == top)) & (last >= F.greatest(F.col("lo"), F.col("b") - F.col("reach"))), last)
    bounded = bounded.withColumn("_first", first).withColumn("_last", last)
    overlay = (F.col("_first") == 0) & (F.col("_last") == top) & ((F.col("a") > 0) | (F.col("b") < top))
    overlay = F.coalesce(overlay, F.lit(False))
    ms = F.lit(1000.0) / F.col("fps")
    sided = (
        bounded.withColumn("_overlay", overlay)
        .withColumn("_first", F.when(~F.col("_overlay"), F.col("_first")))
        .withColumn("_last", F.when(~F.col("_overlay"), F.col("_last")))
        .withColumn("_start", F.rint(F.col("_first") * ms).cast("bigint"))
        .withColumn("_end", F.rint((F.col("_last") + 1) * ms).cast("bigint"))
    )

    # A side is taken up where it leaves something of the cue and stays clear of the neighbour. Whether the start may
    # move depends on where the cue before ends now, so both outcomes are columns, and one walk picks between them.
    source, until, begin, finish, after = (F.col(c) for c in ("start_ms", "end_ms", "_start", "_end", "next_start"))

    def ends(start: Column) -> Column:
        """Where the cue ends if it begins at ``start``, and whether its end is verified."""
        good = F.coalesce((finish > start) & (after.isNull() | (finish <= after)), F.lit(False))
        return F.struct(F.when(good, finish).otherwise(until).alias("at"), good.alias("seen"))

    both = sided.select(
        KEY, "cue_id", "text", "start_ms", "end_ms", "next_start", "anchor", "_first", "_last", "_start", "_end", F.when(begin < until, begin).alias("_movable"),
        ends(begin)["at"].alias("_moved_end"), ends(source)["at"].alias("_kept_end"))

    def walk(ended, row):
        movable, moved, kept = row
        taken = movable is not None and (ended or 0) <= movable
        return (moved if taken else kept), (taken,)

    walked = fold(both, layout, ["_movable", "_moved_end", "_kept_end"], walk, [("start_verified", "boolean")], clustered=True)
    chosen = F.when(F.col("start_verified"), ends(begin)).otherwise(ends(source))
    placed = walked.withColumns({"new_start_ms": F.when(F.col("start_verified"), begin).otherwise(source), "new_end_ms": chosen["at"], "end_verified": chosen["seen"]})
    same = (F.col("new_start_ms") == source) & (F.col("new_end_ms") == until)
    flags = F.concat(*[F.when(c, F.lit(yes)).otherwise(F.lit("-")) for c, yes in ((~same, "m"), (F.col("start_verified"), "s"), (F.col("end_verified"), "e"))])
    out = placed.withColumn("status", F.when(F.col("anchor").isNull(), "unchanged_no_anchor").otherwise(
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in REFINED.items() for v in pair]), flags), F.lit("unchanged_unverified_boundary"))))
    return out.select(
        KEY, "cue_id", "text", F.col("start_ms").alias("source_start_ms"), F.col("end_ms").alias("source_end_ms"),
        F.col("new_start_ms").alias("start_ms"), F.col("new_end_ms").alias("end_ms"),
        F.when(F.col("start_verified"), F.col("_first")).alias("start_frame"),
        F.when(F.col("end_verified"), F.col("_last") + 1).alias("end_frame_exclusive"),
        "start_verified", "end_verified", "status",
    )


def timing_report(refined: DataFrame) -> DataFrame:
    moved = F.col("status").startswith("refined")
    return refined.groupBy(KEY).agg(
        F.count_if(moved).alias("refined"), F.count_if(~moved).alias("unchanged"),
        F.count_if(F.col("start_verified") & F.col("end_verified")).alias("verified"),
    )
