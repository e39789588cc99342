"""Batch manifests: options, names, counts, status and the strict gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import safe_name, strip
from cueloom.functions.values import parse_bool, parse_extensions, valid_region
from cueloom.operators.scan import at_most, plan_layout, scan, spread

# Item states a manifest counts; any other counts as failed.
ITEM_STATES = ["queued", "processing", "done", "failed", "partial", "cancelled"]
RETRY_STATES = ["failed", "partial", "cancelled", "error"]

# Batch options with their allowed values, the default first.
CHOICES = {
    "target_lang": ["en"],
    "output_mode": ["srt_and_video", "srt_only"],
    "subtitle_engine": ["hybrid", "gemini", "whisper"],
    "translation_method": ["ai", "google"],
    "translation_mode": ["movie", "literal", "driving", "fun"],
    "old_subtitle_removal": ["inpaint_burn", "opaque_band", "blur"],
    "inpaint_engine": ["opencv", "lama"],
}
# Batch switches with their defaults.
SWITCHES = {
    "recursive": True, "skip_existing": True, "strict_translation": True,
    "allow_partial_render": False, "use_sidecar_srt": True, "keep_original_audio": True,
}
# Preferences with their defaults.
PREFERENCES = {
    "model": "large-v3-turbo", "tts": "false", "burn": "false", "preset": "default", "hardsub": "false",
    "tts_engine": "edge", "translation_mode": "movie", "vmode": "blur", "trim_intro": "auto",
    "bgm_mode": "auto", "bgm_volume": "0.8", "clean_hardsub": "true", "clean_logo": "false",
    "clean_title": "false", "translate_title": "false", "brand_name": "",
}


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def validate_batch_options(options: DataFrame) -> DataFrame:
    """Normalised option columns and an ``errors`` array; absent columns take their defaults."""
    columns, errors = {}, []
    for name, default in SWITCHES.items():
        word = F.lower(strip(_given(options, name).cast("string")))
        columns[name] = F.when(word.isNull(), default).otherwise(word.isin("1", "true", "yes", "on"))
    for name, allowed in CHOICES.items():
        value = F.lower(strip(F.coalesce(F.nullif(_given(options, name), F.lit("")), F.lit(allowed[0]))))
        columns[name] = value
        errors.append(F.when(~value.isin(allowed), f"bad_{name}"))
    suffixes = parse_extensions(_given(options, "extensions"))
    columns["extensions"] = suffixes["value"]
    errors.append(suffixes["error"])
    concurrency = F.coalesce(_given(options, "max_concurrency").cast("string"), F.lit("1")).try_cast("int")
    errors.append(F.when(concurrency.isNull() | (concurrency != 1), "bad_max_concurrency"))
    ratios = [_given(options, n).try_cast("double") for n in ("x_ratio", "y_ratio", "w_ratio", "h_ratio")]
    has_region = F.coalesce(*ratios).isNotNull()
    mode = F.lower(strip(F.coalesce(_given(options, "region_mode"), F.when(has_region, "manual").otherwise("auto"))))
    columns["region_mode"] = mode
    errors.append(F.when(~mode.isin("auto", "manual"), "bad_region_mode"))
    errors.append(F.when((mode == "manual") & ~has_region, "region_required"))
    x, y, w, h = [F.coalesce(r, F.lit(0.0)) for r in ratios]
    inside = (
        x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
        & (x + w <= 1.000001) & (y + h <= 1.000001)
    )
    errors.append(F.when(has_region & ~inside, "bad_region"))
    for name, ratio in zip(("x_ratio", "y_ratio", "w_ratio", "h_ratio"), (x, y, w, h)):
        # Coordinates left over from manual mode must not override detection.
        columns[name] = F.when((mode == "manual") & has_region, ratio)
    kept = [c for c in options.columns if c not in columns]
    return options.select(
        *kept, *[c.alias(n) for n, c in columns.items()],
        F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"),
    )


# Choices of a run with their allowed values, the default first.
RUN_CHOICES = {
    "source_type": ["upload", "url", "srt_only"],
    "target_lang": ["vi", "en", "id"],
    "sub_engine": ["hybrid", "gemini", "whisper"],
    "tts_engine": ["edge", "gemini", "omnivoice"],
    "clean_engine": ["opencv", "lama"],
    "render_mode": ["inpaint_burn", "pure_burn", "blur"],
    "audio_mode": ["keep_original", "tts_only", "tts_ducking", "tts_ai_bgm", "tts_clean_bgm"],
    "align_mode": ["smart_sync", "strict_sub"],
}
RUN_STEPS = {"download": True, "extract_sub": True, "clean_video": False, "tts": True, "burn_sub": True}
VIDEO_STEPS = ["extract_sub", "clean_video", "burn_sub"]
# Numbers of a run as (default, lowest, highest, whole numbers only).
RUN_NUMBERS = {"margin": (60, 0, 500, True), "max_speed": (1.45, 1, 3, False), "bgm_volume": (0.8, 0, 1.5, False)}


def validate_run_options(options: DataFrame) -> DataFrame:
    """Settings of a single run. A supplied step list is complete: omitted steps are off."""
    columns, errors = {}, []
    steps = F.col("steps") if "steps" in options.columns else F.lit(None).cast("map<string,string>")
    for name, default in RUN_STEPS.items():
        columns[f"step_{name}"] = F.when(steps.isNull(), default).otherwise(parse_bool(F.try_element_at(steps, F.lit(name))))
    any_step = F.lit(False)
    for name in RUN_STEPS:
        any_step = any_step | columns[f"step_{name}"]
    errors.append(F.when(~any_step, "no_step"))
    for name, allowed in RUN_CHOICES.items():
        value = F.coalesce(_given(options, name), F.lit(allowed[0]))
        columns[name] = value
        errors.append(F.when(~value.isin(allowed), f"bad_{name}"))
    for name, (default, low, high, whole) in RUN_NUMBERS.items():
        raw = _given(options, name).cast("string")
        number = F.coalesce(raw, F.lit(str(default))).try_cast("double")
        bad = number.isNull() | F.isnan(number) | ~number.between(low, high)
        if whole:
            bad = bad | (number != F.floor(number))
        columns[name] = number
        errors.append(F.when(bad, f"bad_{name}"))
    touches_video = F.lit(False)
    for name in VIDEO_STEPS:
        touches_video = touches_video | columns[f"step_{name}"]
    errors.append(F.when((columns["source_type"] == "srt_only") & touches_video, "video_needed"))
    ratios = [_given(options, n).try_cast("double") for n in ("x_ratio", "y_ratio", "w_ratio", "h_ratio")]
    errors.append(F.when(F.coalesce(*ratios).isNotNull() & ~valid_region(*ratios), "bad_region"))
    kept = [c for c in options.columns if c not in columns]
    return options.select(
        *kept, *[c.alias(n) for n, c in columns.items()],
        F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"),
    )


def fill_defaults(prefs: DataFrame, column: str = "prefs", defaults: dict[str, str] | None = None) -> DataFrame:
    """Preference map with a default for every key that is not set."""
    given = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
    pairs = [F.lit(v) for item in (defaults or PREFERENCES).items() for v in item]
    absent = F.map_filter(F.create_map(*pairs), lambda k, _v: ~F.map_contains_key(given, k))
    return prefs.withColumn(column, F.map_concat(given, absent))


# -------------------------------------------------------------------------- manifests


def number_items(files: DataFrame) -> DataFrame:
    """Item ids in listing order and output stems that no other item of the folder has.

    ``files`` is ``(batch_id, relative_path, sha256)``. Listing order is case-folded.
    """
    folded = files.withColumn("_path", F.lower("relative_path"))
    layout = plan_layout(folded, ["batch_id"], ["_path", "relative_path"])
    numbered = scan(folded, layout, {"item_no": ("number", None)})
    return dedupe_stems(
        numbered.drop("_path").withColumn(
            "item_id", F.concat(F.col("batch_id").cast("string"), F.lit("_"), F.format_string("%04d", "item_no"))
        )
    )


def dedupe_stems(items: DataFrame) -> DataFrame:
    """Stems shared by several items of a folder get suffix and hash appended."""
    name = F.regexp_extract("relative_path", r"([^/]*)\z", 1)
    stem = safe_name(F.regexp_replace(name, r"\A(.+)\.[^.]+\z", "$1"))
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)\z", 1))
    folder = F.lower(F.regexp_replace("relative_path", r"/?[^/]*\z", ""))
    keyed = items.withColumn("output_stem", stem).withColumn("_folder", folder).withColumn("_stem", F.lower(stem))
    keys = ["batch_id", "_folder", "_stem"]
    shared = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    marked = keyed.join(shared, keys, "left")
    unique = F.concat_ws("_", F.col("output_stem"), suffix, F.left("sha256", F.lit(8)))
    return marked.withColumn(
        "output_stem", F.when(F.col("_n").isNotNull(), unique).otherwise(F.col("output_stem"))
    ).drop("_folder", "_stem", "_n")


def attach_sidecar(media: DataFrame, files: DataFrame) -> DataFrame:
    """Subtitle file lying next to a video; the language-marked one first."""
    base = F.regexp_replace("path", r"\.[^./]+\z", "")
    wanted = media.withColumn("_marked", F.concat(base, F.lit(".zh.srt"))).withColumn("_plain", F.concat(base, F.lit(".srt")))
    there = files.select("path").distinct()
    first = there.withColumnRenamed("path", "_marked").withColumn("_a", F.col("_marked"))
    second = there.withColumnRenamed("path", "_plain").withColumn("_b", F.col("_plain"))
    return (
        wanted.join(first, "_marked", "left").join(second, "_plain", "left")
        .withColumn("sidecar", F.coalesce("_a", "_b")).drop("_marked", "_plain", "_a", "_b")
    )


def changed_sources(manifest: DataFrame, media: DataFrame) -> DataFrame:
    """Items whose file is gone or has another size or time than when it was listed."""
    now = media.select(F.col("path").alias("source_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    seen = manifest.join(now, "source_path", "left")
    reason = (
        F.when(F.col("_size").isNull(), "missing")
        .when(F.col("source_size") != F.col("_size"), "size")
        .when(F.abs(F.col("source_mtime") - F.col("_mtime")) > 1e-6, "mtime")
    )
    return seen.withColumn("change", reason).where(F.col("change").isNotNull()).drop("_size", "_mtime")


def path_allowed(media: DataFrame, roots: list[str], output_root: str) -> DataFrame:
    """Files at or below an allowed folder (none given: all), never inside the output folder."""

    def below(root: str) -> Column:
        root = root.rstrip("/")
        return (F.col("path") == root) | F.col("path").startswith(root + "/")

    allowed = F.lit(not roots)
    for root in roots:
        allowed = allowed | below(root)
    return media.where(allowed & ~below(output_root))


def status_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    known = F.when(F.coalesce("status", F.lit("queued")).isin(ITEM_STATES), F.coalesce("status", F.lit("queued"))).otherwise("failed")
    return items.withColumn("_s", known).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("_s") == s).alias(s) for s in ITEM_STATES]
    )


def batch_status(items: DataFrame, batches: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Status and progress of each batch.

    ``batches`` may add empty batches and a sticky ``cancelled`` flag. ``order`` names the
    item order: the first item in work adds its own progress.
    """
    counts = status_counts(items, ["batch_id"])
    place = F.when(F.col("status") == "processing", F.struct(*(order or ["item_id"])))
    current = items.groupBy("batch_id").agg(F.min_by("progress", place).alias("_current"))
    rows = counts.join(current, "batch_id")
    if batches is not None:
        rows = batches.select("batch_id", "cancelled_batch").join(rows, "batch_id", "left")
    else:
        rows = rows.withColumn("cancelled_batch", F.lit(False))
    total, done, failed = (F.coalesce(c, F.lit(0)) for c in ("total", "done", "failed"))
    status = (
        F.when(F.col("cancelled_batch"), "cancelled")
        .when((failed > 0) & (done > 0), "partial").when(failed > 0, "failed").otherwise("done")
    )
    share = (done + F.coalesce("_current", F.lit(0)) / F.lit(100.0)) / total * 100
    return rows.select(
        "batch_id", total.alias("total"), done.alias("done"), failed.alias("failed"), status.alias("status"),
        F.when(total == 0, 100).otherwise(share.cast("int")).alias("progress"),
    )


def resume_items(items: DataFrame) -> DataFrame:
    """Stopped items go back to the queue without their error."""
    return _requeue(items, F.col("status").isin(RETRY_STATES), F.lit(None).cast("string"))


def retry_item(items: DataFrame, item_id: Column) -> DataFrame:
    return _requeue(items, F.col("item_id") == item_id, F.lit(None).cast("string"))


def recover_stale(items: DataFrame, dead_batches: DataFrame) -> DataFrame:
    """Items in work whose batch lost its worker are queued again."""
    marked = items.join(dead_batches.select("batch_id").distinct().withColumn("_dead", F.lit(True)), "batch_id", "left")
    stale = F.coalesce("_dead", F.lit(False)) & (F.col("status") == "processing")
    return _requeue(marked, stale, F.lit("Worker interrupted")).drop("_dead")


def _requeue(items: DataFrame, when: Column, error: Column) -> DataFrame:
    cols = {
        "progress": F.when(when, 0).otherwise(F.col("progress")),
        "error": F.when(when, error).otherwise(F.col("error")),
        "status": F.when(when, "queued").otherwise(F.col("status")),
    }
    return items.select(*[cols.get(c, F.col(c)).alias(c) for c in items.columns])


def pending_items(items: DataFrame, skip_done: bool = True) -> DataFrame:
    """Items the next run works on, with the attempt counted."""
    rows = items.where(F.col("status") != "done") if skip_done else items
    return rows.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).withColumn(
        "status", F.lit("processing")
    )


def strict_gate(items: DataFrame) -> DataFrame:
    """Fail items whose translation needs attention when strict mode asks for it.

    Columns: ``strict, allow_partial, method, fallbacks, unchanged, needs_review, warning``.
    """
    warned = F.coalesce(F.length("warning"), F.lit(0)) > 0
    provider = (F.col("method") == "ai") & ((F.col("fallbacks") > 0) | warned)
    bad = provider | (F.col("unchanged") > 0) | F.col("needs_review")
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("fallbacks") > 0, F.concat(F.lit("fallback "), F.col("fallbacks").cast("string"))),
        F.when(F.col("unchanged") > 0, F.concat(F.lit("unchanged "), F.col("unchanged").cast("string"))),
        F.when(F.col("needs_review"), "needs review"),
        F.when(warned, F.left("warning", F.lit(160))),
    )
    failed = F.col("strict") & ~F.col("allow_partial") & bad
    return items.withColumn("passed", ~failed).withColumn("reasons", F.when(failed, reasons))


# ---------------------------------------------------------------------- chunk uploads


def expected_chunks(total_size: Column, chunk_size: Column) -> Column:
    return F.ceil(total_size / chunk_size).cast("bigint")


def chunk_ok(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Check every received chunk against its session."""
    rows = chunks.join(sessions, "session_id", "left")
    index = F.col("chunk_index")
    due = F.least(F.col("chunk_size"), F.col("total_size") - index * F.col("chunk_size"))
    error = (
        F.when(F.col("total_chunks").isNull(), "no_session")
        .when((index < 0) | (index >= F.col("total_chunks")), "out_of_range")
        .when(F.col("finished"), "finished")
        .when(F.col("bytes") > due, "too_large").when(F.col("bytes") < due, "too_small")
    )
    return rows.withColumn("error", error)


def missing_chunks(chunks: DataFrame, sessions: DataFrame, listed: int = 10) -> DataFrame:
    """Completeness per session: how many chunks are missing and the first few of them.

    Received chunks are counted, and only gaps between neighbours are expanded, so a session
    of a million chunks never becomes one array.
    """
    # A session has no more edges than chunks and its two ends; chunks can be counted without the join.
    rows = plan_layout(chunks, ["session_id"], ["chunk_index"]).rows
    sessions, dealt = spread(sessions, ["session_id"], rows), spread(chunks, ["session_id"], rows)
    got = dealt.join(sessions.select("session_id", "total_chunks"), "session_id").where(
        (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("total_chunks"))
    ).groupBy("session_id", "chunk_index").agg(F.max("bytes").alias("bytes"))
    received = got.groupBy("session_id").agg(F.count(F.lit(1)).alias("received"), F.sum("bytes").alias("_bytes"))
    edges = got.select("session_id", F.col("chunk_index").cast("bigint").alias("i")).unionByName(
        sessions.select("session_id", F.explode(F.array(F.lit(-1).cast("bigint"), F.col("total_chunks").cast("bigint"))).alias("i"))
    )
    layout = plan_layout(at_most(edges, chunks, times=3), ["session_id"], ["i"])
    layout.rows = rows  # dealt as the chunks are
    gaps = scan(edges, layout, {"_next": ("next", F.col("i"))}).where(F.col("_next") - F.col("i") > 1)
    upto = F.least(F.col("_next") - 1, F.col("i") + listed)
    firsts = gaps.select("session_id", F.explode(F.sequence(F.col("i") + 1, upto)).alias("i"))
    # The smallest indexes come from the first gaps; ranks are cut before the shuffle.
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("i"))
    some = firsts.withColumn("_r", rank).where(F.col("_r") <= listed).groupBy("session_id").agg(
        F.array_sort(F.collect_list("i")).alias("first_missing")
    )
    declared = expected_chunks(F.col("total_size"), F.col("chunk_size")) == F.col("total_chunks")
    rows = sessions.join(received, "session_id", "left").join(some, "session_id", "left")
    count = F.col("total_chunks") - F.coalesce("received", F.lit(0))
    return rows.select(
        "session_id", count.cast("bigint").alias("n_missing"),
        F.coalesce("first_missing", F.array().cast("array<bigint>")).alias("first_missing"),
        declared.alias("declared_ok"),
        ((count == 0) & (F.coalesce("_bytes", F.lit(0)) == F.col("total_size")) & declared).alias("complete"),
    )


def media_limits(probe: DataFrame, max_bytes: int = 0, max_seconds: int = 0) -> DataFrame:
    """Check probed media; a limit of 0 is no limit, an unreadable probe is invalid."""
    error = F.when(F.col("duration_s").isNull() | F.col("size").isNull(), "unreadable")
    if max_bytes:
        error = error.when(F.col("size") > max_bytes, "too_large")
    if max_seconds:
        error = error.when(F.col("duration_s") > max_seconds, "too_long")
    return probe.withColumn("error", error)
