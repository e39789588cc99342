"""Translated lines: fallbacks, speakers, quality flags, voices and publish packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions.text import HAN, cps, has_han, last_word_fragment, strip
from cueloom.functions.values import identity_key, package_key, py_round
from cueloom.operators.cues import KEY
from cueloom.operators.groups import HAN_FREE_LANGS
from cueloom.operators.scan import Layout, plan_layout, scan

# ------------------------------------------------------------------------ translation


def translate_fallback(cues: DataFrame, ai: DataFrame, second: DataFrame, driving: bool = False) -> DataFrame:
    """Model line, else the second translator's, else the original; positions stay visible."""
    a = ai.select(KEY, "cue_id", F.col("text").alias("_ai"), F.col("speaker").alias("_speaker"))
    b = second.select(KEY, "cue_id", F.col("text").alias("_second"))
    rows = cues.join(a, [KEY, "cue_id"], "left").join(b, [KEY, "cue_id"], "left")
    speaker = F.lit("M1") if driving else F.coalesce("_speaker", F.lit("M1"))
    return rows.withColumn("translation", F.coalesce("_ai", F.nullif("_second", F.lit("")), "text")).withColumn(
        "speaker", speaker
    ).withColumn("fallback", F.col("_ai").isNull()).drop("_ai", "_speaker", "_second")


def fallback_positions(lines: DataFrame) -> DataFrame:
    return lines.where("fallback").select(KEY, "cue_id")


def speaker_counts(lines: DataFrame, driving: bool = False) -> DataFrame:
    speaker = F.lit("M1") if driving else F.coalesce("speaker", F.lit("M1"))
    return lines.groupBy(KEY, speaker.alias("speaker")).agg(F.count(F.lit(1)).alias("lines"))


def untranslated(lines: DataFrame, han: str = HAN) -> DataFrame:
    """Lines whose translation equals the source and still holds foreign script."""
    same = F.col("translation") == F.col("text")
    return lines.where(same & has_han("text", han)).select(KEY, "cue_id")


def untranslated_summary(lines: DataFrame, han: str = HAN) -> DataFrame:
    same = (F.col("translation") == F.col("text")) & has_han("text", han)
    return lines.groupBy(KEY).agg(F.count(F.lit(1)).alias("total"), F.count_if(same).alias("unchanged"))


def review_unresolved(flagged: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Flagged lines that are missing from the edited track or still read as before."""
    old = before.select(KEY, "cue_id", strip("text").alias("_old"))
    new = after.select(KEY, "cue_id", strip("text").alias("_new"))
    rows = flagged.join(old, [KEY, "cue_id"], "left").join(new, [KEY, "cue_id"], "left")
    return rows.where(F.col("_new").isNull() | (F.col("_new") == F.coalesce("_old", F.lit("")))).select(KEY, "cue_id")


def first_messages(rows: DataFrame, keys: list[str], message: Column, order: Column, n: int = 12) -> DataFrame:
    """First ``n`` messages per key and how many more there are."""
    from pyspark.sql import Window

    ranked = rows.select(*keys, message.alias("m"), order.alias("o"))
    top = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "m"))).where(F.col("_r") <= n)
    joined = top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "m"))), lambda e: e["m"]), "; ").alias("shown")
    )
    counts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    more = F.when(F.col("_all") > n, F.format_string(" +%d more", F.col("_all") - n)).otherwise("")
    return joined.join(counts, keys).select(*keys, F.concat("shown", more).alias("messages"))


# ---------------------------------------------------------------------------- quality


def quality_flags(groups: DataFrame, lang: str, han: str = HAN, order: str = "group_no") -> DataFrame:
    """Long table of flags: reading speed, short display, cut sentences, foreign script."""
    ms = F.col("end_ms") - F.col("start_ms")
    seconds = F.greatest(F.lit(0.001), ms / F.lit(1000.0))
    rate = cps("translation", ms)
    nothing = F.lit(None).cast("double")

    def flag(when: Column, severity: str, kind: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), value.alias("value")))

    flags = [
        flag(rate > 25, "warning", "high_cps", py_round(rate, 1)),
        flag(seconds < 0.65, "warning", "short_duration", py_round(seconds, 2)),
        flag(last_word_fragment("translation"), "severe", "sentence_fragment", nothing),
    ]
    if lang in HAN_FREE_LANGS:
        flags.append(flag(has_han("translation", han), "severe", "han_residue", nothing))
    rows = groups.select(KEY, order, F.explode(F.filter(F.array(*flags), lambda f: f.isNotNull())).alias("f"))
    return rows.select(KEY, order, "f.severity", "f.type", "f.value")


def quality_summary(flags: DataFrame, tracks: DataFrame) -> DataFrame:
    severe = F.col("severity") == "severe"
    sums = flags.groupBy(KEY).agg(F.count_if(~severe).alias("warnings"), F.count_if(severe).alias("severe"))
    rows = tracks.select(KEY).distinct().join(sums, KEY, "left")
    return rows.select(
        KEY, F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("severe", F.lit(0)).alias("severe"),
        (F.coalesce("severe", F.lit(0)) > 0).alias("needs_review"),
    )


def track_stats(cues: DataFrame, kind: str) -> DataFrame:
    """Cue count and mean duration per kind of track."""
    ms = F.col("end_ms") - F.col("start_ms")
    return cues.groupBy(kind).agg(F.count(F.lit(1)).alias("cues"), py_round(F.sum(ms) / F.count(F.lit(1)), 3).alias("mean_ms"))


# ----------------------------------------------------------------------------- voices

# Voice and tone by engine, language and speaker.
_EDGE = {
    "vi": {"M1": ("vi-VN-NamMinhNeural", "+0Hz"), "F1": ("vi-VN-HoaiMyNeural", "+0Hz"),
           "M2": ("vi-VN-NamMinhNeural", "-4Hz"), "F2": ("vi-VN-HoaiMyNeural", "+4Hz"),
           "N": ("vi-VN-NamMinhNeural", "+0Hz")},
    "en": {"M1": ("en-US-AndrewMultilingualNeural", "+0Hz"), "F1": ("en-US-AvaMultilingualNeural", "+0Hz"),
           "M2": ("en-US-BrianMultilingualNeural", "+0Hz"), "F2": ("en-US-EmmaMultilingualNeural", "+0Hz"),
           "M3": ("en-US-ChristopherNeural", "-2Hz"), "F3": ("en-US-AriaNeural", "+0Hz"),
           "M4": ("en-US-GuyNeural", "+0Hz"), "F4": ("en-US-JennyNeural", "+0Hz"),
           "N": ("en-US-AndrewMultilingualNeural", "+0Hz")},
    "id": {"M1": ("id-ID-ArdiNeural", "+0Hz"), "F1": ("id-ID-GadisNeural", "+0Hz"),
           "M2": ("id-ID-ArdiNeural", "-4Hz"), "F2": ("id-ID-GadisNeural", "+4Hz"),
           "N": ("id-ID-ArdiNeural", "+0Hz")},
}
_GEMINI = {
    lang: {"M1": ("Charon", "warm"), "F1": ("Kore", "warm"), "M2": ("Fenrir", "dramatic"),
           "F2": ("Aoede", "intimate"), "N": ("Zephyr", "neutral")}
    for lang in ("vi", "en")
}
# Voice when nothing else is set, by language.
DEFAULT_VOICES = {"vi": "vi-VN-NamMinhNeural", "en": "en-US-AndrewMultilingualNeural", "id": "id-ID-ArdiNeural"}


def voice_rows() -> list[tuple[str, str, str, str, str]]:
    return [
        (engine, lang, speaker, voice, tone)
        for engine, langs in (("edge", _EDGE), ("gemini", _GEMINI))
        for lang, speakers in langs.items()
        for speaker, (voice, tone) in speakers.items()
    ]


def voice_map(spark: SparkSession) -> DataFrame:
    """The built-in voices as a dimension; a fixed table of a few dozen rows."""
    return spark.createDataFrame(voice_rows(), "engine string, lang string, speaker string, voice string, tone string")


def attach_speakers(segments: DataFrame, speakers: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Speaker by position (``speakers``: track_id, position from 1, speaker) where the line has none."""
    layout = layout or plan_layout(segments, [KEY], ["start_ms", "index"])
    numbered = scan(segments, layout, {"position": ("number", None)})
    given = speakers.select(KEY, F.col("position").cast("bigint").alias("position"), F.col("speaker").alias("_given"))
    return numbered.join(given, [KEY, "position"], "left").withColumn(
        "speaker", F.coalesce("speaker", "_given", F.lit("M1"))
    ).drop("_given")


def resolve_voice(
    segments: DataFrame, engine: str, lang: str, single: str | None = None, custom: DataFrame | None = None,
) -> DataFrame:
    """Voice and tone: one voice for all, else the track's own choice, else map, else default.

    ``custom`` is ``(track_id, speaker, custom_voice, custom_tone)``.
    """
    neutral = "+0Hz" if engine == "edge" else "warm"
    if single:
        return segments.withColumn("voice", F.lit(single)).withColumn("tone", F.lit(neutral))
    mapped = voice_map(segments.sparkSession).where((F.col("engine") == engine) & (F.col("lang") == lang)).select(
        F.col("speaker").alias("_speaker"), F.col("voice").alias("_voice"), F.col("tone").alias("_tone")
    )
    rows = segments.withColumn("_speaker", F.coalesce("speaker", F.lit("M1"))).join(F.broadcast(mapped), "_speaker", "left")
    own, own_tone = F.lit(None).cast("string"), F.lit(None).cast("string")
    if custom is not None:
        rows = rows.join(custom.select(KEY, "speaker", "custom_voice", "custom_tone"), [KEY, "speaker"], "left")
        own, own_tone = F.col("custom_voice"), F.when(F.col("custom_voice").isNotNull(), F.coalesce("custom_tone", F.lit(neutral)))
    fallback = DEFAULT_VOICES.get(lang, DEFAULT_VOICES["vi"])
    return rows.select(
        *segments.columns, F.coalesce(own, "_voice", F.lit(fallback)).alias("voice"),
        F.coalesce(own_tone, "_tone", F.lit(neutral)).alias("tone"),
    )


def tts_requests(voiced: DataFrame, lang: str, engine: str, model: str, style: str = "") -> DataFrame:
    """Distinct synthesis requests by content key, with the number of lines each serves."""
    later = (F.col("index") > 1).cast("string") if engine == "gemini" else F.lit("false")
    key = identity_key("text", F.lit(lang), F.lit(engine), F.lit(model), "voice", "tone", F.lit(style), later)
    return voiced.withColumn("cache_key", key).groupBy("cache_key").agg(
        F.min("text").alias("text"), F.min("voice").alias("voice"), F.min("tone").alias("tone"),
        F.count(F.lit(1)).alias("lines"),
    )


# --------------------------------------------------------------------- publish packages

# Rights under which a package may pass.
ALLOWED_RIGHTS = ["owned", "licensed", "approved"]


def publish_packages(items: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Package rows with their quality gate.

    ``items`` needs ``batch_id, item_id, source_sha256, video_sha256, video_bytes,
    channel_rights, strict, fallback_used``; rows without a video are left out.
    """
    options = options or {}
    rights = F.lower(strip(F.coalesce(
        F.nullif("channel_rights", F.lit("")), F.lit(options.get("rights_status")), F.lit("review_required")
    )))
    approved = F.col("strict") & ~F.col("fallback_used")
    ready = items.where(F.coalesce("video_bytes", F.lit(0)) > 0)
    payload = [c for c in ready.columns if c not in ("channel_rights", "strict", "created_at")]
    return ready.select(
        package_key(F.col("batch_id").cast("string"), F.col("item_id"), F.col("source_sha256"), F.col("video_sha256")).alias("package_id"),
        *payload, rights.alias("rights_status"),
        F.struct(F.lit(options.get("source_lang", "zh")).alias("source"), F.lit(options.get("target_lang", "en")).alias("target")).alias("language"),
        F.when(approved, "approved").otherwise("awaiting_review").alias("review_status"),
        F.when(rights.isin(ALLOWED_RIGHTS) & approved, "passed").otherwise("review_required").alias("qc_status"),
        F.lit(options.get("approval_policy", "manual")).alias("publish_policy"),
        *([F.col("created_at")] if "created_at" in items.columns else []),
    )


def payload_hash(packages: DataFrame) -> Column:
    """Hash of everything but the creation time."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in packages.columns if c != "created_at"))), 256)


def emit_packages(existing: DataFrame, packages: DataFrame) -> DataFrame:
    """Classify packages against the outbox: new, unchanged or collision."""
    stored = existing.select("package_id", F.col("payload_sha256").alias("_stored"))
    rows = packages.withColumn("payload_sha256", payload_hash(packages)).join(stored, "package_id", "left")
    outcome = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("_stored") == F.col("payload_sha256"), "unchanged").otherwise("collision")
    )
    return rows.withColumn("outcome", outcome).drop("_stored")


def package_collisions(packages: DataFrame) -> DataFrame:
    """Package ids that appear with different contents."""
    rows = packages.withColumn("_h", payload_hash(packages))
    return rows.groupBy("package_id").agg(
        F.min("_h").alias("_a"), F.max("_h").alias("_b"), F.count(F.lit(1)).alias("rows")
    ).where(F.col("_a") != F.col("_b")).select("package_id", "rows")


