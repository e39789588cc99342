"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.srt import cue_timings, parse_fusion, parse_segmentation
from cueloom.functions.text import SPEAKERS, valid_id
from cueloom.operators.cues import KEY
from cueloom.operators.groups import (
    allocate_segments, coverage, coverage_errors, merge_fragments, source_groups, split_sentences_timed, tts_groups,
)
from cueloom.operators.quality import (
    attach_speakers, emit_packages, publish_packages, quality_flags, resolve_voice, tts_requests,
)
from cueloom.operators.scan import at_most
from cueloom.operators.state import evict_jobs, expired_files
from cueloom.session import checkpointed


@dataclass
class Fusion:
    """Tables of a fused corpus; each is derived when it is first asked for."""

    status: DataFrame
    lang: str
    lines: Callable[[], DataFrame]

    @cached_property
    def display(self) -> DataFrame:
        return self.lines()

    @cached_property
    def tts(self) -> DataFrame:
        return tts_groups(self.display)

    @cached_property
    def flags(self) -> DataFrame:
        return quality_flags(self.display, self.lang)


def fuse_corpus(
    cues: DataFrame, answers: DataFrame, lang: str, segment_answers: DataFrame | None = None,
    fallback_lines: DataFrame | None = None,
) -> Fusion:
    """Model answers to display and narration tracks, with a safe way for unusable answers.

    ``answers`` is ``(track_id, raw)``, one per track. A track whose answer breaks the
    contract is grouped by its own cues and takes ``fallback_lines`` (``track_id, group_no,
    text``; ``group_no`` is the first cue id), or its source text.
    """
    # All three are read several times below, so they are written once instead of derived again.
    cues = at_most(checkpointed(cues), cues)
    parsed = checkpointed(parse_fusion(answers))
    checked = checkpointed(coverage(parsed.where(F.col("error").isNull()).drop("error"), cues))
    problems = coverage_errors(checked, cues).select(KEY, F.col("first_error").alias("_contract"))
    unusable = parsed.where(F.col("error").isNotNull()).select(KEY, F.col("error").alias("_answer")).distinct()
    asked = answers.select(KEY).distinct().withColumn("_asked", F.lit(True))
    status = (
        cues.select(KEY).distinct().join(problems, KEY, "left").join(unusable, KEY, "left").join(asked, KEY, "left")
        .select(
            KEY,
            F.when(F.col("_asked").isNull(), "no_answer").otherwise(F.coalesce("_answer", "_contract")).alias("warning"),
        )
        .withColumn("used_fallback", F.col("warning").isNotNull())
    )
    return Fusion(status, lang, lambda: _display(cues, checked, status, lang, segment_answers, fallback_lines))


def _display(
    cues: DataFrame, checked: DataFrame, status: DataFrame, lang: str, segment_answers: DataFrame | None, fallback_lines: DataFrame | None,
) -> DataFrame:
    good = status.where(~F.col("used_fallback")).select(KEY)
    bad = status.where("used_fallback").select(KEY)
    shape = [KEY, "group_no", "source_ids", "source_text", "translation", "speaker", "start_ms", "end_ms"]
    fused = checked.join(good, KEY, "left_semi").withColumn("group_no", F.col("group_no").cast("bigint")).select(
        *[F.transform("source_ids", lambda v: v.cast("bigint")).alias(c) if c == "source_ids" else F.col(c) for c in shape]
    )
    own = source_groups(at_most(cues.join(bad, KEY, "left_semi"), cues)).withColumn("speaker", F.lit("M1"))
    if fallback_lines is not None:
        own = own.join(fallback_lines.select(KEY, "group_no", F.col("text").alias("_line")), [KEY, "group_no"], "left")
    else:
        own = own.withColumn("_line", F.lit(None).cast("string"))
    own = own.withColumn("translation", F.coalesce("_line", "source_text")).select(
        *[F.transform("source_ids", lambda v: v.cast("bigint")).alias(c) if c == "source_ids" else F.col(c) for c in shape]
    )
    display = checkpointed(merge_fragments(checkpointed(split_sentences_timed(fused.unionByName(own)))))
    if segment_answers is not None:
        proposals = parse_segmentation(segment_answers).where(F.col("index").isNotNull()).select(KEY, "index", "segments")
        display = allocate_segments(display, proposals, lang)
    return display


def display_to_tts(docs: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Narration units of an edited display document, speakers by position."""
    # What several steps count and read is written once, so the documents are parsed once.
    cues = checkpointed(cue_timings(docs)).withColumn("index", F.col("cue_id")).withColumn("speaker", F.lit(None).cast("string"))
    if speakers is not None:
        cues = attach_speakers(cues, speakers)
    known = F.upper(F.coalesce("speaker", F.lit("M1")))
    groups = cues.select(
        KEY, F.col("cue_id").cast("bigint").alias("group_no"), F.array(F.col("cue_id").cast("bigint")).alias("source_ids"),
        F.col("text").alias("source_text"), F.col("text").alias("translation"),
        F.when(known.isin(SPEAKERS), known).otherwise("M1").alias("speaker"), "start_ms", "end_ms",
    )
    return tts_groups(merge_fragments(checkpointed(split_sentences_timed(groups))))


def review_routing(jobs: DataFrame) -> DataFrame:
    """Where a translated job goes: on, to review with the first reason, or ends as partial.

    Columns: ``pause, untranslated, fallbacks, fusion_fallback, fusion_review, tts, burn``.
    """
    later = F.col("tts") | F.col("burn")
    reason = (
        F.when(F.col("untranslated") > 0, "untranslated").when(F.col("fallbacks") > 0, "fallback_lines")
        .when(F.col("fusion_fallback"), "fusion_fallback").when(F.col("fusion_review"), "fusion_review")
        .when(F.col("pause"), "requested")
    )
    route = (
        F.when((F.col("untranslated") > 0) & ~later, "partial")
        .when(reason.isNotNull() & later, "awaiting_review").otherwise("continue")
    )
    return jobs.withColumn("route", route).withColumn("reason", F.when(route != "continue", reason))


def publish_gate(items: DataFrame, outbox: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Packages with their gate and what the outbox does with them."""
    return emit_packages(outbox, publish_packages(items, options))


def reconcile_completion(jobs: DataFrame, files: DataFrame, probes: DataFrame, now: int, output_root: str, grace_s: int = 120) -> DataFrame:
    """Jobs left in work whose final video proves that they are done.

    ``jobs`` has ``status, active_step, cancel, lang, steps map<string,boolean>,
    results map<string,string>, render_status, render_path, render_size``.
    """
    sized = files.select(F.col("path").alias("render_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    media = probes.select(F.col("path").alias("render_path"), "duration_s", "has_video", "has_audio")
    rows = jobs.join(sized, "render_path", "left").join(media, "render_path", "left")

    def step(name: str) -> Column:
        return F.coalesce(F.try_element_at("steps", F.lit(name)), F.lit(False))

    evidence = (
        valid_id("job_id") & F.col("status").isin("processing", "interrupted")
        & (F.col("active_step") == "step_5_burn") & ~F.col("cancel") & step("burn_sub")
        & F.col("lang").isin("vi", "en", "id", "zh") & (F.col("render_status") == "done")
    )
    for chosen, result in (("extract_sub", "subtitles"), ("clean_video", "clean"), ("tts", "tts")):
        evidence = evidence & (~step(chosen) | (F.coalesce(F.try_element_at("results", F.lit(result)), F.lit("")) == "done"))
    folder = F.concat(F.lit(output_root.rstrip("/") + "/"), F.col("job_id"), F.lit("/"))
    direct = F.col("render_path").startswith(folder) & ~F.substring(F.col("render_path"), F.length(folder) + 1, F.lit(100_000)).contains("/")
    evidence = (
        evidence & direct & (F.col("_size") > 0) & (F.col("_size") == F.col("render_size"))
        & (F.lit(now) - F.col("_mtime") >= grace_s)
        & (F.col("duration_s") > 0) & F.col("has_video") & (~step("tts") | F.col("has_audio"))
    )
    done = F.coalesce(evidence, F.lit(False))
    cols = {
        "status": F.when(done, "done").otherwise(F.col("status")),
        "active_step": F.when(done, "completed").otherwise(F.col("active_step")),
    }
    return rows.select(*[cols.get(c, F.col(c)).alias(c) for c in jobs.columns], done.alias("recovered"))


def source_selection(tracks: DataFrame) -> DataFrame:
    """Which recognised track a video uses, and how far its times can be trusted.

    Columns: ``engine, sidecar, vision, audio`` (contents, NULL when missing).
    """
    engine = F.col("engine")
    vision = F.when(engine.isin("gemini", "hybrid"), F.col("vision"))
    audio = F.when(engine.isin("whisper", "hybrid"), F.col("audio"))
    origin = (
        F.when(F.col("sidecar").isNotNull(), "provided").when(vision.isNotNull(), "vision_estimate")
        .when(audio.isNotNull(), "audio_estimate")
    )
    return tracks.withColumn("content", F.coalesce("sidecar", vision, audio)).withColumn("origin", origin).withColumn(
        "error", F.when(origin.isNull(), "no_source")
    )


def retry_plan(jobs: DataFrame) -> DataFrame:
    """Steps a retry can skip because their results are still there.

    Columns: ``status, srt_present, unchanged, edited, video_present, clean_is_video`` and
    the chosen steps ``extract_sub, download, clean_video``.
    """
    allowed = F.col("status").isin("error", "partial", "cancelled", "interrupted")
    translated = F.col("srt_present") & ((F.coalesce("unchanged", F.lit(0)) == 0) | F.col("edited"))
    clean = F.col("video_present") & F.col("clean_is_video")
    rows = jobs.withColumn("retry", allowed)
    return rows.select(
        "*", (F.col("extract_sub") & ~translated).alias("run_extract_sub"),
        (F.col("download") & ~F.col("video_present")).alias("run_download"),
        (F.col("clean_video") & ~clean).alias("run_clean_video"),
        F.when(clean, "pure_burn").alias("render_mode"),
    )


def retention_report(files: DataFrame, jobs: DataFrame, roots: dict[str, int], now: int, max_age_s: int, keep: int) -> DataFrame:
    """Files and job records due for removal; removing them is up to the caller."""
    due_files = expired_files(files, jobs, roots, now).select(F.lit("file").alias("kind"), F.col("path").alias("name"))
    due_jobs = evict_jobs(jobs, now, max_age_s, keep).select(F.lit("job").alias("kind"), F.col("job_id").cast("string").alias("name"))
    return due_files.unionByName(due_jobs)


def synthesis_plan(segments: DataFrame, speakers: DataFrame, engine: str, lang: str, model: str, custom: DataFrame | None = None) -> DataFrame:
    """Distinct narration requests after speakers and voices are settled."""
    voiced = resolve_voice(attach_speakers(segments, speakers), engine, lang, custom=custom)
    return tts_requests(voiced, lang, engine, model)


def run_items(items: DataFrame, processor, schema: str) -> DataFrame:
    """Run a user function per item; errors become a status instead of stopping the job.

    ``processor`` takes a dict and returns a dict of the extra columns in ``schema``.
    """
    from pyspark.sql import types as T

    extra = T.StructType.fromDDL(schema)
    full = T.StructType([*[f for f in items.schema.fields if f.name not in ("status", "error")], *extra.fields,
                         T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    names = [f.name for f in extra.fields]

    def run(frames):
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                made = dict.fromkeys(names)
                try:
                    made.update(processor(record) or {})
                    made.update(status="done", error=None)
                except Exception as exc:  # noqa: BLE001 - any failure belongs to the item
                    made.update(status="failed", error=str(exc)[:2000])
                rows.append({**record, **made})
            yield pd.DataFrame(rows, columns=[f.name for f in full.fields])

    return items.mapInPandas(run, full)


def translate_batches(batched: DataFrame, translate, batch: str = "batch_no") -> DataFrame:
    """Send each batch of lines (at most a request in size) through a user function.

    ``translate`` takes a list of texts and returns the raw answer of the model.
    """
    schema = f"{KEY} {batched.schema[KEY].dataType.simpleString()}, {batch} bigint, raw string, error string"
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "text"))), lambda e: e["text"])
    requests = batched.groupBy(KEY, F.col(batch).cast("bigint").alias(batch)).agg(texts.alias("texts"))

    def run(frames):
        for frame in frames:
            rows = []
            for key, number, lines in zip(frame[KEY], frame[batch], frame["texts"]):
                try:
                    rows.append((key, number, translate(list(lines)), None))
                except Exception as exc:  # noqa: BLE001
                    rows.append((key, number, None, str(exc)[:500]))
            yield pd.DataFrame(rows, columns=[KEY, batch, "raw", "error"])

    return requests.mapInPandas(run, schema)


def recognise_frames(frames: DataFrame, recognizer, schema: str = "array<struct<text:string,confidence:double>>") -> DataFrame:
    """Read text off frame images with a user function over batches of binaries."""
    @F.pandas_udf(schema)
    def read(images: pd.Series) -> pd.Series:
        return images.map(recognizer)

    rows = frames.withColumn("_read", read("image")).drop("image")
    return rows.select(*[c for c in rows.columns if c != "_read"], F.posexplode("_read").alias("row_no", "_r")).select(
        *[c for c in rows.columns if c != "_read"], "row_no", "_r.text", "_r.confidence"
    )
