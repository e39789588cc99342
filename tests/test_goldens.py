"""Literal cases with known results."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from cueloom.functions import srt, text, urls, values
from cueloom.operators import batches as B
from cueloom.operators import cues as C
from cueloom.operators import groups as G
from cueloom.operators import intervals as I
from cueloom.operators import quality as Q
from cueloom.operators import signals as S
from cueloom.operators import state as ST
from cueloom.operators import timeline as L
from cueloom.plans import jobs as P

CUE = "track_id string, cue_id bigint, start_ms bigint, end_ms bigint, text string"
GROUP = "track_id string, group_no bigint, source_ids array<bigint>, source_text string, translation string, speaker string, start_ms bigint, end_ms bigint"


def cues(spark, *rows):
    return spark.createDataFrame([("t", i, s, e, x) for i, (s, e, x) in enumerate(rows, 1)], CUE)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_line_and_segments(spark):
    got = one(spark, "[M1] <i>Xin chào mọi người</i>", text.clean_line)
    assert (got["text"], got["speaker"]) == ("Xin chào mọi người", "M1")
    doc = "1\n00:00:01,000 --> 00:00:03,500\n[M1] one\n\n2\n00:00:04.200 --> 00:00:06,000\n(F1): two\nlines\n\nx\nbad\n"
    rows = srt.tts_segments(spark.createDataFrame([("t", doc)], "track_id string, content string")).orderBy("index").collect()
    assert [(r.start_ms, r.end_ms, r.duration_ms, r.speaker) for r in rows] == [(1000, 3500, 2500, "M1"), (4200, 6000, 1800, "F1")]
    assert rows[1].text == "two lines"


def test_srt_round_trip_and_udtf(spark):
    made = cues(spark, (0, 1000, "a"), (1000, 2100, " "), (2200, 3000, "b\nc"))
    docs = C.to_srt(made).select("track_id", "content")
    assert docs.first()["content"] == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:02,200 --> 00:00:03,000\nb\nc\n"
    assert [tuple(r)[2:] for r in srt.cue_timings(docs).collect()] == [(0, 1000, "a"), (2200, 3000, "b c")]
    parts = C.to_srt(made, part_rows=1).orderBy("part").collect()
    assert "\n".join(p.content for p in parts) == docs.first()["content"]
    srt.register_udtf(spark)
    docs.createOrReplaceTempView("d")
    assert spark.sql("SELECT pos, text FROM d, LATERAL parse_srt(content)").count() == 2


@pytest.mark.parametrize("raw, fixed", [
    ("```srt\n7\n01:02.5 --> 1:02:03\nhi\n\n9\n00:00:04,000 --> 00:00:05,12 x\nyo\n```",
     "1\n00:01:02,500 --> 01:02:03,000\nhi\n\n2\n00:00:04,000 --> 00:00:05,120\nyo"),
    ("NO_SUBTITLES_FOUND", ""),
])
def test_repair(spark, raw, fixed):
    assert one(spark, raw, srt.repair_srt) == fixed


def test_sentences_and_seams(spark):
    assert one(spark, "First sentence. Second sentence!", text.split_sentences) == ["First sentence.", "Second sentence!"]
    assert one(spark, "costs 3.5 euro only", text.split_sentences) == ["costs 3.5 euro only"]
    assert one(spark, "go on ...", lambda v: text.join_text(v, F.lit("… home"))) == "go on home"


def test_urls(spark):
    share = "7.99 看看 https://v.douyin.com/hBUbjDqMhOI/ 复制此链接"
    assert one(spark, share, urls.extract_url) == "https://v.douyin.com/hBUbjDqMhOI/"
    for ip, public in (("8.8.8.8", True), ("10.1.2.3", False), ("172.20.0.1", False), ("::1", False), ("2606:4700::1111", True), ("x", False)):
        assert one(spark, ip, urls.is_public_address) is public


def test_python_rounding(spark):
    numbers = [26.05, 26.25, 2.675, 0.15, 1.005, 2.5, 3.5, 0.045]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(values.py_round("x", digits)).collect()]
        assert got == [float(round(x, digits)) for x in numbers]


def test_merge_intervals(spark):
    base = cues(spark, (1000, 3000, "a"), (3200, 5000, "b"), (9000, 11000, "c"))
    merged = I.merge_intervals(base, 350, 120, 150).orderBy("interval_no")
    assert [(r.s_ms, r.e_ms) for r in merged.collect()] == [(880, 5150), (8880, 11150)]
    assert I.enable_expr(merged).first()["expr"] == "between(t,0.880,5.150)+between(t,8.880,11.150)"


@pytest.mark.parametrize("spans, shift, expected", [
    ([(1000, 3000), (3500, 6000)], 1000, [(0, 2000), (2500, 5000)]),
    ([(100, 800), (1500, 4000)], 1200, [(300, 2800)]),
    ([(100, 800)], 20, [(100, 800)]),
])
def test_shift(spark, spans, shift, expected):
    shifts = spark.createDataFrame([("t", shift)], "track_id string, shift_ms bigint")
    out = C.shift_cues(cues(spark, *[(s, e, "x") for s, e in spans]), shifts).orderBy("cue_id").collect()
    assert [(r.start_ms, r.end_ms) for r in out] == expected and [r.cue_id for r in out] == list(range(1, len(out) + 1))


@pytest.mark.parametrize("ids, error", [
    ([[1, 2], [3, 4]], None), ([[1, 3]], "not_contiguous"), ([[1, 2], [2, 3, 4]], "not_exactly_once"), ([[1, 2]], "missing_ids"),
    ([[1, 2, 3, 4]], "pause_too_long"), ([[3, 4], [1, 2]], "not_in_order"),
])
def test_coverage(spark, ids, error):
    base = cues(spark, (0, 1000, "a"), (1000, 2100, "b"), (3000, 4000, "c"), (4000, 5500, "d"))
    groups = spark.createDataFrame([("t", n, g, " x  y ", "q") for n, g in enumerate(ids, 1)], "track_id string, group_no int, source_ids array<bigint>, translation string, speaker string")
    checked = G.coverage(groups, base)
    assert G.coverage_errors(checked, base).first()["first_error"] == error
    if error is None:
        rows = checked.orderBy("group_no").collect()
        assert [(r.start_ms, r.end_ms, r.source_text, r.translation, r.speaker) for r in rows] == [(0, 2100, "ab", "x y", "M1"), (3000, 5500, "cd", "x y", "M1")]


def test_fusion_with_segments(spark):
    base = cues(spark, (0, 3000, "a"), (3200, 6000, "b"))
    raw = '```json\n{"groups":[{"source_ids":[1],"translation":"First sentence. Second sentence!","speaker":"F1"},{"source_ids":[2],"translation":"If you often struggle to time your lane changes, this video will clearly explain the core rules of safe lane changing.","speaker":"F1"}]}\n```'
    parts = '{"items":[{"index":1,"segments":[{"text":"If you often struggle to time your lane changes,"},{"text":"this video will clearly explain the core rules of safe lane changing."}]}]}'
    answer = spark.createDataFrame([("t", raw)], "track_id string, raw string")
    out = P.fuse_corpus(base, answer, "en", spark.createDataFrame([("t", parts)], "track_id string, raw string"))
    assert out.display.count() == 4 and out.tts.count() == 3
    assert out.tts.orderBy(F.desc("start_ms")).first()["translation"].startswith("If you often")
    assert not out.status.first()["used_fallback"]
    bad = P.fuse_corpus(base, spark.createDataFrame([("t", "no json")], "track_id string, raw string"), "en")
    # The two cues are 200 ms apart and six seconds long together, so they make one group.
    assert bad.status.first()["warning"] == "no_json" and bad.display.first()["translation"] == "ab"


def test_ocr_states(spark):
    rows = [("t", 1, 0, 500, "你好世界", "dialogue"), ("t", 2, 500, 1000, "你好世界。", "dialogue"), ("t", 3, 1000, 1500, "别的内容", "dialogue"), ("t", 4, 1500, 2000, "", "none")]
    df = spark.createDataFrame(rows, "track_id string, state_no bigint, start_ms bigint, end_ms bigint, text string, kind string")
    out = G.merge_ocr_states(df).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in out] == [(0, 1000), (1000, 1500)]


def test_stitch(spark):
    rows = [("t", w, 1, 0, 1000, "line") for w in range(3)]
    local = spark.createDataFrame(rows, "track_id string, window_no bigint, cue_id bigint, start_ms bigint, end_ms bigint, text string")
    durations = spark.createDataFrame([("t", 121_000, 121.0)], "track_id string, duration_ms bigint, duration_s double")
    assert [r.start_ms for r in G.stitch_windows(local, durations).orderBy("start_ms").collect()] == [0, 60_000, 120_000]
    assert G.window_list(durations).count() == 3


SEG = "track_id string, index bigint, start_ms bigint, end_ms bigint, text string, speaker string, raw_ms bigint"


def test_schedule(spark):
    rows = [("t", 1, 1000, 3000, "a", None, 1500), ("t", 2, 3100, 4500, "b", None, 2500), ("t", 3, 4600, 7000, "c", None, 1800), ("t", 4, 8000, 9000, "d", None, None)]
    out = L.schedule_timeline(spark.createDataFrame(rows, SEG), margin_ms=50, max_speed=1.7).orderBy("index").collect()
    placed = [r for r in out if r.status != "failed"]
    assert placed[0].actual_start_ms == 1000 and out[3].status == "failed"
    assert all(a.actual_end_ms <= b.actual_start_ms for a, b in zip(placed, placed[1:]))
    dense = [("t", 1, 0, 100, "a", None, 1000), ("t", 2, 110, 200, "b", None, 1000)]
    packed = L.schedule_timeline(spark.createDataFrame(dense, SEG), max_speed=1.0)
    got = packed.orderBy("index").collect()
    assert [r.status for r in got] == ["timing_overflow"] * 2 and sum(r.overlap_ms for r in got) == 0 and got[1].actual_end_ms >= 2060
    assert L.tts_summary(packed).first()["status"] == "partial"
    assert C.track_validity(C.validate_cues(L.placed_cues(packed))).first()["valid"]


def refine(spark, start, end, visible, shift, count=50):
    base = spark.createDataFrame([("t", 1, start, end, "今天天气很好")], CUE)
    tracks = spark.createDataFrame([("t", 25.0, count)], "track_id string, fps double, frame_count bigint")
    seen = spark.createDataFrame([("t", f, 0, "今天天气很好", 0.9) for f in visible], "track_id string, frame_idx bigint, row_no int, text string, confidence double")
    return L.refine_boundaries(base, tracks, seen, shift).first()


def test_refine(spark):
    r = refine(spark, 400, 680, range(7, 21), 2.0)
    assert (r.start_ms, r.end_ms, r.start_frame, r.end_frame_exclusive, r.status) == (280, 840, 7, 21, "refined")
    r = refine(spark, 400, 680, range(5, 40), 0.3)
    assert (r.start_ms, r.end_ms, r.status) == (200, 680, "refined_start_only")
    r = refine(spark, 400, 680, range(0, 50), 2.0)
    assert (r.start_ms, r.end_ms, r.status) == (400, 680, "unchanged_unverified_boundary")


def test_text_observed(spark):
    rows = [(1, "今天天气", "今天天气", 0, 0.07), (2, "今天天气", "今天大气", 0, 0.07), (3, "今天", "今天", 0, 0.07), (4, "今天天气", "今天", 0, 0.5), (4, "今天天气", "天气", 1, 0.5)]
    df = spark.createDataFrame(rows, "k int, text string, observed string, row_no int, confidence double")
    assert [r.seen for r in L.text_observed(df, ["k"]).orderBy("k").collect()] == [True, False, False, True]


def test_quality(spark):
    df = spark.createDataFrame([("t", 1, [1], "", "Still 在办公室...", "M1", 0, 2000)], GROUP)
    assert {r.type for r in Q.quality_flags(df, "en").collect()} == {"sentence_fragment", "han_residue"}


def test_guard_and_runs(spark):
    times = spark.createDataFrame([("t", x) for x in (0.8, 1.8, 5.0)], "track_id string, t double")
    out = S.guard_intervals(times, spark.createDataFrame([("t", 6.0)], "track_id string, duration_s double")).orderBy("start_ms").collect()
    assert out[0].start_ms == 0 and out[-1].end_ms == 6000 and len(out) > 4
    frames = [("t", i, i * 40, p, k) for i, (p, k) in enumerate([(1, False), (1, False), (None, False), (2, False), (2, False), (2, False), (3, True)])]
    runs = S.confirm_runs(spark.createDataFrame(frames, "track_id string, frame_no bigint, t_ms bigint, pattern_id bigint, known boolean")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.frames, r.has_unknown) for r in runs] == [(120, 240, 3, True), (240, 280, 1, False)]


def test_ledger_claims(spark):
    schema = "channel_id string, work_id string, source_url string, source_json string, status string, artifact_path string, package_path string, last_error string, attempts int, created_at string, updated_at string"
    work = spark.createDataFrame([("c", "1", "u", "{}")], "channel_id string, work_id string, source_url string, source_json string")
    first = ST.ledger_claim(spark.createDataFrame([], schema), work, F.lit("t1"))
    again = ST.ledger_claim(first, work, F.lit("t2"))
    assert again.first()["attempts"] == 1
    mark = spark.createDataFrame([("c", "1", 1, "FAILED", "e", None, None)], "channel_id string, work_id string, seq int, status string, error string, artifact_path string, package_path string")
    third = ST.ledger_claim(ST.ledger_mark(again, mark, F.lit("t3")), work, F.lit("t4")).first()
    assert (third.status, third.attempts, third.created_at, third.last_error) == ("CLAIMED", 2, "t1", None)


def test_batch_and_chunks(spark):
    items = spark.createDataFrame([("b", 1, "done", 100), ("b", 2, "failed", 0), ("b", 3, "done", 100)], "batch_id string, item_id int, status string, progress int")
    assert B.batch_status(items).first()["status"] == "partial"
    assert [r.item_id for r in B.pending_items(items.withColumn("attempts", F.lit(1))).collect()] == [2]
    sessions = spark.createDataFrame([(1, 3, 1000, 3000)], "session_id bigint, total_chunks bigint, chunk_size bigint, total_size bigint")
    got = spark.createDataFrame([(1, 0, 1000), (1, 2, 1000)], "session_id bigint, chunk_index bigint, bytes bigint")
    row = B.missing_chunks(got, sessions).first()
    assert (row.n_missing, row.first_missing, row.complete) == (1, [1], False)


def test_translation_lines(spark):
    answer = spark.createDataFrame([("t", "1. [F1] Hello there\nnoise\n9. out")], "track_id string, raw string")
    ai = srt.parse_numbered(answer, 2).select("track_id", (F.col("offset") + 1).alias("cue_id"), "text", "speaker")
    base = cues(spark, (0, 1, "一"), (1, 2, "二"))
    second = spark.createDataFrame([("t", 2, "two")], "track_id string, cue_id bigint, text string")
    rows = Q.translate_fallback(base, ai, second).orderBy("cue_id").collect()
    assert [(r.translation, r.speaker, r.fallback) for r in rows] == [("Hello there", "F1", False), ("two", "M1", True)]
    assert [tuple(r)[1:] for r in Q.speaker_counts(Q.translate_fallback(base, ai, second, driving=True), True).collect()] == [("M1", 2)]


def test_media_scan(spark, tmp_path):
    from cueloom.sources import readers

    (tmp_path / "nested").mkdir()
    for name in ("b.mp4", "a.MKV", "nested/c.mov", "ignore.txt", "partial.mp4.part"):
        (tmp_path / name).write_bytes(name.encode())
    media = readers.scan_media(spark, str(tmp_path))
    assert [r.relative_path for r in readers.stable_paths(media).collect()] == ["a.MKV", "b.mp4", "nested/c.mov"]
    import hashlib

    marks = {r.relative_path: r.sha256 for r in readers.fingerprint(media).collect()}
    assert marks["b.mp4"] == hashlib.sha256(b"b.mp4").hexdigest()
    assert readers.scan_media(spark, str(tmp_path), recursive=False).count() == 2


def test_files_and_versions(spark, tmp_path):
    from cueloom.sources import readers, sinks

    good = cues(spark, (0, 1000, "a"), (1000, 2000, "b"))
    bad = good.withColumn("track_id", F.lit("u")).withColumn("start_ms", F.lit(0).cast("bigint"))
    refused = sinks.write_validated_srt(good.unionByName(bad), str(tmp_path / "srt"))
    assert [r.track_id for r in refused.collect()] == ["u"]
    written = next((tmp_path / "srt" / "track_id=t" / "part=0").glob("*.txt")).read_text(encoding="utf-8")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.srt").write_text(written, encoding="utf-8")
    docs = readers.read_srt(spark, str(tmp_path / "in"))
    assert written.startswith("﻿") and [r.text for r in srt.cue_timings(docs).collect()] == ["a", "b"]
    base = str(tmp_path / "table")
    assert sinks.read_version(spark, base) is None
    sinks.write_version(good, base)
    sinks.write_version(good.limit(1), base)
    assert sinks.read_version(spark, base).count() == 1
    (tmp_path / "conf.json").write_text('[{"key": "a"}]')
    assert readers.read_json_config(spark, str(tmp_path / "conf.json"), "key string").count() == 1


def test_recogniser_hook(spark):
    frames = spark.createDataFrame([("t", 1, b"ab"), ("t", 2, b"")], "track_id string, frame_idx int, image binary")
    out = P.recognise_frames(frames, lambda b: [{"text": b.decode(), "confidence": 0.5}] if b else [])
    assert [tuple(r) for r in out.collect()] == [("t", 1, 0, "ab", 0.5)]


def test_layout_keeps_the_text_and_takes_the_largest_size(spark):
    """Nothing is lost, no line is wider than the region, and a size more wouldn't fit; letters and marks are one character."""
    from cueloom.functions.values import fit_layout

    texts = ["one two three four five six", "字幕测试 文字很长很长 abc", "w" * 90 + " end", "étế l'été", "", None, "a\n\nb\r\nc", "x " * 200]
    wide = lambda t, size: sum(size if "一" <= c <= "鿿" else 0.58 * size for c in t)
    for width, height in ((112, 100), (412, 90), (900, 170)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        for r in df.select("i", "t", fit_layout("t", F.lit(width), F.lit(height), F.lit(40), F.lit(16)).alias("f")).collect():
            clean = unicodedata.normalize("NFC", r.t or "")
            assert "".join("".join(r.f.lines).split()) == "".join(clean.split())
            assert all(wide(line, r.f.font_size) <= width - 12 + 1e-6 for line in r.f.lines)
            assert r.f.height == pytest.approx(len(r.f.lines) * r.f.font_size * 1.15) and r.f.width == pytest.approx(max(wide(line, r.f.font_size) for line in r.f.lines))
            assert r.f.overflow == (len(r.f.lines) > 4 or r.f.height > height - 8) and (not r.f.overflow or r.f.font_size == 16)
    three = spark.createDataFrame([("a\n\nb c",)], "t string").select(fit_layout("t", F.lit(900), F.lit(170), F.lit(40), F.lit(16)).alias("f")).first().f
    assert three.lines == ["a", "b c"] and three.font_size == 40


def test_private_keys_go_at_every_depth(spark):
    row = {"keep": [{"m": {"a": {"token": 1, "b": 2}, "_x": {"b": 3}}, "password": "p"}, None], "plain": None, "my_api_key": 5}
    shape = "keep array<struct<m:map<string,map<string,int>>,password:string>>, plain string, my_api_key int"
    got = values.public_rows(spark.createDataFrame([row], shape)).first().asDict(recursive=True)
    assert got == {"keep": [{"m": {"a": {"b": 2}}}, None], "plain": None}


def test_similarity_of_phrases_that_repeat_themselves(spark):
    """The ratio is difflib's, block by block; ``same_text`` decides as it does, whatever its bound rules out first."""
    from difflib import SequenceMatcher

    from cueloom.functions import text as X

    rows = [("le de de de", "le 7e de de"), ("erer der der der", "erer 7er der der"), ("abcdef", "fedcba"), ("abcdefgh", "abcdefgx"), ("", "a"), (None, "a"), ("ab" * 150, "ab" * 149 + "cd")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.similarity("a", "b").alias("r"), X.alike("a", "b", F.lit(0.84)).alias("same")).collect()
    for row in got:
        want = None if row.a is None else SequenceMatcher(None, row.a, row.b).ratio()
        assert row.r == want and bool(row.same) == (want is not None and want >= 0.84)


def test_readings_are_judged_once_for_all_frames_of_a_cue(spark, monkeypatch):
    """500 frames that show the same two rows give three comparisons: either row, and both as one."""
    seen = spark.sparkContext.accumulator(0)
    near = L.same_text

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(L, "same_text", lambda a, b: near(a, counted(b)))
    frames = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("frame_idx"), F.lit("hello there").alias("text"))
    pairs = frames.crossJoin(spark.createDataFrame([(1, "hello", 0.9), (2, "there", 0.9)], "row_no int, observed string, confidence double"))
    got = L.text_observed(pairs, ["k", "frame_idx"]).collect()
    assert len(got) == 500 and all(r.seen for r in got) and seen.value <= 30


def refined_by_hand(cues, fps, count, rows, shift):
    """Every frame of every window judged by difflib: the times of one track's cues, and which sides are verified."""
    from difflib import SequenceMatcher
    import re

    def norm(text):
        return re.sub(r"[^\w]", "", text).casefold()

    def same(a, b):
        a, b = norm(a), norm(b)
        least = min(len(a), len(b))
        return least >= 2 and SequenceMatcher(None, a, b).ratio() >= (0.9 if least <= 4 else 0.84)

    def valid(text, observed, sure):
        if sure is None or sure < 0.03:
            return False
        return same(text, observed) if sure >= 0.2 else len(norm(text)) >= 4 and norm(text) == norm(observed)

    def shown(text, frame):
        read = sorted(r[1:] for r in rows if r[0] == frame and r[2] is not None)
        return any(valid(text, o, c) for _n, o, c in read) or len(read) > 1 and valid(text, "".join(o for _n, o, _c in read), min(c for *_r, c in read))

    out, ended, top = [], 0, count - 1
    for i, (start, end, text) in enumerate(cues):
        reach = max(1, round(fps * shift))
        a = max(0, min(top, round(start * fps / 1000)))
        b = max(a, min(top, round(end * fps / 1000)))
        lo, hi = max(0, a - reach), min(top, b + reach)
        if i:
            lo = max(lo, round(sum(cues[i - 1][:2]) * fps / 2000))
        if i + 1 < len(cues):
            hi = min(hi, round(sum(cues[i + 1][:2]) * fps / 2000))
        middle = min(hi, max(lo, round((a + b) / 2)))
        spots = [f for f in (a, middle, max(a, b - 1)) if lo <= f <= hi and hi > lo and len(norm(text)) >= 2 and shown(text, f)]
        first = last = None
        if spots:
            anchor = min(spots, key=lambda f: (abs(f - middle), f))
            absent = [f for f in range(lo, hi + 1) if not shown(text, f)]
            gone, left = max((f for f in absent if f < anchor), default=None), min((f for f in absent if f > anchor), default=None)
            first = gone + 1 if gone is not None else 0 if lo == 0 else None
            last = left - 1 if left is not None else top if hi == top else None
            first = first if first is not None and first <= min(hi, a + reach) else None
            last = last if last is not None and last >= max(lo, b - reach) else None
            if first == 0 and last == top and (a > 0 or b < top):
                first = last = None
        begin = None if first is None else round(first * (1000.0 / fps))
        opened = begin is not None and ended <= begin < end
        new = begin if opened else start
        finish = None if last is None else round((last + 1) * (1000.0 / fps))
        closed = finish is not None and finish > new and (i + 1 == len(cues) or finish <= cues[i + 1][0])
        ended = finish if closed else end
        out.append((new, ended, opened, closed))
    return out


def test_refined_boundaries_as_by_hand(spark):
    """Several rows on a frame, unsure and missing readings, texts that are nearly their neighbours', windows over many blocks of frames."""
    import random

    texts = ["deéellelela", "de éelle le, la", "deéelleetla", "come here now", "come here know", "go", "a", "", "今天天气很好", "今天天气", "很好"]
    rng = random.Random(5)
    tracks, cues, seen, want = [], [], [], {}
    for t in range(30):
        fps, at, own, shown = rng.choice([5.0, 25.0, 59.94]), rng.choice([0, 900]), [], []
        for _ in range(rng.randint(1, 8)):
            end = at + rng.choice([300, 1200, 1200, 9000])
            own.append((at, end, rng.choice(texts)))
            at = end + rng.choice([40, 40, 600, 3000])
        count = int(at * fps / 1000) + 10
        for n, (start, end, text) in enumerate(own):
            if rng.random() < 0.85:
                whole = rng.choice([(text,), (text[: len(text) // 2], text[len(text) // 2 :]), (text, None), ("sign", text), (rng.choice(texts),)])
                sure = rng.choice([0.9, 0.9, 0.9, 0.1, 0.01])
                for f in range(max(0, int(start * fps / 1000) - rng.randint(0, 3)), min(count, int(end * fps / 1000) + rng.randint(0, 3))):
                    if rng.random() < 0.98:
                        shown += [(f, n * 4 + k, part, sure) for k, part in enumerate(whole)]
        tracks.append((f"t{t}", fps, count))
        cues += [(f"t{t}", n + 1, *c) for n, c in enumerate(own)]
        seen += [(f"t{t}", *r) for r in shown]
        want[f"t{t}"] = refined_by_hand(own, fps, count, shown, 2.0)
    out = L.refine_boundaries(
        spark.createDataFrame(cues, CUE), spark.createDataFrame(tracks, "track_id string, fps double, frame_count bigint"),
        spark.createDataFrame(seen, "track_id string, frame_idx bigint, row_no int, text string, confidence double"), 2.0).collect()
    got = {t: [(r.start_ms, r.end_ms, r.start_verified, r.end_verified) for r in sorted(out, key=lambda r: r.cue_id) if r.track_id == t] for t in want}
    assert got == want and sum(r.start_verified for r in out) > 10 and sum(r.end_verified for r in out) > 10


def sent(df):
    """Rows written to the shuffles of a query that has run."""

    def of(node):
        name = node.getClass().getSimpleName()
        if name.startswith("Reused"):
            return 0
        if name == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def test_frames_are_not_sent_one_by_one(spark):
    """Two cues of 40 s that are seen on 2,000 frames; what travels is cues and blocks of frames."""
    base = spark.createDataFrame([("t", 1, 0, 40_000, "hello there"), ("t", 2, 42_000, 82_000, "good bye now")], CUE)
    tracks = spark.createDataFrame([("t", 25.0, 2100)], "track_id string, fps double, frame_count bigint")
    frames = spark.range(0, 2050, 1, 1).select(F.lit("t").alias("track_id"), F.col("id").alias("frame_idx"), F.lit(0).alias("row_no"),
                                         F.when(F.col("id") < 1010, "hello there").otherwise("good bye now").alias("text"), F.lit(0.9).alias("confidence"))
    refined = L.refine_boundaries(base, tracks, frames)
    assert sent(refined) < 400
    assert [r.end_frame_exclusive for r in refined.orderBy("cue_id").collect()] == [1010, 2050]
