"""Documents in parts, large ids, null hot keys and streams that stop and go on."""

import datetime as dt

from pyspark.sql import functions as F

from cueloom.functions import srt, values
from cueloom.functions.text import strip
from cueloom.operators import cues as C
from cueloom.operators import groups as G
from cueloom.operators.scan import plan_layout, scan
from cueloom.operators.works import nest_replies
from cueloom.plans import jobs as P
from cueloom.streaming import feeds as X

CUE = "track_id string, cue_id bigint, start_ms bigint, end_ms bigint, text string"


def long_track(spark):
    return spark.createDataFrame([(t, i, i * 1000, i * 1000 + 900, f"line {i}") for t in "ab" for i in range(1, 51)], CUE)


def test_parts_are_one_document(spark):
    docs = C.to_srt(long_track(spark), part_rows=20)
    assert docs.count() == 6
    assert sorted(r.pos for r in srt.parse_srt(docs).where("track_id = 'a'").collect()) == list(range(1, 51))
    timed = srt.cue_timings(docs).where("track_id = 'b'").orderBy("cue_id").collect()
    assert [(r.cue_id, r.start_ms) for r in timed] == [(i, i * 1000) for i in range(1, 51)]
    spoken = srt.tts_segments(docs).where("track_id = 'a'").orderBy("seg_no").collect()
    assert [(r.seg_no, r["index"], r.text) for r in spoken] == [(i, i, f"line {i}") for i in range(1, 51)]
    spoilt = docs.select("track_id", "part", F.regexp_replace("content", r"(?m)^\d+$", "9").alias("raw"))
    whole = [r.content for r in srt.repair_documents(spoilt).where("track_id = 'a'").orderBy("part").collect()]
    assert "\n\n".join(whole) == C.to_srt(long_track(spark)).where("track_id = 'a'").first()["content"].rstrip("\n")


def test_documents_of_one_part_are_derived_and_read_once(spark):
    docs = C.to_srt(long_track(spark))
    for read in (srt.parse_srt, srt.cue_timings, srt.tts_segments):
        plan = read(docs)._jdf.queryExecution().optimizedPlan().toString()
        # Neither counted beside the rows nor computed once more to see whether there are any.
        assert "Join" not in plan and "Filter ((size(" not in plan and plan.count("collect_list") == 1, plan


def test_narration_of_documents_parses_them_once(spark, monkeypatch):
    counted, plain = [], G.plan_layout
    monkeypatch.setattr(G, "plan_layout", lambda df, *args: counted.append(df) or plain(df, *args))
    out = P.display_to_tts(C.to_srt(long_track(spark)))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [out, *counted]]
    assert len(plans) == 3 and not [p for p in plans if "collect_list(struct(n" in p or "-->" in p], plans
    # Nine lines of a second each make a unit.
    assert out.count() == 2 * 6


def test_fusion_derives_its_cues_once(spark):
    cues = long_track(spark).where("text != 'a mark'").withColumn("speaker", F.lit("M1"))
    answers = spark.createDataFrame([("a", '[{"source_ids": [1], "translation": "One.", "speaker": "M1"}]')], "track_id string, raw string")
    fused = P.fuse_corpus(cues, answers, "en")
    for made in (fused.status, fused.display, fused.tts):
        assert "a mark" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.track_id, r.warning) for r in fused.status.collect()) == [("a", "missing_ids"), ("b", "no_answer")]


def test_edges_are_all_kinds_of_space(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    rows = [(f"{spaces}a {spaces}b{spaces}",), (spaces,), ("",), (None,), ("\u200bx\ufeff",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(strip("t")).collect()]
    assert got == [None if t is None else t.strip() for (t,) in rows]


def test_replies_count_over_parts(spark):
    rows = [(1, 10, None, "top")] + [(1, 100 + i, 10, f"r{i}") for i in range(5)]
    out = nest_replies(spark.createDataFrame(rows, "aweme_id bigint, cid bigint, parent_cid bigint, text string"), part_rows=2).collect()
    assert [r.n_replies for r in out] == [5, 5, 5] and sum(len(r.replies) for r in out) == 5


def test_large_cue_ids_keep_their_window(spark):
    rows = [("t", 0, 1_500_000, 1000, 2000, "one"), ("t", 1, 2, 500, 1500, "two"), ("t", 0, 2_000_000, 30_000, 31_000, "mid")]
    local = spark.createDataFrame(rows, "track_id string, window_no bigint, cue_id bigint, start_ms bigint, end_ms bigint, text string")
    out = G.stitch_windows(local, spark.createDataFrame([("t", 500_000)], "track_id string, duration_ms bigint")).orderBy("start_ms").collect()
    assert [(r.text, r.conflict, r.start_ms) for r in out] == [("one", False, 1000), ("mid", False, 30_000), ("two", False, 60_500)]


def test_blank_words_keep_the_segment(spark):
    words = "array<struct<word:string,start:double,end:double>>"
    rows = [("t", 1, 0.0, 9.0, "a long line of text without any timed words", [(" ", 0.0, 1.0), ("", 1.0, 2.0)])]
    got = G.split_asr(spark.createDataFrame(rows, f"track_id string, seg_no bigint, start double, end double, text string, words {words}")).collect()
    assert [(r.piece, r.text) for r in got] == [(0, rows[0][4])]


def test_truth_of_numbers(spark):
    got = spark.range(1).select(
        values.parse_bool(F.lit(2)).alias("a"), values.parse_bool(F.lit(1.0)).alias("b"), values.parse_bool(F.lit(0.0), True).alias("c"),
        values.parse_bool(F.lit(None).cast("int"), True).alias("d"), values.parse_bool(F.lit("2"), True).alias("e"), values.parse_bool(F.lit("off"), True).alias("f")).first()
    assert tuple(got) == (True, True, False, True, True, False)


def test_null_key_is_split(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 8).alias("k"), "id")
    want = {tuple(r) for r in scan(rows, plan_layout(rows, ["k"], ["id"]), {"n": ("number", None), "p": ("prev", F.col("id"))}).collect()}
    spark.conf.set("cueloom.hotRows", "40")
    try:
        layout = plan_layout(rows, ["k"], ["id"])
        assert (None,) in layout.cuts
        got = {tuple(r) for r in scan(rows, layout, {"n": ("number", None), "p": ("prev", F.col("id"))}).collect()}
    finally:
        spark.conf.unset("cueloom.hotRows")
    assert got == want


def arrivals(spark, path, rows, mode):
    at = dt.datetime(2024, 1, 1)
    made = [(s, i, n, at + dt.timedelta(seconds=t)) for s, i, n, t in rows]
    spark.createDataFrame(made, "session_id bigint, chunk_index bigint, total_chunks bigint, ts timestamp").coalesce(1).write.mode(mode).parquet(path)


def test_uploads_go_on_after_a_stop(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    arrivals(spark, path, [(1, 0, 2, 0), (2, 0, 2, 10), (3, 0, 1, 20)], "overwrite")
    schema = spark.read.parquet(path).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return sorted(tuple(r) for r in X.chunk_arrivals(stream, base).collect())

    assert run() == [(3, 1, "complete")]
    arrivals(spark, path, [(1, 1, 2, 100), (3, 0, 1, 200)], "append")
    assert run() == [(1, 2, "complete"), (3, 1, "complete")]
    # Session 2 expires from its first receipt although a second one came; late repeats of told sessions tell nothing.
    arrivals(spark, path, [(2, 0, 2, 7000), (9, 0, 2, 7300)], "append")
    arrivals(spark, path, [(1, 1, 2, 20_000), (3, 0, 1, 20_000), (2, 1, 2, 20_000)], "append")
    assert run() == [(1, 2, "complete"), (2, 1, "expired"), (3, 1, "complete"), (9, 1, "expired")]


def test_state_is_kept_between_starts(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    start = spark.createDataFrame([(0, 100)], "k bigint, n bigint")

    def add(state, batch, _id):
        return state.unionByName(batch.select("k", F.lit(1).cast("bigint").alias("n"))).groupBy("k").agg(F.sum("n").alias("n"))

    def run():
        stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(path)
        return {r.k: r.n for r in X.fold_batches(stream, "t", start, add, base).collect()}

    for k in (0, 1, 1):
        spark.range(k, k + 1).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(path)
    assert run() == {0: 101, 1: 2}
    spark.range(1, 2).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(path)
    assert run() == {0: 101, 1: 3}


def test_runs_go_on_after_a_stop(spark, tmp_path):
    """Frames of three starts: a run over all of them, one that a NULL ends, an unknown one too short, and those still open at the end."""
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    shape = "track_id bigint, frame_no bigint, t_ms bigint, pattern_id bigint, known boolean"

    def frames(rows):
        spark.createDataFrame([(k, n, n * 40, p, known) for k, n, p, known in rows], shape).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
        return sorted(tuple(r) for r in X.run_confirm_stream(stream, base=base).collect())

    frames([(1, 0, 5, False), (1, 1, 5, False), (2, 0, 7, True), (2, 1, None, False), (3, 0, 9, False)])
    assert run() == [(2, 0, 40, 1, False)]
    frames([(1, 3, 5, False), (1, 2, 5, True), (3, 1, 8, False)])
    assert run() == [(1, 0, 160, 4, True), (2, 0, 40, 1, False)]
    frames([(1, 4, 5, False), (1, 5, 6, False), (2, 2, 7, False), (2, 3, 7, False), (2, 4, 7, False)])
    assert run() == [(1, 0, 200, 5, True), (2, 0, 40, 1, False), (2, 80, 200, 3, True)]
    assert run() == [(1, 0, 200, 5, True), (2, 0, 40, 1, False), (2, 80, 200, 3, True)]


def test_deliveries_are_tried_again_over_time(spark, tmp_path):
    """Attempts at 0 s, 1 h, 3 h, 7 h and 15 h; a stop between the ticks changes nothing."""
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    shape = "job_id bigint, delivery_status string, delivery_path string, attempts int, next_attempt bigint"
    jobs = spark.createDataFrame([(1, "pending", "a", 0, 0), (2, "pending", "a", 0, 0), (3, "pending", "gone", 0, 0), (4, "delivered", "a", 1, 0), (5, "pending", "a", None, None)], shape)
    results = spark.createDataFrame([(1, 2), (2, None), (3, 0), (5, 0)], "job_id bigint, sent_from int")
    files = spark.createDataFrame([("a", 10)], "path string, size bigint")

    def run(*ticks):
        for t in ticks:
            spark.createDataFrame([(t,)], "now bigint").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("now bigint").option("maxFilesPerTrigger", 1).parquet(path)
        return {r.job_id: (r.delivery_status, r.attempts) for r in X.delivery_timer(stream, jobs, results, files, base).collect()}

    first = run(1, 3000)
    assert first == {1: ("pending", 1), 2: ("pending", 1), 3: ("manual_required", 0), 4: ("delivered", 1), 5: ("delivered", 1)}
    assert run(3700) == first | {1: ("pending", 2), 2: ("pending", 2)}
    later = run(11_000, 9000)
    assert later == first | {1: ("delivered", 3), 2: ("pending", 3)}
    assert run(30_000, 60_000, 200_000) == later | {2: ("manual_required", 5)}


def test_a_session_ends_by_its_timer_whatever_the_batches(spark, tmp_path):
    """Receipts of one session in one batch or in five: what comes after two hours doesn't count."""
    rows = [(1, 0, 3, 0), (1, 1, 3, 7200), (1, 2, 3, 7201), (2, 0, 2, 5), (2, 0, 2, 6), (2, 1, 2, 7205), (3, 0, 1, 90_000)]
    want = [(1, 2, "expired"), (2, 2, "complete"), (3, 1, "complete")]
    for kind, parts in {"one": [rows], "each": [[r] for r in sorted(rows, key=lambda r: r[3])]}.items():
        path = str(tmp_path / kind)
        for part in parts:
            arrivals(spark, path, part, "append")
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
        assert sorted(tuple(r) for r in X.chunk_arrivals(stream).collect()) == want


def test_keyed_state_writes_what_a_batch_changes(spark, tmp_path):
    """Keys that meet several batches, a stop, full versions between: the state of all batches, and small versions for small batches."""
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    start = spark.range(5_000).select(F.col("id").alias("k"), F.lit(100).cast("bigint").alias("n"), F.lit("x" * 50).alias("pad"))
    batches = [[1, 2, 2], [2, 7], [9_000, None, 2], [1], [9_000, None]]

    def add(state, batch):
        fresh = batch.groupBy("k").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("k", "j")
        return state.join(fresh, F.col("k").eqNullSafe(F.col("j")), "full_outer").select(
            F.coalesce("k", "j").alias("k"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("pad", F.lit("new")).alias("pad"))

    def run():
        stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(path)
        return {r.k: r.n for r in X.fold_keyed(stream, "t", start, ["k"], add, base, compact=3).collect()}

    want = dict.fromkeys(range(5_000), 100)
    for i, batch in enumerate(batches):
        spark.createDataFrame([(k,) for k in batch], "k bigint").coalesce(1).write.mode("append").parquet(path)
        for k in batch:
            want[k] = want.get(k, 0) + 1
        if i in (1, 4):
            assert run() == want
    rows = [spark.read.parquet(f"{base}/state/v={v:08d}").count() for v in range(6)]
    assert rows == [5_000, 2, 2, 5_002, 1, 2]


def test_deliveries_need_no_call_per_job(spark, tmp_path):
    """Many jobs, more ticks than a full version is apart and a tick without a time: each tick writes the jobs that fell due."""
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    n = 20_000
    jobs = spark.range(n).select(
        F.col("id").alias("job_id"), F.lit("pending").alias("delivery_status"), F.lit("a").alias("delivery_path"), F.lit(0).alias("attempts"), (F.col("id") * 10).alias("next_attempt"))
    results = spark.range(n).select(F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, 0).alias("sent_from"))
    files = spark.createDataFrame([("a", 10)], "path string, size int")
    for t in (5, 25, None, *range(45, 245, 20)):
        spark.createDataFrame([(t,)], "now bigint").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("now bigint").option("maxFilesPerTrigger", 1).parquet(path)
    got = X.delivery_timer(stream, jobs, results, files, base)
    assert got.count() == n and got.groupBy("delivery_status", "attempts").count().where("attempts > 0").sort("delivery_status").collect() == [("delivered", 1, 12), ("pending", 1, 11)]
    sizes = [spark.read.parquet(f"{base}/state/v={v:08d}").count() for v in range(14)]
    assert sizes == [n, 1, 2, 0, *[2] * 6, n, 2, 2, 2]


def test_uploads_write_the_sessions_of_a_batch(spark, tmp_path, monkeypatch):
    """Open, ending, told and forgotten sessions over full versions: each told once, and a batch writes those that it meets or ends."""
    monkeypatch.setattr(X, "COMPACT", 2)
    path, base = str(tmp_path / "in"), str(tmp_path / "state")
    many = [(s, 0, 3, s % 50) for s in range(1000, 3000)]
    batches = [[(1, 0, 2, 0), (2, 0, 2, 1), (1, 0, 2, 2), *many], [(1, 1, 3, 60), (None, 0, 1, 61), (2, 2, 2, 62)], [(1, 2, 3, 70), (2, 1, 2, 101)], [(4, 0, 1, 300)], [(4, 0, 1, 1001)], [(1, 0, 1, 1002)]]
    for rows in batches:
        arrivals(spark, path, rows, "append")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((tuple(r) for r in X.chunk_arrivals(stream, base, ttl_s=100, mark_ttl_s=1000).collect()), key=str)
    want = [(1, 3, "complete"), (1, 1, "complete"), (None, 1, "complete"), (2, 2, "complete"), (4, 1, "complete"), *[(s, 1, "expired") for s, *_ in many]]
    assert got == sorted(want, key=str)
    sizes = [spark.read.schema("session_id bigint").parquet(f"{base}/state/v={v:08d}").count() for v in range(1, 7)]
    assert sizes == [2002, 2003, 42, 2004, 0, 1923]


def test_snapshots_upserted_out_of_order(spark):
    """A state with marks against older, newer and equal-timed snapshots: as one aggregate over the whole log."""
    from cueloom.operators import state as S

    rows = [(1, 10, 1, "a", 1, True, False), (1, 20, 2, "b", 2, False, False), (2, 5, 3, "c", 3, False, True), (2, 9, 4, "d", 4, True, False),
            (3, 7, 5, "e", 5, True, False), (3, 7, 6, "f", 6, False, True), (None, 1, 7, "g", 7, True, False), (None, 2, 8, "h", 8, False, False), (4, 1, 9, "i", 9, False, False)]
    log = spark.createDataFrame(rows, "job_id bigint, updated bigint, event_id bigint, status string, progress int, cancel boolean, reset boolean")
    args = (["status", "progress"], ["updated", "event_id"])
    want = sorted(map(str, S.latest_job_state(log, *args).drop("snapshots").collect()))
    for first in ("event_id % 2 = 0", "event_id % 2 = 1", "event_id > 4", "event_id < 3"):
        early = S.latest_job_state(log.where(first), *args, marks=True).drop("snapshots")
        assert sorted(map(str, S.job_upsert(early, log.where(f"NOT ({first})"), *args).drop(*S.MARKS).collect())) == want
