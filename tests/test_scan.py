"""Split and plain scans must agree, also with brute force, when one key holds a third of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import cues as C
from cueloom.operators import groups as G
from cueloom.operators.batches import missing_chunks
from cueloom.operators.scan import UNKNOWN, fold, plan_layout, quantiles, scan
from cueloom.operators.timeline import CursorMap, schedule_timeline


@pytest.fixture()
def skewed(spark):
    """Seeded rows; key 0 is hot and many of its rows share a time."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        key = 0 if i % 3 == 0 else rng.randrange(1, 60)
        rows.append((key, i, rng.choice([500, rng.randrange(4000)]), rng.randrange(1, 30)))
    df = spark.createDataFrame(rows, "track_id bigint, cue_id bigint, start_ms bigint, v bigint")
    spark.conf.set("cueloom.hotRows", "40")
    yield rows, df
    spark.conf.unset("cueloom.hotRows")


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_scan_kinds(skewed):
    rows, df = skewed
    layout = plan_layout(df, ["track_id"], ["start_ms", "cue_id"])
    assert layout.split and set(layout.cuts) == {(0,)} and len(layout.cuts[(0,)]) >= 3
    v = F.col("v")
    got = {r.cue_id: r for r in scan(df, layout, {
        "m": ("max_before", v), "s": ("sum_before", v), "n": ("number", None), "p": ("prev", v), "q": ("next", v),
        "l": ("last_before", F.when(v > 20, v)), "c": ("count_all", None), "t": ("sum_all", v), "x": ("max_all", v)}).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        values = [r[3] for r in group]
        for i, r in enumerate(group):
            g, before = got[r[1]], values[:i]
            assert g.m == max(before, default=None) and g.s == sum(before) and g.n == i + 1
            assert g.p == (values[i - 1] if i else None) and g.q == (values[i + 1] if i + 1 < len(values) else None)
            assert g.l == next((x for x in reversed(before) if x > 20), None)
            assert (g.c, g.t, g.x) == (len(values), sum(values), max(values))


def test_fold_resumes_across_blocks(skewed):
    rows, df = skewed
    layout = plan_layout(df, ["track_id"], ["start_ms", "cue_id"])

    def step(state, row):
        first, used = state or (row[0], 0)
        if used and used + row[1] > 70:
            first, used = row[0], 0
        return (first, used + row[1]), (first,)

    got = {r.cue_id: r.first for r in fold(df, layout, ["cue_id", "v"], step, [("first", "bigint")]).collect()}
    for group in by_key(rows).values():
        state = None
        for r in group:
            state, (first,) = step(state, (r[1], r[3]))
            assert got[r[1]] == first


def test_quantiles(skewed):
    import numpy as np

    rows, df = skewed
    for r in quantiles(df, ["track_id"], "v", {"a": 0.7, "b": 0.5, "c": 0.15}).collect():
        values = [x[3] for x in rows if x[0] == r.track_id]
        assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(values, [0.7, 0.5, 0.15])), abs=0)


def test_groups_cover_every_cue(skewed):
    rows, df = skewed
    cues = df.withColumn("end_ms", F.col("start_ms") + 100).withColumn("text", F.repeat(F.lit("x"), F.col("v").cast("int")))
    grouped = G.source_groups(cues, layout=plan_layout(cues, ["track_id"], ["start_ms", "cue_id"]))
    ids = [i for r in grouped.collect() for i in r.source_ids]
    assert sorted(ids) == sorted(r[1] for r in rows)
    assert C.validate_cues(cues).count() == len(rows)


def _follow(rows, cursor, margin=60):
    for lead, limit, length in rows:
        if length is not None:
            begin = lead if cursor is None else max(lead, cursor + margin)
            cursor = begin + _played(length, limit - begin)
    return cursor


def _played(length, room):
    room = max(1, room)
    return length if length - room <= 15 else math.ceil(length / min(length / room, 1.65))


@pytest.mark.parametrize("dense", [0.3, 0.9, 1.4, 3.0])
def test_cursor_map_is_the_block(dense):
    rng = random.Random(round(dense * 10))
    for _ in range(200):
        t, rows = rng.randrange(5000), []
        for _ in range(rng.randrange(40)):
            span = rng.randrange(1, 3000)
            length = None if rng.random() < 0.1 else max(1, int(span * dense * rng.uniform(0.3, 2)))
            rows.append((max(0, t - rng.choice([0, 350])), t + span - rng.randrange(100), length))
            t += span + rng.choice([0, 0, 50, 900])
        block = CursorMap(_played, 60, 1.65)
        for row in rows:
            block.feed(row)
        for cursor in [None, *(rng.randrange(-100, t + 20_000) for _ in range(30))]:
            assert block.leave(block.closed(), cursor) == _follow(rows, cursor)


def test_cursors_out_of_reach_are_unknown():
    block = CursorMap(_played, 60, 1.65)
    block.MOST = 10
    rows = [(1000 * i, 1000 * i + 900, 850) for i in range(200)]
    for row in rows:
        block.feed(row)
    assert block.leave(block.closed(), 500) == _follow(rows, 500) and block.leave(block.closed(), 10**9) == UNKNOWN


def _jobs(spark, run):
    """Spark jobs that ``run`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = run()
        return out, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["dense timeline", "fixed batches", "sizes"])
def test_hot_folds_take_few_jobs(spark, kind):
    """20 blocks that never fall into step by themselves: as exact as unsplit, and the blocks don't wait for each other."""
    rng = random.Random(3)
    rows = [(1, i, 1000 * i, 1000 * i + 900, 2600 if kind == "dense timeline" else 0, "x" * (10 if kind == "fixed batches" else rng.randrange(1, 90))) for i in range(2000)]
    df = spark.createDataFrame(rows, "track_id bigint, cue_id bigint, start_ms bigint, end_ms bigint, raw_ms bigint, text string").withColumn("index", F.col("cue_id"))

    def run():
        if kind == "dense timeline":
            return schedule_timeline(df)
        return C.batch_by_size(df, 4500 if kind == "fixed batches" else 500, 50)

    plain = sorted(map(str, run().collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("cueloom.hotRows", "100")
    try:
        out, jobs = _jobs(spark, run)
        assert jobs < 20
        assert sorted(map(str, out.collect())) == plain
    finally:
        spark.conf.unset("cueloom.hotRows")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_group_over_whole_blocks(spark):
    """A group that swallows blocks leaves nothing to fall into step with: those blocks are run one after the other."""
    df = spark.createDataFrame([(1, i, 1) for i in range(1500)], "track_id bigint, cue_id bigint, v bigint")
    spark.conf.set("cueloom.hotRows", "300")

    def step(state, row):
        first, used = state or (row[0], 0)
        if used + row[1] > 700:
            first, used = row[0], 0
        return (first, used + row[1]), (first,)

    try:
        layout = plan_layout(df, ["track_id"], ["cue_id"])
        assert len(layout.cuts[(1,)]) >= 4
        got = {r.cue_id: r.first for r in fold(df, layout, ["cue_id", "v"], step, [("first", "bigint")]).collect()}
    finally:
        spark.conf.unset("cueloom.hotRows")
    assert got == {i: i // 700 * 700 for i in range(1500)}


def test_fold_above_a_join_that_becomes_a_broadcast(spark):
    """While running, the join is found small enough to be broadcast; a track's rows still come to one task, in order."""
    rows = [(i % 20, i, i * 40, i * 40 + 70 + i % 1000, "ab"[i % 7 // 4]) for i in range(4000)]
    local = spark.createDataFrame(rows, "track_id bigint, cue_id bigint, start_ms bigint, end_ms bigint, text string").withColumn("window_no", F.lit(0))
    durations = local.groupBy("track_id").agg(F.max("end_ms").alias("duration_ms"))
    want, state = set(), {}
    for track, cue, start, end, text in rows:
        first, until, said = state.get(track, (None, -1, None))
        if start < until and text == said:
            state[track] = first, max(until, end), said
        elif start < until and end <= until:
            want.add((track, cue, True))
        else:
            state[track] = cue, end, text
            want.add((track, cue, False))
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in confs.items():
        spark.conf.set(name, value)
    try:
        got = [(r.track_id, r.cue_first, r.conflict) for r in G.stitch_windows(local, durations).collect()]
    finally:
        for name in confs:
            spark.conf.unset(name)
    assert len(got) == len(want) and set(got) == want


def test_more_rows_make_more_tasks(spark):
    """Sessions of 800 chunks in all, dealt to tasks of 50 rows each, are as complete as in the session's four partitions."""
    rows = [(i // 8, i % 8, 100) for i in range(800) if i % 7 and i % 5]
    chunks = spark.createDataFrame(rows, "session_id bigint, chunk_index bigint, bytes bigint")
    sessions = spark.createDataFrame([(i, 8, 100, 800) for i in range(100)], "session_id bigint, total_chunks bigint, chunk_size bigint, total_size bigint")
    plain = sorted(map(str, missing_chunks(chunks, sessions).collect()))
    spark.conf.set("cueloom.taskRows", "50")
    try:
        out = missing_chunks(chunks, sessions)
        assert out.rdd.getNumPartitions() >= len(rows) // 50
        assert sorted(map(str, out.collect())) == plain
    finally:
        spark.conf.unset("cueloom.taskRows")


def test_more_states_make_more_tasks(spark):
    """The rows of a fold go to as many tasks as their number asks for, and merged states stay the same."""
    rows = [(i % 40, i, i * 300, i * 300 + 280, f"line {i % 40} {i // 200}", "dialogue") for i in range(1000)]
    states = spark.createDataFrame(rows, "track_id bigint, state_no bigint, start_ms bigint, end_ms bigint, text string, kind string")
    plain = sorted(map(str, G.merge_ocr_states(states).collect()))
    spark.conf.set("cueloom.taskRows", "50")
    try:
        layout = plan_layout(states, ["track_id"], ["state_no"])
        led = fold(states, layout, ["state_no"], lambda state, row: (row[0], (state,)), [("before", "bigint")])
        assert layout.rows == 1000 and led.rdd.getNumPartitions() == 20
        assert sorted(map(str, G.merge_ocr_states(states).collect())) == plain
    finally:
        spark.conf.unset("cueloom.taskRows")


@pytest.mark.parametrize("partitions", ["64", "20"])
def test_the_sessions_partitions_are_not_put_together(spark, partitions):
    """Rows go to tasks by their number also where the session has partitions enough, or as many as needed above a join on the same key."""
    rows = [(i % 40, i, i * 300, i * 300 + 280, f"line {i % 40} {i // 200}", "dialogue") for i in range(1000)]
    states = spark.createDataFrame(rows, "track_id bigint, state_no bigint, start_ms bigint, end_ms bigint, text string, kind string")
    plain = sorted(map(str, G.merge_ocr_states(states).collect()))
    confs = {"cueloom.taskRows": "50", "spark.sql.shuffle.partitions": partitions, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in confs}
    for name, value in confs.items():
        spark.conf.set(name, value)
    try:
        joined = states.join(states.groupBy("track_id").agg(F.max("end_ms").alias("last")), "track_id")
        layout = plan_layout(joined, ["track_id"], ["state_no"])
        led = fold(joined, layout, ["state_no"], lambda state, row: (row[0], (state,)), [("before", "bigint")])
        numbered = scan(joined, layout, {"n": ("number", None)})
        assert led.rdd.getNumPartitions() >= 20 and numbered.rdd.getNumPartitions() >= 20
        assert sorted(map(str, G.merge_ocr_states(states).collect())) == plain
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
