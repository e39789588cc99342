"""Cue tracks: filters, validation, windows, folds, intervals and subtitle output."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    BOXES, CUES, PHRASES, SQ, TERM, WORDS, big, query, sql_quantile, sql_round, with_,
)
from catalog.scalars import STAMP, pair_groups
from cueloom.adapters import boxes_from_lineitem, cues_from_events, phrases_from_conversations, table
from cueloom.functions.text import word_count
from cueloom.operators import boxes as B
from cueloom.operators import cues as C
from cueloom.operators import groups as G
from cueloom.operators import intervals as I
from cueloom.operators import signals as S
from cueloom.operators import timeline as L
from cueloom.operators.scan import at_most, plan_layout, scan
from cueloom.sources import sinks

ERRORS = """
  list_filter([CASE WHEN end_ms <= start_ms THEN 'end_not_after_start' END,
    CASE WHEN start_ms < latest THEN 'overlaps_earlier' END,
    CASE WHEN end_ms > 40000000 + 1000 THEN 'past_duration' END], lambda x: x IS NOT NULL)"""
CHECKED = f"""seen AS (SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM cues),
checked AS (SELECT track_id, cue_id, {ERRORS} AS errors FROM seen)"""


def _checked(spark, sf_dir):
    cues = cues_from_events(spark, sf_dir).withColumn("duration_ms", F.lit(40_000_000))
    return C.validate_cues(cues, "duration_ms")


@query("val1_validate_cues", with_(CUES, CHECKED) + "SELECT track_id, cue_id, array_to_string(errors, ',') AS errors FROM checked")
def _validate(spark, sf_dir):
    return _checked(spark, sf_dir).select("track_id", "cue_id", F.array_join("errors", ",").alias("errors"))


@query("val1_track_validity", with_(CUES, CHECKED) + """SELECT c_custkey AS track_id, count(cue_id) AS cues, CAST(coalesce(sum(len(errors)), 0) AS BIGINT) AS n_errors,
    CASE WHEN count(cue_id) = 0 THEN 'no_entry' ELSE arg_min(errors[1], cue_id) FILTER (len(errors) > 0) END AS first_error,
    count(cue_id) > 0 AND sum(len(errors)) = 0 AS valid FROM customer LEFT JOIN checked ON track_id = c_custkey GROUP BY c_custkey""")
def _validity(spark, sf_dir):
    """Customers stand for the expected tracks; many have no cue at all."""
    tracks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"))
    return C.track_validity(_checked(spark, sf_dir), tracks)


@query("flt1_shift_cues", with_(CUES) + """, m AS (SELECT track_id, cue_id, text, track_id % 3 > 0 AS act, start_ms, end_ms, (track_id % 3) * 3000000 AS s FROM cues),
  k AS (SELECT track_id, cue_id, text, CASE WHEN act THEN greatest(0, start_ms - s) ELSE start_ms END AS start_ms,
    CASE WHEN act THEN end_ms - s ELSE end_ms END AS end_ms FROM m WHERE NOT act OR end_ms - s > 80)
  SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY cue_id) AS cue_id, text, start_ms, end_ms FROM k""")
def _shift(spark, sf_dir):
    cues = cues_from_events(spark, sf_dir)
    shifts = cues.select("track_id").distinct().withColumn("shift_ms", F.col("track_id") % 3 * 3_000_000)
    return C.shift_cues(cues, shifts)


@query("win1_word_budget", with_(PHRASES) + f""", a AS (SELECT track_id, cue_id, coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY cue_id), end_ms + 2000) - start_ms AS free FROM cues),
  b AS (SELECT track_id, cue_id, greatest(0.8::DOUBLE, {sql_round('free / 1000.0::DOUBLE', 1)}) AS available_s FROM a)
  SELECT track_id, cue_id, available_s, greatest(2, CAST(trunc(available_s * 2.6::DOUBLE) AS INTEGER)) AS word_budget FROM b""")
def _budget(spark, sf_dir):
    return C.word_budget(phrases_from_conversations(spark, sf_dir), "en").select("track_id", "cue_id", "available_s", "word_budget")


@query("win2_batch_by_count", with_(PHRASES) + "SELECT track_id, (cue_id - 1) // 15 AS batch_no, count(*) AS lines FROM cues GROUP BY ALL")
def _count_batches(spark, sf_dir):
    return C.batch_by_count(phrases_from_conversations(spark, sf_dir)).groupBy("track_id", "batch_no").agg(F.count(F.lit(1)).alias("lines"))


@query("win3_batch_by_size", with_(PHRASES, """r AS (
    SELECT track_id, cue_id, cue_id AS first, length(text) + 1 AS used, 1 AS n FROM cues WHERE cue_id = 1
    UNION ALL
    SELECT track_id, cue_id, CASE WHEN cut THEN cue_id ELSE first END, CASE WHEN cut THEN chars ELSE used + chars END, CASE WHEN cut THEN 1 ELSE n + 1 END
    FROM (SELECT c.track_id, c.cue_id, r.first, r.used, r.n, length(c.text) + 1 AS chars, r.used + length(c.text) + 1 > 450 OR r.n >= 12 AS cut
      FROM r JOIN cues c ON c.track_id = r.track_id AND c.cue_id = r.cue_id + 1) x)""", recursive=True) +
    "SELECT track_id, first AS batch_first, count(*) AS lines, CAST(max(used) AS BIGINT) AS chars FROM r GROUP BY ALL")
def _size_batches(spark, sf_dir):
    rows = C.batch_by_size(phrases_from_conversations(spark, sf_dir), 450, 12)
    return rows.groupBy("track_id", "batch_first").agg(F.count(F.lit(1)).alias("lines"), big(F.sum(F.length("text") + 1)).alias("chars"))


def merged_sql(source: str, gap: int, ps: int, pe: int, name: str = "merged") -> str:
    return f"""{name}_p AS (SELECT track_id, cue_id, greatest(0, start_ms - {ps}) AS s, greatest(greatest(0, start_ms - {ps}) + 100, end_ms + {pe}) AS e FROM {source}),
{name}_r AS (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_p),
{name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY s, cue_id ROWS UNBOUNDED PRECEDING) AS n FROM {name}_r),
{name} AS (SELECT track_id, CAST(n AS BIGINT) AS interval_no, min(s) AS s_ms, max(e) AS e_ms, count(*) AS cues FROM {name}_i GROUP BY track_id, n)"""


@query("win4_merge_intervals", with_(CUES, merged_sql("cues", 1200, 150, 180)) + "SELECT *, s_ms / 1000.0::DOUBLE AS s, e_ms / 1000.0::DOUBLE AS e FROM merged")
def merged_seconds(spark, sf_dir):
    return I.in_seconds(I.merge_intervals(cues_from_events(spark, sf_dir)))


@query("snk4_enable_expr", with_(CUES, merged_sql("cues", 1200, 150, 180)) + """SELECT track_id, CAST(0 AS INTEGER) AS part, string_agg('between(t,' || s_ms // 1000 || '.' || printf('%03d', s_ms % 1000)
    || ',' || e_ms // 1000 || '.' || printf('%03d', e_ms % 1000) || ')', '+' ORDER BY interval_no) AS expr FROM merged GROUP BY track_id""")
def _enable(spark, sf_dir):
    return I.enable_expr(I.merge_intervals(cues_from_events(spark, sf_dir)))


@query("udf5_interval_sets", with_(CUES, merged_sql("cues", 1200, 150, 180)) + "SELECT track_id, CAST(0 AS INTEGER) AS part, string_agg(s_ms || '-' || e_ms, ' ' ORDER BY s_ms) AS intervals FROM merged GROUP BY track_id")
def _sets(spark, sf_dir):
    sets = I.interval_sets(I.merge_intervals(cues_from_events(spark, sf_dir)))
    return sets.select("track_id", "part", F.array_join(F.transform("intervals", lambda x: F.concat_ws("-", x["s_ms"].cast("string"), x["e_ms"].cast("string"))), " ").alias("intervals"))


# Views and clicks form one set, all other events the other.
_BASE = "WHERE text IN ('view', 'click')"
_EXTRA = "WHERE text NOT IN ('view', 'click')"


@query("set1_union_intervals", with_(CUES, f"va AS (SELECT * FROM cues {_BASE})", f"pa AS (SELECT * FROM cues {_EXTRA})",
        merged_sql("va", 1200, 150, 180, "a"), merged_sql("pa", 500, 100, 150, "b"), """u AS (SELECT track_id, s_ms AS s, e_ms AS e FROM a UNION ALL SELECT track_id, s_ms, e_ms FROM b),
    r AS (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM r)""") +
    "SELECT track_id, CAST(n AS BIGINT) AS interval_no, min(s) AS s_ms, max(e) AS e_ms, count(*) AS cues FROM i GROUP BY track_id, n")
def _union(spark, sf_dir):
    cues = cues_from_events(spark, sf_dir)
    a = I.merge_intervals(cues.where(F.col("text").isin("view", "click")))
    b = I.merge_intervals(cues.where(~F.col("text").isin("view", "click")), 500, 100, 150)
    return I.union_intervals(a, b)


def frames_and_intervals(spark, sf_dir):
    """Purchases make the intervals (some users have none), all other events are frames."""
    cues = cues_from_events(spark, sf_dir)
    plan_layout(cues, ["track_id"], ["start_ms", "cue_id"])  # counted once, for both sides
    frames = cues.where(F.col("text") != "purchase").select("track_id", F.col("cue_id").alias("frame_no"), F.col("start_ms").alias("t_ms"))
    shown = at_most(cues.where((F.col("text") == "purchase") & (F.col("track_id") % 7 > 0)), cues)
    return at_most(frames, cues), I.merge_intervals(shown)


FRAMES = f"""fr AS (SELECT track_id, cue_id AS frame_no, start_ms AS t_ms FROM cues WHERE text <> 'purchase'),
pu AS (SELECT * FROM cues WHERE text = 'purchase' AND track_id % 7 > 0),
{merged_sql('pu', 1200, 150, 180, 'iv')}"""
INSIDE = "EXISTS (SELECT 1 FROM iv WHERE iv.track_id = fr.track_id AND s_ms <= t_ms AND e_ms >= t_ms)"


@query("jn9_frames_in_intervals", with_(CUES, FRAMES) + f"SELECT fr.*, {INSIDE} OR NOT EXISTS (SELECT 1 FROM iv WHERE iv.track_id = fr.track_id) AS has_sub FROM fr")
def _inside(spark, sf_dir):
    return I.frames_in_intervals(*frames_and_intervals(spark, sf_dir))


@query("jn10_frames_outside", with_(CUES, FRAMES) + f"SELECT fr.* FROM fr WHERE NOT {INSIDE}")
def _outside(spark, sf_dir):
    return I.frames_outside(*frames_and_intervals(spark, sf_dir))


@query("jn11_nearby_references", with_(CUES, FRAMES) + """SELECT fr.*, (SELECT count(*) FROM iv WHERE iv.track_id = fr.track_id AND e_ms < t_ms - 60000) AS lo,
    (SELECT count(*) FROM iv WHERE iv.track_id = fr.track_id AND s_ms <= t_ms + 60000) AS hi FROM fr""")
def _nearby(spark, sf_dir):
    return I.nearby_references(*frames_and_intervals(spark, sf_dir), window_ms=60_000)


# ----------------------------------------------------------------------------- signals


def metrics(spark, sf_dir):
    return cues_from_events(spark, sf_dir).select(
        "track_id", F.col("text").alias("signal"), F.col("start_ms").alias("t_ms"), F.col("cue_id").alias("sample_no"),
        ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("value"))


PEAKS = """me AS (SELECT track_id, text AS signal, start_ms AS t_ms, cue_id AS sample_no, CAST(CAST((end_ms - start_ms) / 1000.0::DOUBLE AS FLOAT) AS DOUBLE) AS value FROM cues),
q AS (SELECT track_id, signal, """ + sql_quantile('value', 0.7) + """ AS threshold, count(*) AS n FROM me GROUP BY ALL),
w AS (SELECT *, lag(value) OVER (PARTITION BY track_id, signal ORDER BY t_ms, sample_no) AS pv, lead(value) OVER (PARTITION BY track_id, signal ORDER BY t_ms, sample_no) AS nx FROM me),
pk AS (SELECT w.track_id, w.signal, t_ms, sample_no, value, threshold FROM w JOIN q ON q.track_id = w.track_id AND q.signal = w.signal
  WHERE n >= 3 AND value >= threshold AND value >= pv AND value > nx)"""


@query("win5_peaks", with_(CUES, PEAKS) + f"SELECT track_id, signal, t_ms, sample_no, value, {sql_round('threshold', 6)} AS threshold FROM pk")
def _peaks(spark, sf_dir):
    from cueloom.functions.values import py_round

    return S.peaks(metrics(spark, sf_dir)).withColumn("threshold", py_round("threshold", 6))


@query("win6_nms_clusters", with_(CUES, PEAKS, """g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY track_id ORDER BY t_ms, sample_no) AS d FROM pk),
    c AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 1200000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_ms, sample_no ROWS UNBOUNDED PRECEDING) AS n,
      greatest(value / greatest(threshold, 1e-9::DOUBLE), 1.0::DOUBLE) AS wt FROM g)""") +
    f"SELECT track_id, CAST(n AS BIGINT) AS cluster_no, {sql_round('sum(t_ms / 1000.0::DOUBLE * wt) / sum(wt)', 3)} AS t, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, count(*) AS peaks FROM c GROUP BY track_id, n")
def clusters(spark, sf_dir):
    out = S.nms_clusters(S.peaks(metrics(spark, sf_dir)), 1_200_000)
    return out.withColumn("signals", F.array_join("signals", ","))


@query("win7_guard_intervals", with_(CUES, """t AS (SELECT track_id, 43200000 AS total FROM cues GROUP BY track_id),
    p AS (SELECT DISTINCT track_id, start_ms AS p FROM cues WHERE start_ms > 0 AND start_ms < 43200000 UNION SELECT track_id, 0 FROM t UNION SELECT track_id, total FROM t),
    n AS (SELECT track_id, p, lead(p) OVER (PARTITION BY track_id ORDER BY p) AS r FROM p),
    k AS (SELECT track_id, p, r, unnest(range(0, CAST(ceil((r - p) / 600000.0::DOUBLE) AS BIGINT))) AS k FROM n WHERE r IS NOT NULL),
    o AS (SELECT track_id, p + k * 600000 AS start_ms, least(r, p + (k + 1) * 600000) AS end_ms FROM k)""") +
    """SELECT *, CAST(round_even((start_ms / 1000.0::DOUBLE + end_ms / 1000.0::DOUBLE) * 500, 0) AS BIGINT) AS sample_ms FROM o
    WHERE end_ms / 1000.0::DOUBLE - start_ms / 1000.0::DOUBLE >= 0.16::DOUBLE""")
def _guard(spark, sf_dir):
    cues = cues_from_events(spark, sf_dir)
    tracks = cues.select("track_id").distinct().withColumn("duration_s", F.lit(43200.0))
    return S.guard_intervals(cues.select("track_id", (F.col("start_ms") / F.lit(1000.0)).alias("t")), tracks, 600.0)


def pattern_frames(spark, sf_dir):
    """Events as frames: errors show nothing, other types are the pattern seen."""
    kind = F.when(F.col("text").isin("view", "click"), 1).when(F.col("text") == "purchase", 2).when(F.col("text") == "signup", 3)
    return cues_from_events(spark, sf_dir).select(
        "track_id", F.col("cue_id").alias("frame_no"), F.col("start_ms").alias("t_ms"), kind.cast("bigint").alias("pattern_id"),
        (F.col("text") == "purchase").alias("known"))


RUNS = """f AS (SELECT track_id, cue_id, start_ms AS t, CASE WHEN text IN ('view', 'click') THEN 1 WHEN text = 'purchase' THEN 2 WHEN text = 'signup' THEN 3 END AS pat, text = 'purchase' AS known FROM cues),
w AS (SELECT *, lag(pat) OVER o AS pv, lead(t) OVER o AS nt FROM f WINDOW o AS (PARTITION BY track_id ORDER BY cue_id)),
i AS (SELECT *, sum(CASE WHEN pat IS NOT NULL AND (pv IS NULL OR pv <> pat) THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY cue_id ROWS UNBOUNDED PRECEDING) AS n FROM w),
runs AS (SELECT track_id, CAST(n AS BIGINT) AS run_no, min(t) AS start_ms, max(coalesce(nt, t + 40)) AS end_ms, count(*) AS frames, bool_or(NOT known) AS has_unknown
  FROM i WHERE pat IS NOT NULL GROUP BY track_id, n HAVING bool_or(known) OR count(*) >= 3)"""


@query("win18_confirm_runs", with_(CUES, RUNS) + "SELECT * FROM runs")
def _runs(spark, sf_dir):
    return S.confirm_runs(pattern_frames(spark, sf_dir))


@query("agg13_guard_report", with_(CUES, FRAMES) + f"""SELECT track_id, count(*) FILTER (inside OR frame_no % 3 = 0) AS inpainted, count(*) FILTER (frame_no % 3 = 0) AS recovered,
    count(*) FILTER (frame_no % 2 = 0 AND NOT inside) AS outside_track FROM (SELECT fr.*, {INSIDE} AS inside FROM fr) x GROUP BY track_id""")
def _guard_report(spark, sf_dir):
    frames, intervals = frames_and_intervals(spark, sf_dir)
    rows = I.covered(frames, intervals).withColumnRenamed("covered", "has_sub")
    rows = rows.withColumn("recovered", F.col("frame_no") % 3 == 0).withColumn("pattern_id", F.when(F.col("frame_no") % 2 == 0, F.col("frame_no")))
    return S.guard_report(rows)


@query("agg19_template_coverage", with_(CUES) + """SELECT track_id, count(*) AS sampled, count(*) FILTER (text <> 'error') AS templates, count(*) FILTER (text = 'error') AS missing,
    avg(CASE WHEN text <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage FROM cues GROUP BY track_id""")
def _coverage_share(spark, sf_dir):
    return S.template_coverage(cues_from_events(spark, sf_dir).withColumn("usable", F.col("text") != "error"))


def frame_diffs(spark, sf_dir):
    """Lines of an order as frame differences ten frames apart; long orders reach past the opening."""
    rows = table(spark, sf_dir, "lineitem")
    layout = plan_layout(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_partkey"])
    keys = rows.select("l_suppkey", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax")
    no = scan(keys, layout.on(order=["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax"]) if not layout.split else plan_layout(
        keys, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax"]), {"frame_no": ("number", None)})
    # Most frames are nearly still; every ninth line number makes a stir.
    d = F.when(F.col("l_orderkey") % 9 == 0, F.col("l_quantity")).otherwise(F.lit(1.0))
    corr = F.when(F.col("l_orderkey") % 9 == 0, F.lit(0.9)).otherwise(F.lit(0.99))
    return no.select(F.col("l_suppkey").alias("track_id"), "frame_no", (F.col("frame_no") * 4 / F.lit(100.0)).alias("t"), d.alias("d"), corr.alias("corr"))


@query("win19_intro_cut", f"""WITH n AS (SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, l_tax) AS fno, l_orderkey % 9 = 0 AS stir, l_quantity FROM lineitem),
    f AS (SELECT track_id, fno, fno * 4 / 100.0::DOUBLE AS t, CASE WHEN stir THEN l_quantity ELSE 1.0 END AS d, NOT stir AS still FROM n WHERE fno * 4 / 100.0::DOUBLE <= 4.0),
    g AS (SELECT *, avg(d) OVER (PARTITION BY track_id) AS m, stddev_pop(d) OVER (PARTITION BY track_id) AS sd,
      fno - 1 - coalesce(max(CASE WHEN NOT still THEN fno END) OVER (PARTITION BY track_id ORDER BY fno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM f)
    SELECT track_id, {sql_round("coalesce(min(CASE WHEN NOT still AND d > greatest(14.0::DOUBLE, m + 2 * sd) AND (run >= 6 OR t BETWEEN 0.4 AND 3.5) AND t BETWEEN 0.35 AND 4.0 THEN t END), 0)", 2)} AS cut_s FROM g GROUP BY track_id""")
def _intro(spark, sf_dir):
    return S.intro_cut(frame_diffs(spark, sf_dir))


def samples(spark, sf_dir):
    """Quantities of a part's lines as audio samples in windows of eight."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track_id"), "l_orderkey", "l_linenumber", "l_partkey", big(F.floor(F.col("l_extendedprice") / 50)).alias("v"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "v"]
    return scan(rows, plan_layout(rows, ["track_id"], order), {"sample_no": ("number", None)}).select("track_id", (F.col("sample_no") - 1).alias("sample_no"), "v")


RMS = """s AS (SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / 50)) - 1 AS n, CAST(floor(l_extendedprice / 50) AS BIGINT) AS v FROM lineitem),
e AS (SELECT track_id, n // 8 AS window_no, sqrt(avg(CAST(v AS DOUBLE) * v)) AS rms FROM s GROUP BY ALL HAVING count(*) = 8)"""


@query("agg9_rms_windows", with_(RMS) + f"SELECT track_id, window_no, {sql_round('rms', 6)} AS rms FROM e")
def _rms(spark, sf_dir):
    from cueloom.functions.values import py_round

    return S.rms_windows(samples(spark, sf_dir), 8).withColumn("rms", py_round("rms", 6))


@query("win20_speech_onset", with_(RMS, """b AS (SELECT track_id, max(rms) AS mx, quantile_cont(rms, 0.5) FILTER (window_no < 8) AS base FROM e GROUP BY track_id)""") +
    f"""SELECT e.track_id, {sql_round("min(CASE WHEN mx >= 350 AND window_no >= 4 AND rms > greatest(600.0::DOUBLE, base * 2.2::DOUBLE) THEN window_no END) * 0.05::DOUBLE", 2)} AS first_speech
    FROM e JOIN b ON e.track_id = b.track_id GROUP BY e.track_id""")
def _onset(spark, sf_dir):
    return S.speech_onset(S.rms_windows(samples(spark, sf_dir), 8))


_MA, _MR = (sql_quantile("l_tax", 0.5, f"l_returnflag = '{flag}' OR (l_returnflag = 'N' AND l_suppkey % 2 = {odd})") for flag, odd in (("A", 1), ("R", 0)))


@query("agg14_paired_benchmark", f"""WITH r AS (SELECT l_shipmode AS c, l_tax, l_returnflag, l_suppkey FROM (SELECT *, l_linenumber AS l_shipmode FROM lineitem) x)
    SELECT CAST(c AS INTEGER) AS "case", {sql_round(_MA, 6)} AS baseline_seconds, {sql_round(_MR, 6)} AS candidate_seconds,
    {sql_round(f"{_MA} / greatest({_MR}, 1e-9::DOUBLE)", 3)} AS speedup FROM r GROUP BY c""")
def _paired(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("case"), F.when(F.col("l_returnflag") == "A", "baseline").when(F.col("l_returnflag") == "R", "candidate").when(
            F.col("l_suppkey") % 2 == 1, "baseline").otherwise("candidate").alias("variant"),
        F.col("l_tax").alias("seconds"))
    return S.paired_benchmark(rows)


# -------------------------------------------------------------------------- grouping

CLOSED = "right({0}, 1) IN ('。', '！', '？', '!', '?', '；', ';')"


@query("win8_source_groups", with_(PHRASES, f"""r AS (
    SELECT track_id, cue_id, cue_id AS g, start_ms AS gs, end_ms AS ge, text AS t FROM cues WHERE cue_id = 1
    UNION ALL
    SELECT track_id, cue_id, CASE WHEN m THEN g ELSE cue_id END, CASE WHEN m THEN gs ELSE start_ms END, end_ms, CASE WHEN m THEN t || text ELSE text END
    FROM (SELECT c.*, r.g, r.gs, r.t, c.start_ms - r.ge BETWEEN 0 AND 350 AND c.end_ms - r.gs <= 6000 AND length(r.t || c.text) <= 52 AND NOT {CLOSED.format('r.t')} AS m
      FROM r JOIN cues c ON c.track_id = r.track_id AND c.cue_id = r.cue_id + 1) x)""", recursive=True) +
    """SELECT track_id, g AS group_no, string_agg(CAST(cue_id AS VARCHAR), ',' ORDER BY cue_id) AS ids, arg_max(t, cue_id) AS source_text, min(gs) AS start_ms, arg_max(ge, cue_id) AS end_ms FROM r GROUP BY track_id, g""")
def _source_groups(spark, sf_dir):
    out = G.source_groups(phrases_from_conversations(spark, sf_dir))
    return out.select("track_id", "group_no", F.array_join("source_ids", ",").alias("ids"), "source_text", "start_ms", "end_ms")


def phrase_groups(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    return cues.select("track_id", F.col("cue_id").alias("group_no"), F.array("cue_id").alias("source_ids"), F.col("text").alias("source_text"),
                       F.col("text").alias("translation"), "speaker", "start_ms", "end_ms")


def turn_groups(spark, sf_dir):
    """A group per spoken turn with its whole text."""
    cues = phrases_from_conversations(spark, sf_dir)
    return cues.groupBy("track_id", F.col("turn").alias("group_no"), "speaker").agg(
        F.array_sort(F.collect_list("cue_id")).alias("source_ids"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "text"))), lambda e: e["text"]), " ").alias("translation"),
    ).withColumn("source_text", F.col("translation"))


_SENT = ("list_filter(list_transform(string_split(regexp_replace({0}, '(" + TERM + ")( |$)', '\\1' || chr(57344), 'g'), chr(57344)), lambda x: trim(x)), lambda x: x <> '')")


@query("win9_split_sentences", with_(PHRASES, f"""tu AS (SELECT track_id, turn AS group_no, speaker, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n_ids, string_agg(text, ' ' ORDER BY cue_id) AS t FROM cues GROUP BY ALL),
    se AS (SELECT *, {_SENT.format('t')} AS ss FROM tu),
    ex AS (SELECT track_id, group_no, s, e, len(ss) AS n, generate_subscripts(ss, 1) - 1 AS part, unnest(ss) AS sentence FROM se),
    we AS (SELECT *, greatest(1, len({WORDS.format('sentence')})) AS wt FROM ex),
    sh AS (SELECT *, greatest(1, CAST(round_even((e - s) * wt / (sum(wt) OVER (PARTITION BY track_id, group_no))::DOUBLE, 0) AS BIGINT)) AS share FROM we),
    cu AS (SELECT *, s + coalesce(sum(share) OVER (PARTITION BY track_id, group_no ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM sh)""") +
    """SELECT track_id, group_no, CAST(part AS BIGINT) AS part, sentence AS translation, CAST(st AS BIGINT) AS start_ms,
    CAST(CASE WHEN n = 1 THEN e WHEN part = n - 1 THEN greatest(st + 1, e) ELSE st + share END AS BIGINT) AS end_ms FROM cu""")
def _sentences(spark, sf_dir):
    return G.split_sentences_timed(turn_groups(spark, sf_dir)).select("track_id", "group_no", "part", "translation", "start_ms", "end_ms")


@query("win10_partition_ids", with_(PHRASES, f"""tu AS (SELECT track_id, turn AS group_no, count(*) AS n_ids, min(cue_id) AS first_id, string_agg(text, ' ' ORDER BY cue_id) AS t FROM cues GROUP BY ALL),
    se AS (SELECT track_id, group_no, n_ids, first_id, list_transform({_SENT.format('t')}, lambda x: greatest(1, len(regexp_split_to_array(x, '\\s+')))) AS ws FROM tu),
    r AS (SELECT track_id, group_no, n_ids, ws, first_id, 0 AS i, 0 AS pos, CAST(0 AS BIGINT) AS take, list_sum(ws)::BIGINT AS weight FROM se
      UNION ALL SELECT track_id, group_no, n_ids, ws, first_id, i + 1, CAST(at2 AS INTEGER), CASE WHEN n_ids < len(ws) THEN CASE WHEN i < n_ids THEN 1 ELSE 0 END
          WHEN i = len(ws) - 1 THEN n_ids - at2 ELSE least(greatest(1, CAST(round_even((n_ids - at2) * ws[i + 1] / greatest(1, weight)::DOUBLE, 0) AS BIGINT)), n_ids - at2 - (len(ws) - i - 1)) END, weight - ws[i + 1]
        FROM (SELECT *, pos + take AS at2 FROM r) y WHERE i < len(ws))""", recursive=True) +
    "SELECT track_id, group_no, CAST(i - 1 AS BIGINT) AS part, CAST(take AS INTEGER) AS n_ids, CASE WHEN take > 0 THEN first_id + pos END AS first_id FROM r WHERE i > 0")
def _ids(spark, sf_dir):
    out = G.split_sentences_timed(turn_groups(spark, sf_dir))
    return out.select("track_id", "group_no", "part", F.size("source_ids").alias("n_ids"), F.get("source_ids", F.lit(0)).alias("first_id"))


JOINT = "regexp_replace(t || ' ' || text, '^\\s+|\\s+$', '', 'g')"
_ENDED = f"regexp_matches(r.t, '{TERM}$')"


def _fragments_sql(ended_rule: bool) -> str:
    # One sentence: no terminal followed by a blank inside the joint text.
    inner = f"regexp_matches(r.t || ' ' || c.text, '{TERM} ')"
    stop = f"AND NOT {_ENDED}" if ended_rule else ""
    return with_(PHRASES, f"""r AS (
    SELECT track_id, cue_id, cue_id AS g, start_ms AS gs, end_ms AS ge, text AS t, speaker AS sp FROM cues WHERE cue_id = 1
    UNION ALL
    SELECT track_id, cue_id, CASE WHEN m THEN g ELSE cue_id END, CASE WHEN m THEN gs ELSE start_ms END, end_ms, CASE WHEN m THEN t || ' ' || text ELSE text END, CASE WHEN m THEN sp ELSE speaker END
    FROM (SELECT c.*, r.g, r.gs, r.t, r.sp, r.sp = c.speaker AND c.start_ms - r.ge BETWEEN 0 AND 400 AND c.end_ms - r.gs <= 9000
        AND len(regexp_split_to_array(r.t || ' ' || c.text, '\\s+')) <= 26 {stop} AND NOT {inner} AS m
      FROM r JOIN cues c ON c.track_id = r.track_id AND c.cue_id = r.cue_id + 1) x)""", recursive=True) + """
    SELECT track_id, g AS group_no, arg_max(t, cue_id) AS translation, count(*) AS joined, min(gs) AS start_ms, arg_max(ge, cue_id) AS end_ms, min(sp) AS speaker FROM r GROUP BY track_id, g"""


def _group_columns(out):
    return out.select("track_id", "group_no", "translation", big(F.size("source_ids")).alias("joined"), "start_ms", "end_ms", "speaker")


def split_sql(src: str, name: str) -> str:
    """Rows of ``src`` (track_id, group_no, text, speaker, start_ms, end_ms) cut into sentences, as ``name`` with a part."""
    return f"""{name}1 AS (SELECT *, {_SENT.format('text')} AS ss FROM {src}),
    {name}2 AS (SELECT track_id, group_no, speaker, start_ms AS s, end_ms AS e, greatest(1, len(ss)) AS n, unnest(CASE WHEN len(ss) > 1 THEN range(0, len(ss)) ELSE [0] END) AS part, CASE WHEN len(ss) > 1 THEN ss ELSE [text] END AS ss FROM {name}1),
    {name}3 AS (SELECT *, ss[part + 1] AS sentence, greatest(1, len({WORDS.format('ss[part + 1]')})) AS wt FROM {name}2),
    {name}4 AS (SELECT *, greatest(1, CAST(round_even(greatest(1, e - s) * wt / (sum(wt) OVER (PARTITION BY track_id, group_no))::DOUBLE, 0) AS BIGINT)) AS share FROM {name}3),
    {name}5 AS (SELECT *, s + coalesce(sum(share) OVER (PARTITION BY track_id, group_no ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM {name}4),
    {name} AS (SELECT track_id, group_no, CAST(part AS BIGINT) AS part, sentence AS text, speaker, CAST(st AS BIGINT) AS start_ms,
      CAST(CASE WHEN n = 1 THEN e WHEN part = n - 1 THEN greatest(st + 1, e) ELSE st + share END AS BIGINT) AS end_ms FROM {name}5)"""


def joined_sql(src: str, name: str, ended_rule: bool) -> str:
    """Rows of ``src`` joined to sentences (``ended_rule``) or narration units, as ``name`` with the same columns."""
    stop = f"AND NOT {_ENDED}" if ended_rule else ""
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, group_no, part) AS k FROM {src}),
    {name}1 AS (
    SELECT track_id, k, k AS g, start_ms AS gs, end_ms AS ge, text AS t, speaker AS sp FROM {name}0 WHERE k = 1
    UNION ALL
    SELECT track_id, k, CASE WHEN m THEN g ELSE k END, CASE WHEN m THEN gs ELSE start_ms END, end_ms, CASE WHEN m THEN t || ' ' || text ELSE text END, CASE WHEN m THEN sp ELSE speaker END
    FROM (SELECT c.*, r.g, r.gs, r.t, r.sp, r.sp = c.speaker AND c.start_ms - r.ge BETWEEN 0 AND 400 AND c.end_ms - r.gs <= 9000
        AND len({WORDS.format("(r.t || ' ' || c.text)")}) <= 26 {stop} AND NOT regexp_matches(r.t || ' ' || c.text, '{TERM} ') AS m
      FROM {name}1 r JOIN {name}0 c ON c.track_id = r.track_id AND c.k = r.k + 1) x),
    {name}2 AS (SELECT track_id, g, arg_max(t, k) AS text, min(gs) AS start_ms, arg_max(ge, k) AS end_ms, arg_min(sp, k) AS speaker FROM {name}1 GROUP BY track_id, g),
    {name} AS (SELECT x.track_id, z.group_no, z.part, x.text, x.speaker, x.start_ms, x.end_ms FROM {name}2 x JOIN {name}0 z ON z.track_id = x.track_id AND z.k = x.g)"""


@query("win11_merge_fragments", _fragments_sql(True))
def _fragments(spark, sf_dir):
    return _group_columns(G.merge_fragments(phrase_groups(spark, sf_dir).withColumn("part", F.lit(0).cast("bigint"))))


@query("win12_tts_groups", _fragments_sql(False))
def _tts(spark, sf_dir):
    return _group_columns(G.tts_groups(phrase_groups(spark, sf_dir).withColumn("part", F.lit(0).cast("bigint"))))


@query("win13_allocate_segments", with_(PHRASES, f"""tu AS (SELECT track_id, turn AS group_no, string_agg(text, ' ' ORDER BY cue_id) AS t FROM cues GROUP BY track_id, turn, speaker),
    ex AS (SELECT track_id, unnest({_SENT.format('t')}) AS s FROM tu), wd AS (SELECT track_id, s, string_split(s, ' ') AS w, len({WORDS.format('s')}) AS n FROM ex),
    lo AS (SELECT track_id, n > 18 OR (n > 14 AND regexp_matches(s, '(?i),|;|:|\\b(and|but|because|if|when|while|so)\\b')) AS long, array_to_string(w[1:len(w) // 2], ' ') AS a, array_to_string(w[len(w) // 2 + 1:], ' ') AS b FROM wd),
    us AS (SELECT *, long AND a <> '' AND b <> '' AND NOT regexp_matches(a || b, '[\u4e00-\u9fff]') AND len({_SENT.format('a')}) <= 1 AND len({_SENT.format('b')}) <= 1 AS ok FROM lo)""") +
    "SELECT track_id, count(*) FILTER (long) AS attempted, count(*) FILTER (ok) AS changed, 2 * count(*) FILTER (ok) AS segments_created FROM us GROUP BY track_id")
def _allocate(spark, sf_dir):
    """Long sentences halved by words, as a model might propose."""
    display = G.split_sentences_timed(turn_groups(spark, sf_dir))
    long = display.where(C.needs_segmentation("translation", "en"))
    numbered = scan(long, plan_layout(long, ["track_id"], ["start_ms", "group_no", "part"]), {"n": ("number", None)})
    w = F.split("translation", " ")
    half = F.floor(F.size(w) / 2).cast("int")
    pieces = F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    proposals = numbered.select("track_id", F.col("n").cast("int").alias("index"), pieces.alias("segments"))
    return G.segmentation_counts(G.allocate_segments(display, proposals, "en"))


# Every state is told twice, the second time with one more sign; after normalising both are equal, so only equal
# neighbours can join (other neighbours are far from the threshold).
@query("win14_merge_ocr_states", with_(PHRASES, r"""st AS (SELECT *, regexp_replace(regexp_replace(text, '\s', '', 'g'), '^[，。！？,.?!;；:：]+|[，。！？,.?!;；:：]+$', '', 'g') AS t FROM cues),
    lg AS (SELECT *, lag(cue_id) OVER w AS before, lag(t) OVER w AS pt, lag(end_ms) OVER w + 40 AS pe FROM st WINDOW w AS (PARTITION BY track_id ORDER BY cue_id)),
    ok AS (SELECT *, coalesce(before % 11 > 0 AND pt = t AND start_ms <= pe + 250, false) AS joins FROM lg WHERE cue_id % 11 > 0 AND t <> ''),
    gr AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY cue_id ROWS UNBOUNDED PRECEDING) AS g FROM ok)""") +
    """SELECT track_id, min(cue_id) * 2 AS cue_first, min(start_ms) AS start_ms, max(end_ms) + 40 AS end_ms, arg_max(t, cue_id) AS text FROM gr GROUP BY track_id, g HAVING max(end_ms) + 40 - min(start_ms) >= 250""")
def _ocr_states(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    kind = F.when(F.col("cue_id") % 11 == 0, "none").otherwise("dialogue")
    states = cues.select("track_id", (F.col("cue_id") * 2).alias("state_no"), "start_ms", "end_ms", "text", kind.alias("kind"))
    again = states.select("track_id", (F.col("state_no") + 1).alias("state_no"), F.col("end_ms").alias("start_ms"), (F.col("end_ms") + 40).alias("end_ms"),
                          F.concat("text", F.lit("!")).alias("text"), "kind")
    return G.merge_ocr_states(at_most(states.unionByName(again), cues, times=2))


STITCH = with_(CUES, """loc AS (SELECT track_id, cue_id, start_ms // 60000 AS w, start_ms % 60000 AS s, start_ms % 60000 + (end_ms - start_ms) % 61000 + 1 AS e, text FROM cues),
    pl AS (SELECT track_id, row(w, cue_id) AS place, s + w * 60000 AS s, least(e + w * 60000, 40000000) AS e, text FROM loc),
    o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY place) AS n FROM pl WHERE e > s),
    r AS (SELECT track_id, n, place AS first, s AS start_, e AS until, text AS t, place, e AS pe, text AS pt, false AS conflict, place AS lead_ FROM o WHERE n = 1
      UNION ALL
      SELECT track_id, n, CASE k WHEN 'new' THEN place ELSE first END, CASE k WHEN 'new' THEN s2 ELSE NULL END, CASE k WHEN 'new' THEN e WHEN 'ext' THEN greatest(until, e) ELSE until END,
        CASE k WHEN 'new' THEN text ELSE t END, place, e, text, k = 'bad', CASE k WHEN 'bad' THEN place WHEN 'new' THEN place ELSE first END
      FROM (SELECT o.*, r.first, r.until, r.t, greatest(o.s, r.until) AS s2, CASE WHEN o.s < r.until AND o.text = r.t THEN 'ext' WHEN o.s < r.until AND o.e <= r.until THEN 'bad' ELSE 'new' END AS k
        FROM r JOIN o ON o.track_id = r.track_id AND o.n = r.n + 1) x)""", recursive=True)


@query("win15_stitch_windows", STITCH + """SELECT track_id, struct_extract(lead_, 1) AS window_first, struct_extract(lead_, 2) AS cue_first, conflict, max(CASE WHEN conflict THEN (SELECT s FROM o WHERE o.track_id = r.track_id AND o.n = r.n) ELSE start_ END) AS start_ms,
    max(pe) AS end_ms, arg_min(pt, place) AS text FROM r GROUP BY track_id, lead_, conflict""")
def _stitch(spark, sf_dir):
    cues = cues_from_events(spark, sf_dir)
    local = cues.select("track_id", "cue_id", F.floor(F.col("start_ms") / 60_000).alias("window_no"), (F.col("start_ms") % 60_000).alias("start_ms"),
                        (F.col("start_ms") % 60_000 + (F.col("end_ms") - F.col("start_ms")) % 61_000 + 1).alias("end_ms"), "text")
    return G.stitch_windows(local, cues.select("track_id").distinct().withColumn("duration_ms", F.lit(40_000_000).cast("bigint")))


@query("stm4_window_list", """WITH d AS (SELECT user_id AS track_id, max(value) * 10 AS d FROM events GROUP BY user_id), k AS (SELECT track_id, d, unnest(range(0, CAST(floor((greatest(ceil(d) - 1, 0)) / 60) AS BIGINT) + 1)) AS window_no FROM d)
    SELECT track_id, window_no, window_no * 60 AS start_s, least(61.0::DOUBLE, d - window_no * 60) AS length_s FROM k""")
def _window_list(spark, sf_dir):
    tracks = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id")).agg((F.max("value") * 10).alias("duration_s"))
    return G.window_list(tracks)


def transcript(spark, sf_dir):
    """A segment per spoken turn with 300 ms words."""
    w = F.split(F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "[.]", ";"), " ")
    timed = F.transform(w, lambda x, i: F.struct(F.concat(F.lit(" "), x).alias("word"), (i * 0.3).cast("double").alias("start"), (i * 0.3 + 0.25).cast("double").alias("end")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("track_id"), F.col("turn").alias("seg_no"), F.lit(0.0).alias("start"), (F.size(w) * 0.3).cast("double").alias("end"),
        F.array_join(w, " ").alias("text"), timed.alias("words"))


@query("win16_split_asr", with_(f"""a AS (SELECT conv_id AS track_id, turn AS seg_no, replace({SQ.format('text')}, '.', ';') AS t FROM conversations),
    b AS (SELECT *, string_split(t, ' ') AS w FROM a),
    c AS (SELECT track_id, seg_no, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS word FROM b WHERE length(t) > 30),
    d AS (SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('。','！','？','；','!','?',';') THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, seg_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS se FROM c),
    e AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY track_id, seg_no, se) - 1 AS chars FROM d),
    r AS (SELECT track_id, seg_no, k, se, k AS first, CASE WHEN chars > 30 AND length(word) >= 8 AND right(word, 1) IN ('，', ',', '、', '：', ':') THEN -1 ELSE length(word) END AS used, word FROM e WHERE k = 0
      UNION ALL
      SELECT track_id, seg_no, k, se, first, CASE WHEN chars > 30 AND u >= 8 AND right(word, 1) IN ('，', ',', '、', '：', ':') THEN -1 ELSE u END, word
      FROM (SELECT e.track_id, e.seg_no, e.k, e.se, e.word, e.chars, CASE WHEN e.se <> r.se OR r.used < 0 THEN e.k ELSE r.first END AS first,
          CASE WHEN e.se <> r.se OR r.used < 0 THEN 0 ELSE r.used END + length(e.word) AS u FROM r JOIN e ON e.track_id = r.track_id AND e.seg_no = r.seg_no AND e.k = r.k + 1) x)""", recursive=True) +
    """SELECT track_id, seg_no, CAST(first AS BIGINT) AS piece, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS words FROM r GROUP BY track_id, seg_no, first
    UNION ALL SELECT track_id, seg_no, 0, t, len(w) FROM b WHERE length(t) <= 30 AND t <> ''""")
def _asr(spark, sf_dir):
    return G.split_asr(transcript(spark, sf_dir)).select("track_id", "seg_no", "piece", "text", big(word_count("text")).alias("words"))


def narration(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    length = F.col("end_ms") - F.col("start_ms")
    return at_most(cues.select(
        "track_id", F.col("cue_id").alias("index"), "start_ms", "end_ms", length.alias("duration_ms"), "text", "speaker",
        F.when(F.col("cue_id") % 13 > 0, length + (F.col("cue_id") * 137) % 900 - 200).alias("raw_ms")), cues)


TIMELINE = with_(PHRASES, """sg AS (SELECT track_id, cue_id AS n, start_ms AS s, end_ms AS e, CASE WHEN cue_id % 13 > 0 THEN end_ms - start_ms + (cue_id * 137) % 900 - 200 END AS raw, lead(start_ms) OVER (PARTITION BY track_id ORDER BY cue_id) AS nx FROM cues),
    z AS (SELECT track_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS cur, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS f, 1.0::DOUBLE AS speed, CAST(0 AS BIGINT) AS spill, '' AS status FROM cues GROUP BY track_id),
    r AS (SELECT * FROM z UNION ALL
      SELECT track_id, n, CASE WHEN ok THEN f ELSE cur END, CASE WHEN ok THEN b ELSE s END, CASE WHEN ok THEN f ELSE s END, CASE WHEN ok THEN speed ELSE 1.0 END, CASE WHEN ok THEN greatest(0, f - lim) ELSE 0 END,
        CASE WHEN NOT ok THEN 'failed' WHEN f - lim > 25 THEN 'timing_overflow' WHEN speed > 1 THEN 'speed_adjusted' ELSE 'natural_fit' END
      FROM (SELECT *, b + CAST(ceil(raw / speed) AS BIGINT) AS f FROM
        (SELECT *, CASE WHEN raw - greatest(1, lim - b) <= 15 THEN 1.0::DOUBLE ELSE least(raw / greatest(1, lim - b)::DOUBLE, 1.65::DOUBLE) END AS speed FROM
          (SELECT *, b0 - CASE WHEN raw > e - s THEN least(greatest(0, b0 - flo), 350, raw - (e - s)) ELSE 0 END AS b FROM
            (SELECT sg.*, r.cur, coalesce(raw > 0, false) AS ok, CASE WHEN r.cur IS NULL THEN 0 ELSE r.cur + 60 END AS flo, greatest(sg.s, CASE WHEN r.cur IS NULL THEN 0 ELSE r.cur + 60 END) AS b0,
               CASE WHEN nx IS NULL THEN sg.e ELSE nx - 60 END AS lim FROM r JOIN sg ON sg.track_id = r.track_id AND sg.n = r.n + 1) x1) x2) x3) x4)""", recursive=True)


@query("win17_schedule_timeline", TIMELINE + f"SELECT track_id, n AS index, b AS actual_start_ms, f AS actual_end_ms, {sql_round('speed', 3)} AS speed_factor, spill AS overflow_ms, CAST(0 AS BIGINT) AS overlap_ms, status FROM r WHERE n > 0")
def _schedule(spark, sf_dir):
    return L.schedule_timeline(narration(spark, sf_dir)).select(
        "track_id", "index", "actual_start_ms", "actual_end_ms", "speed_factor", "overflow_ms", "overlap_ms", "status")


@query("agg10_tts_summary", TIMELINE + """SELECT track_id, count(*) AS segments, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timing_overflow') AS overflowing, count(*) FILTER (status = 'speed_adjusted') AS speed_adjusted,
    CAST(0 AS BIGINT) AS overlap_ms, greatest(max(f) FILTER (status <> 'failed'), (SELECT max(e) FROM sg WHERE sg.track_id = r.track_id)) AS total_ms, CASE WHEN bool_or(status IN ('failed', 'timing_overflow')) THEN 'partial' ELSE 'done' END AS status FROM r WHERE n > 0 GROUP BY track_id""")
def _summary(spark, sf_dir):
    return L.tts_summary(L.schedule_timeline(narration(spark, sf_dir)))


def observed(spark, sf_dir):
    """A video per conversation at 5 fps on which each phrase shows a little before and after."""
    cues = phrases_from_conversations(spark, sf_dir)
    tracks = cues.groupBy("track_id").agg((F.floor((F.max("end_ms") + 2000) / 200) + 1).cast("bigint").alias("frame_count")).withColumn("fps", F.lit(5.0))
    shown = F.sequence(F.greatest(F.lit(0), F.floor(F.col("start_ms") / 200) + F.col("cue_id") % 2), F.floor(F.col("end_ms") / 200) - F.col("cue_id") % 3 % 2)
    obs = cues.where(F.col("cue_id") % 9 > 0).select("track_id", F.explode(shown).alias("frame_idx"), "text", "cue_id").select(
        "track_id", "frame_idx", F.col("cue_id").cast("int").alias("row_no"), "text", F.lit(0.9).alias("confidence"))
    return cues, tracks, obs


# The readings repeat the phrases, so a phrase is seen where an equal one is read; others are far from the threshold.
_NORM = r"replace(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}_]', '', 'g')), 'ß', 'ss')"
OBSERVED = (PHRASES, f"""tr AS (SELECT track_id, (max(end_ms) + 2000) // 200 + 1 AS fc FROM cues GROUP BY 1),
    sh AS (SELECT track_id, cue_id, text, greatest(0, start_ms // 200 + cue_id % 2) AS f0, end_ms // 200 - cue_id % 3 % 2 AS f1 FROM cues WHERE cue_id % 9 > 0),
    ob AS (SELECT track_id, {_NORM.format('text')} AS o, unnest(range(least(f0, f1), greatest(f0, f1) + 1)) AS frame_idx FROM sh)""")
WINDOWS = (*OBSERVED, f"""w0 AS (SELECT c.*, {_NORM.format('text')} AS nt, fc - 1 AS top, lag(start_ms + end_ms) OVER w AS bef, lead(start_ms + end_ms) OVER w AS aft, lead(start_ms) OVER w AS nx
      FROM cues c JOIN tr USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY cue_id)),
    w1 AS (SELECT *, greatest(0, least(top, CAST(round_even(start_ms * 5.0::DOUBLE / 1000, 0) AS BIGINT))) AS a FROM w0),
    w2 AS (SELECT *, greatest(a, least(top, CAST(round_even(end_ms * 5.0::DOUBLE / 1000, 0) AS BIGINT))) AS b FROM w1),
    w3 AS (SELECT *, greatest(0, a - 10, coalesce(CAST(round_even(bef * 5.0::DOUBLE / 2000, 0) AS BIGINT), 0)) AS lo, least(top, b + 10, coalesce(CAST(round_even(aft * 5.0::DOUBLE / 2000, 0) AS BIGINT), top)) AS hi FROM w2),
    w4 AS (SELECT *, least(hi, greatest(lo, CAST(round_even((a + b) / 2.0::DOUBLE, 0) AS BIGINT))) AS mid FROM w3),
    sp AS (SELECT DISTINCT track_id, cue_id, nt, mid, lo, hi, unnest([a, mid, greatest(a, b - 1)]) AS f FROM w4 WHERE hi > lo AND length(nt) >= 2),
    an AS (SELECT track_id, cue_id, arg_min(f, row(abs(f - mid), f)) AS anchor FROM sp WHERE f BETWEEN lo AND hi
      AND EXISTS (SELECT 1 FROM ob WHERE ob.track_id = sp.track_id AND ob.frame_idx = sp.f AND ob.o = sp.nt) GROUP BY 1, 2)""")
REFINED = (*WINDOWS, """fr AS (SELECT w.track_id, w.cue_id, w.nt, an.anchor, unnest(range(w.lo, w.hi + 1)) AS f FROM w4 w JOIN an USING (track_id, cue_id)),
    so AS (SELECT DISTINCT track_id, frame_idx, o FROM ob),
    ab AS (SELECT fr.*, so.o IS NULL AS absent FROM fr LEFT JOIN so ON so.track_id = fr.track_id AND so.frame_idx = fr.f AND so.o = fr.nt),
    ed AS (SELECT track_id, cue_id, max(f) FILTER (absent AND f < anchor) AS gone, min(f) FILTER (absent AND f > anchor) AS lft FROM ab GROUP BY 1, 2),
    b0 AS (SELECT w.*, an.anchor, CASE WHEN gone IS NOT NULL THEN gone + 1 WHEN lo = 0 THEN 0 END AS f0, CASE WHEN lft IS NOT NULL THEN lft - 1 WHEN hi = top THEN top END AS l0
      FROM w4 w LEFT JOIN an USING (track_id, cue_id) LEFT JOIN ed USING (track_id, cue_id)),
    b1 AS (SELECT *, CASE WHEN anchor IS NOT NULL AND f0 <= least(hi, a + 10) THEN f0 END AS f1, CASE WHEN anchor IS NOT NULL AND l0 >= greatest(lo, b - 10) THEN l0 END AS l1 FROM b0),
    b2 AS (SELECT *, coalesce(f1 = 0 AND l1 = top AND (a > 0 OR b < top), false) AS overlay FROM b1),
    b3 AS (SELECT *, CASE WHEN NOT overlay THEN f1 END AS ff, CASE WHEN NOT overlay THEN l1 END AS ll FROM b2),
    b4 AS (SELECT *, ff * 200 AS fm, (ll + 1) * 200 AS tm FROM b3),
    r AS (SELECT track_id, CAST(0 AS BIGINT) AS cue_id, CAST(NULL AS BIGINT) AS was, CAST(NULL AS BIGINT) AS nb, CAST(NULL AS BIGINT) AS nf, false AS opened, false AS closed FROM tr
      UNION ALL
      SELECT track_id, cue_id, nf, nb, nf, opened, closed FROM (SELECT *, CASE WHEN closed THEN tm ELSE end_ms END AS nf FROM (
        SELECT *, coalesce(tm > nb AND (nx IS NULL OR tm <= nx), false) AS closed FROM (
          SELECT *, CASE WHEN opened THEN fm ELSE start_ms END AS nb FROM (
            SELECT b4.*, coalesce(coalesce(r.was, 0) <= fm AND fm < end_ms, false) AS opened FROM r JOIN b4 ON b4.track_id = r.track_id AND b4.cue_id = r.cue_id + 1) p) q) u) v),
    rf AS (SELECT b4.track_id, b4.cue_id, text, start_ms AS source_start_ms, end_ms AS source_end_ms, nb AS start_ms, nf AS end_ms, CASE WHEN opened THEN ff END AS start_frame,
      CASE WHEN closed THEN ll + 1 END AS end_frame_exclusive, opened AS start_verified, closed AS end_verified,
      CASE WHEN anchor IS NULL THEN 'unchanged_no_anchor' WHEN nb <> b4.start_ms OR nf <> b4.end_ms THEN CASE WHEN opened AND closed THEN 'refined' WHEN opened THEN 'refined_start_only' ELSE 'refined_end_only' END
        WHEN opened AND closed THEN 'verified_unchanged' ELSE 'unchanged_unverified_boundary' END AS status
      FROM b4 JOIN r ON r.track_id = b4.track_id AND r.cue_id = b4.cue_id)""")


@query("win21_refine_boundaries", with_(*REFINED, recursive=True) + "SELECT * FROM rf")
def _refine(spark, sf_dir):
    return L.refine_boundaries(*observed(spark, sf_dir))


@query("win22_text_observed", with_(*OBSERVED) + f"""SELECT c.track_id, c.cue_id, c.start_ms // 200 AS frame_idx, bool_or(ob.o = {_NORM.format('c.text')} AND length(ob.o) >= 2) AS seen
    FROM cues c JOIN ob ON ob.track_id = c.track_id AND ob.frame_idx = c.start_ms // 200 GROUP BY ALL""")
def _text_observed(spark, sf_dir):
    cues, _tracks, obs = observed(spark, sf_dir)
    near = cues.select("track_id", "cue_id", "text", F.floor(F.col("start_ms") / 200).alias("frame_idx"))
    pairs = near.join(obs.select("track_id", "frame_idx", "row_no", F.col("text").alias("observed"), "confidence"), ["track_id", "frame_idx"])
    return L.text_observed(pairs, ["track_id", "cue_id", "frame_idx"])


@query("jn13_anchor", with_(*WINDOWS) + "SELECT track_id, cue_id, anchor FROM an")
def _anchor(spark, sf_dir):
    cues, tracks, obs = observed(spark, sf_dir)
    return L.anchors(L.cue_windows(cues, tracks), obs)


@query("agg12_timing_report", with_(*REFINED, recursive=True) + """SELECT track_id, count(*) FILTER (status LIKE 'refined%') AS refined, count(*) FILTER (status NOT LIKE 'refined%') AS unchanged,
    count(*) FILTER (start_verified AND end_verified) AS verified FROM rf GROUP BY track_id""")
def _timing(spark, sf_dir):
    return L.timing_report(L.refine_boundaries(*observed(spark, sf_dir)))


# ----------------------------------------------------------------------------- sampling


@query("win27_sample_cues", with_(PHRASES, """n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cue_id) AS k, greatest(1, count(*) OVER (PARTITION BY track_id) // 12) AS ev FROM cues)""") +
    "SELECT track_id, CAST(floor((start_ms + end_ms) / 2000.0::DOUBLE * 25.0) AS BIGINT) AS frame, min(cue_id) AS cue_id FROM n WHERE (k - 1) % ev = 0 AND (k - 1) // ev < 15 GROUP BY ALL")
def _sample(spark, sf_dir):
    return C.sample_cues(phrases_from_conversations(spark, sf_dir))


@query("win28_even_samples", """WITH d AS (SELECT user_id AS track_id, max(value) AS d FROM events GROUP BY user_id)
    SELECT track_id, CAST(k AS INTEGER) AS sample_no, least(2.0::DOUBLE, d * 0.1::DOUBLE) + d * 0.8::DOUBLE * k / 14.0::DOUBLE AS t FROM d, range(0, 15) r(k)""")
def _even(spark, sf_dir):
    tracks = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.max("value").alias("duration_s"))
    return C.even_samples(tracks)


# --------------------------------------------------------------------------- coverage


def _cov_errors_sql(extra: str) -> str:
    return with_(PHRASES, """g AS (SELECT track_id, (cue_id - 1) // 2 AS gn, list(cue_id ORDER BY cue_id) AS ids, arg_min(text, cue_id) AS translation, min(speaker) AS speaker FROM cues GROUP BY ALL),
    h AS (SELECT track_id, CAST(gn + 1 AS INTEGER) AS group_no, CASE WHEN track_id % 5 = 2 AND gn = 2 THEN list_concat([CAST(1 AS BIGINT)], ids) ELSE ids END AS ids, translation, speaker FROM g WHERE track_id % 5 <> 1 OR gn <> 3),
    u AS (SELECT track_id, group_no, generate_subscripts(ids, 1) AS pos, unnest(ids) AS cue_id FROM h),
    m AS (SELECT u.*, c.start_ms, c.end_ms, c.text, lead(c.start_ms) OVER (PARTITION BY u.track_id, group_no ORDER BY pos) AS nx FROM u JOIN cues c ON c.track_id = u.track_id AND c.cue_id = u.cue_id),
    dup AS (SELECT track_id, cue_id FROM u GROUP BY ALL HAVING count(*) > 1),
    tw AS (SELECT DISTINCT track_id, group_no FROM u JOIN dup USING (track_id, cue_id)),
    fa AS (SELECT track_id, group_no, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, max(nx - end_ms) AS pause, string_agg(text, '' ORDER BY pos) AS source_text FROM m GROUP BY ALL),
    ck AS (SELECT h.track_id, h.group_no, source_text, fa.start_ms, fa.end_ms, ids, list_filter([
        CASE WHEN list_last(ids) - ids[1] + 1 <> len(ids) THEN 'not_contiguous' END, CASE WHEN tw.group_no IS NOT NULL THEN 'not_exactly_once' END,
        CASE WHEN pause > 800 THEN 'pause_too_long' END, CASE WHEN end_ms - start_ms > 10000 THEN 'span_too_long' END], lambda x: x IS NOT NULL) AS errors
      FROM h JOIN fa USING (track_id, group_no) LEFT JOIN tw USING (track_id, group_no))""") + extra


@query("jn3_coverage", _cov_errors_sql("SELECT track_id, group_no, source_text, start_ms, end_ms, array_to_string(errors, ',') AS errors FROM ck"))
def _coverage(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    out = G.coverage(pair_groups(cues, broken=True), cues)
    return out.select("track_id", "group_no", "source_text", "start_ms", "end_ms", F.array_join("errors", ",").alias("errors"))


@query("jn3_coverage_errors", _cov_errors_sql("""SELECT c.track_id, CAST(coalesce(max(ge), 0) AS BIGINT) AS group_errors, count(*) FILTER (NOT EXISTS (SELECT 1 FROM u WHERE u.track_id = c.track_id AND u.cue_id = c.cue_id)) AS missing,
    coalesce(max(fe), CASE WHEN count(*) FILTER (NOT EXISTS (SELECT 1 FROM u WHERE u.track_id = c.track_id AND u.cue_id = c.cue_id)) > 0 THEN 'missing_ids' END) AS first_error
    FROM cues c LEFT JOIN (SELECT track_id, sum(len(errors)) AS ge, arg_min(errors[1], group_no) FILTER (len(errors) > 0) AS fe FROM ck GROUP BY track_id) k ON k.track_id = c.track_id GROUP BY c.track_id"""))
def _coverage_errors(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    return G.coverage_errors(G.coverage(pair_groups(cues, broken=True), cues), cues)


@query("set3_missing_ids", with_(PHRASES) + "SELECT track_id, cue_id FROM cues WHERE track_id % 5 = 1 AND (cue_id - 1) // 2 = 3")
def _missing(spark, sf_dir):
    cues = phrases_from_conversations(spark, sf_dir)
    return G.missing_ids(pair_groups(cues, broken=True), cues)


# ------------------------------------------------------------------------------ filters


@query("flt6_dialogue_states", "SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def _dialogue(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "title").otherwise("dialogue")
    shown = F.when(F.col("event_type").isin("view", "click"), F.col("props")).otherwise(" .,! ")
    return G.dialogue_states(table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), shown.alias("text"))).select("event_id")


_w = f"len({WORDS.format('text')})"


@query("flt7_needs_segmentation", f"""SELECT doc_id, CASE WHEN {_w} > 18 THEN true WHEN {_w} <= 14 THEN false ELSE regexp_matches(text, '(?i),|;|:|\\b(and|but|because|if|when|while|so)\\b') END AS en,
    CASE WHEN {_w} > 22 THEN true WHEN {_w} <= 14 THEN false ELSE regexp_matches(text, '(?i),|;|:|\\b(and|but|because|if|when|while|so)\\b') END AS vi FROM documents""")
def _needs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.needs_segmentation("text", "en").alias("en"), C.needs_segmentation("text", "vi").alias("vi"))


@query("flt8_over_budget", f"SELECT conv_id, turn, {_w} > greatest(turn * 9 + 2, CAST(trunc(turn * 9 * 1.35::DOUBLE) AS BIGINT)) AS over FROM conversations")
def _over(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.over_budget("text", F.col("turn") * 9).alias("over"))


_alt = "CASE WHEN turn % 2 = 0 THEN left(text, 30) ELSE text || ' more' END"


@query("flt9_accept_compression", f"SELECT conv_id, turn, CASE WHEN len({WORDS.format(_alt)}) < {_w} THEN {_alt} ELSE text END AS line FROM conversations")
def _compress(spark, sf_dir):
    new = F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(30))).otherwise(F.concat("text", F.lit(" more")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.accept_compression(F.col("text"), new).alias("line"))


@query("flt2_subtitle_boxes", with_(BOXES) + "SELECT order_no, line, x0, y0, x1, y1 FROM boxes WHERE y1 - y0 >= 14 AND x1 - x0 >= 1000 * 0.06 AND y0 >= 1000 * 0.60")
def _sub_boxes(spark, sf_dir):
    return B.subtitle_boxes(boxes_from_lineitem(spark, sf_dir), 1000, 1000).select("order_no", "line", "x0", "y0", "x1", "y1")


@query("flt3_title_boxes", with_(BOXES) + "SELECT order_no, line, x0, y0, x1, y1 FROM boxes WHERE length(text) >= 3 AND x1 - x0 >= 150 AND y1 - y0 >= 18 AND y0 >= 40 AND y1 <= 350")
def _title_boxes(spark, sf_dir):
    return B.title_boxes(boxes_from_lineitem(spark, sf_dir), 1000, 1000).select("order_no", "line", "x0", "y0", "x1", "y1")


@query("agg6_subtitle_region", with_(BOXES, """k AS (SELECT track_id, count(*) AS n, count(DISTINCT frame) AS fr, CAST(trunc(""" + sql_quantile("y0", 0.5) + """) AS INTEGER) AS t, CAST(trunc(""" + sql_quantile("y1", 0.5) + """) AS INTEGER) AS b,
      """ + sql_quantile("x1", 0.85) + " - " + sql_quantile("x0", 0.15) + """ AS dw FROM boxes WHERE y1 - y0 >= 14 AND x1 - x0 >= 60 AND y0 >= 600 AND track_id % 10 > 0 GROUP BY track_id),
    y AS (SELECT *, greatest(0, t - greatest(8, CAST(trunc((b - t) * 0.22::DOUBLE) AS INTEGER))) AS ys, least(1000, b + greatest(8, CAST(trunc((b - t) * 0.22::DOUBLE) AS INTEGER))) AS ye, greatest(600, least(CAST(trunc(dw + 80.0) AS INTEGER), 880)) AS tw FROM k WHERE fr >= 2),
    z AS (SELECT track_id, ys, greatest(50, least(ye - ys, 120)) AS sh, tw - tw % 2 AS w2 FROM y)""") + f"""
    SELECT a.track_id, CASE WHEN z.track_id IS NULL THEN 0.08::DOUBLE ELSE {sql_round('greatest(0, trunc((1000 - w2) / 2)) / 1000::DOUBLE', 3)} END AS x_ratio, coalesce({sql_round('ys / 1000::DOUBLE', 3)}, 0.86::DOUBLE) AS y_ratio,
    coalesce({sql_round('w2 / 1000::DOUBLE', 3)}, 0.84::DOUBLE) AS w_ratio, coalesce({sql_round('sh / 1000::DOUBLE', 3)}, 0.09::DOUBLE) AS h_ratio, CASE WHEN z.track_id IS NULL THEN 'fixed_fallback' ELSE 'detected' END AS method
    FROM (SELECT DISTINCT track_id FROM boxes) a LEFT JOIN z ON z.track_id = a.track_id""")
def _region(spark, sf_dir):
    boxes = boxes_from_lineitem(spark, sf_dir)
    return B.subtitle_region(boxes.where(F.col("track_id") % 10 > 0), boxes, 1000, 1000)


@query("agg7_primary_title", with_(BOXES, """c AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY (x1 - x0) * (y1 - y0) DESC, order_no, line, x0, y0) AS k FROM boxes WHERE length(text) >= 3 AND x1 - x0 >= 150 AND y1 - y0 >= 18 AND y0 >= 40 AND y1 <= 350),
    p AS (SELECT *, CAST(trunc((y1 - y0) * 0.25::DOUBLE) AS INTEGER) AS py FROM c WHERE k = 1)""") + f"""SELECT track_id, text, {sql_round('greatest(0, x0 - 40) / 1000::DOUBLE', 3)} AS x_ratio, {sql_round('greatest(0, y0 - py) / 1000::DOUBLE', 3)} AS y_ratio,
    {sql_round('(least(1000, x1 + 40) - greatest(0, x0 - 40)) / 1000::DOUBLE', 3)} AS w_ratio, {sql_round('(least(1000, y1 + py) - greatest(0, y0 - py)) / 1000::DOUBLE', 3)} AS h_ratio FROM p""")
def _title(spark, sf_dir):
    return B.primary_title(boxes_from_lineitem(spark, sf_dir), 1000, 1000, ["order_no", "line", "x0", "y0"])


TEXT_ROWS = with_(BOXES, """bx AS (SELECT track_id, frame, row_number() OVER (PARTITION BY track_id, frame ORDER BY order_no, line, x0, y0, x1) AS box_no, (y0 + y1) / 2.0::DOUBLE AS center, CAST(y1 - y0 AS DOUBLE) AS height FROM boxes),
    md AS (SELECT track_id, frame, quantile_cont(height, 0.5) AS md FROM bx GROUP BY ALL),
    us AS (SELECT bx.*, md, row_number() OVER (PARTITION BY track_id, frame ORDER BY center, box_no) AS k FROM bx JOIN md USING (track_id, frame) WHERE height BETWEEN md * 0.6::DOUBLE AND md * 1.5::DOUBLE),
    r AS (SELECT track_id, frame, k, box_no AS first, center AS tot, 1 AS n, center FROM us WHERE k = 1 UNION ALL
      SELECT track_id, frame, k, CASE WHEN cut THEN box_no ELSE first END, CASE WHEN cut THEN center ELSE tot + center END, CASE WHEN cut THEN 1 ELSE n + 1 END, center
      FROM (SELECT us.*, r.first, r.tot, r.n, abs(us.center - r.tot / r.n) > us.md * 0.35::DOUBLE AS cut FROM r JOIN us ON us.track_id = r.track_id AND us.frame = r.frame AND us.k = r.k + 1) x)""", recursive=True)


@query("win29_group_text_rows", TEXT_ROWS + "SELECT track_id, frame, first AS row_first, count(*) AS boxes, min(center) AS top, max(center) AS bottom FROM r GROUP BY ALL HAVING count(*) >= 3")
def _text_rows(spark, sf_dir):
    boxes = boxes_from_lineitem(spark, sf_dir)
    layout = plan_layout(boxes, ["track_id", "frame"], ["order_no", "line", "x0", "y0", "x1"])
    numbered = scan(boxes, layout, {"box_no": ("number", None)})
    return B.group_text_rows(at_most(numbered.select(
        "track_id", "frame", "box_no", ((F.col("y0") + F.col("y1")) / F.lit(2.0)).alias("center"), (F.col("y1") - F.col("y0")).cast("double").alias("height")), numbered))


_shape = "CAST(y1 - y0 AS DOUBLE) AS h, (y0 + y1) / 2.0::DOUBLE AS cy, (x0 + x1) / 2.0::DOUBLE AS cx"


@query("jn12_style_match", with_(BOXES, f"""ln AS (SELECT track_id, order_no AS obs_id, {_shape} FROM boxes WHERE score < 8), st AS (SELECT DISTINCT track_id, {_shape} FROM boxes WHERE score >= 8),
    hit AS (SELECT l.*, EXISTS (SELECT 1 FROM st s WHERE s.track_id = l.track_id AND l.h BETWEEN s.h * 0.65::DOUBLE AND s.h * 1.45::DOUBLE AND abs(l.cy - s.cy) <= greatest(4.0, s.h * 0.5) AND abs(l.cx - s.cx) <= 20.0) AS ok FROM ln l)""") +
    "SELECT track_id, obs_id, count(*) AS lines, bool_and(ok) AS matches FROM hit GROUP BY ALL")
def _style(spark, sf_dir):
    boxes = boxes_from_lineitem(spark, sf_dir)
    shape = [(F.col("y1") - F.col("y0")).cast("double").alias("h"), ((F.col("y0") + F.col("y1")) / F.lit(2.0)).alias("cy"), ((F.col("x0") + F.col("x1")) / F.lit(2.0)).alias("cx")]
    lines = boxes.where(F.col("score") < 8).select("track_id", F.col("order_no").alias("obs_id"), *shape)
    styles = boxes.where(F.col("score") >= 8).select("track_id", *shape)
    return B.style_match(lines, styles, 80)


# ------------------------------------------------------------------------------ output


@query("snk1_to_srt", with_(PHRASES) + f"SELECT track_id, CAST(0 AS INTEGER) AS part, string_agg(cue_id || chr(10) || {STAMP} || chr(10) || text || chr(10), chr(10) ORDER BY cue_id) AS content FROM cues GROUP BY track_id")
def _to_srt(spark, sf_dir):
    return C.to_srt(phrases_from_conversations(spark, sf_dir))


_KINDS = ["purchase", "view", "click", "signup", "error"]


@query("snk2_split_valid", with_(CUES.replace("user_id AS track_id", f"user_id * 8 + list_position({_KINDS}, event_type) AS track_id"), CHECKED) + "SELECT track_id, count(*) AS cues FROM checked GROUP BY track_id HAVING sum(len(errors)) = 0")
def _valid_only(spark, sf_dir):
    """Every kind of event of a user is a track of its own; most of these have no overlaps."""
    kind = F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("text"))
    cues = cues_from_events(spark, sf_dir).withColumn("track_id", F.col("track_id") * 8 + kind)
    good, _refused = sinks.split_valid(cues.withColumn("duration_ms", F.lit(40_000_000)), "duration_ms")
    return good.groupBy("track_id").agg(F.count(F.lit(1)).alias("cues"))


@query("snk3_to_ass")
def _to_ass(spark, sf_dir):
    return C.to_ass(phrases_from_conversations(spark, sf_dir))


@query("snk9_track_reports", TIMELINE + "SELECT track_id, CAST(0 AS INTEGER) AS part, string_agg(n || ':' || status, ' ' ORDER BY n) AS rows FROM r WHERE n > 0 GROUP BY track_id")
def _reports(spark, sf_dir):
    placed = L.schedule_timeline(narration(spark, sf_dir)).select("track_id", "index", "status")
    out = sinks.track_reports(placed, L.tts_summary(L.schedule_timeline(narration(spark, sf_dir))).select("track_id", "segments"), ["index"])
    return out.select("track_id", "part", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["index"].cast("string"), r["status"])), " ").alias("rows"))


