"""Named queries over the given tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times of the tables carry no zone; the SQL side reads them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def scalar(name: str, source: str, columns: Callable[[], list[Column]], sql: str | None) -> None:
    """A projection of a table against the same projection in SQL."""
    query(name, sql and f"SELECT {sql} FROM {source}")(
        lambda spark, sf_dir: table(spark, sf_dir, source).select(*columns())
    )


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# ------------------------------------------------------- the adapters, written in SQL

CUES = """cues AS (
  SELECT user_id AS track_id, event_id AS cue_id,
    (epoch_us(ts) - 1704067200000000) // 60000 AS start_ms,
    (epoch_us(ts) - 1704067200000000) // 60000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms,
    event_type AS text
  FROM events)"""

PHRASES = r"""ph0 AS (
  SELECT conv_id AS track_id, turn, CASE WHEN role = 'user' THEN 'M1' ELSE 'F1' END AS speaker,
    list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w
  FROM conversations),
ph1 AS (SELECT track_id, turn, speaker, w, unnest(range(0, len(w), 4)) AS i FROM ph0 WHERE len(w) > 0),
ph2 AS (
  SELECT track_id, turn, speaker, i // 4 AS pos, array_to_string(w[i + 1:i + 4], ' ') AS text,
    least(4, len(w) - i) * 300 AS len_, 40 + ((i // 4) * 137 + turn * 61) % 900 AS gap_
  FROM ph1),
ph3 AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY turn, pos) AS cue_id,
    CAST(coalesce(sum(len_ + gap_) OVER (PARTITION BY track_id ORDER BY turn, pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM ph2),
cues AS (SELECT track_id, cue_id, start_ms, start_ms + len_ AS end_ms, text, speaker, turn FROM ph3)"""

WORKS = """works AS (
  SELECT o_custkey AS channel_id, o_orderkey AS work_id,
    CAST(epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 AS BIGINT) AS create_time,
    CAST(floor(o_totalprice) AS BIGINT) AS likes, o_orderkey % 600 AS duration_s,
    CASE WHEN o_orderstatus = 'P' THEN 'album' ELSE 'video' END AS kind,
    'work ' || o_orderpriority AS title
  FROM orders),
history AS (SELECT o_orderkey AS work_id FROM orders WHERE o_orderpriority = '1-URGENT'),
ledger AS (
  SELECT o_custkey AS channel_id, o_orderkey AS work_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'PUBLISHED' WHEN '2-HIGH' THEN 'FAILED' ELSE 'PROCESSING' END AS status,
    CAST(o_orderkey % 4 AS INTEGER) AS attempts,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'download failed' END AS last_error,
    '2024-01-01T00:00:00+00:00' AS created_at
  FROM orders WHERE o_orderstatus <> 'O')"""

ITEMS = """items AS (
  SELECT l_orderkey AS batch_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
    CAST(floor(l_extendedprice) AS BIGINT) AS size,
    CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'queued'
      WHEN l_returnflag = 'N' THEN 'processing' WHEN l_linestatus = 'O' THEN 'done' ELSE 'partial' END AS status,
    CAST(floor(l_quantity) AS INTEGER) AS progress, CAST(l_linenumber % 3 AS INTEGER) AS attempts
  FROM lineitem)"""

JOBS = """jobs AS (
  SELECT user_id AS job_id, epoch_us(ts) AS updated, event_id, event_type AS status,
    CAST(floor(value) AS INTEGER) AS progress, event_type = 'error' AS cancel, event_type = 'signup' AS reset
  FROM events)"""

BOXES = """boxes AS (
  SELECT l_suppkey AS track_id, l_orderkey % 50 AS frame, l_orderkey AS order_no, l_linenumber AS line,
    l_returnflag || '-' || l_linenumber || l_linestatus AS text,
    l_partkey % 700 AS x0, l_orderkey % 900 AS y0,
    l_partkey % 700 + CAST(floor(l_quantity) AS BIGINT) * 8 AS x1,
    l_orderkey % 900 + 8 + l_linenumber * 5 AS y1,
    CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS score
  FROM lineitem)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def sql_round(x: str, digits: int) -> str:
    """Half-even rounding of the exact binary value, as ``values.py_round`` does it."""
    s = f"{float(10 ** digits)}::DOUBLE"
    v = f"CAST({x} AS DOUBLE)"
    big_ = f"({v} * 134217729::DOUBLE)"
    high = f"({big_} - ({big_} - {v}))"
    prod = f"({v} * {s})"
    err = f"(({high} * {s} - {prod}) + ({v} - {high}) * {s})"
    tie = f"({prod} - floor({prod})) = 0.5::DOUBLE"
    return (
        f"((CASE WHEN {tie} AND {err} > 0 THEN floor({prod}) + 1 WHEN {tie} AND {err} < 0 THEN floor({prod}) "
        f"ELSE round_even({prod}, 0) END) / {s})"
    )


def sql_quantile(value: str, q: float, where: str | None = None) -> str:
    """Linear interpolation from the nearer end, as ``scan.quantiles`` does it."""
    kept = f"list_sort(list(CAST({value} AS DOUBLE)){f' FILTER ({where})' if where else ''})"
    at = f"((len({kept}) - 1) * {q}::DOUBLE)"
    low, high = f"{kept}[CAST(floor({at}) AS BIGINT) + 1]", f"{kept}[CAST(ceil({at}) AS BIGINT) + 1]"
    part = f"({at} - floor({at}))"
    return (f"(CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} "
            f"ELSE {high} - ({high} - {low}) * (1 - {part}) END)")


SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
TERM = r"""[.!?。！？]+["''”’»」』)\]]*"""
CUT = "chr(57344)"


def sql_sentences(text: str) -> str:
    marked = f"regexp_replace({SQ.format(text)}, '({TERM})( |$)', '\\1' || {CUT}, 'g')"
    return f"list_filter(list_transform(string_split({marked}, {CUT}), lambda x: trim(x)), lambda x: x <> '')"
