"""Registered queries against their SQL on the smallest tables; the rest must give rows."""

import pytest

from catalog import ORACLE, QUERIES
from catalog.check import compare, connect

SMALL = "/root/testdata/sf0.001"
PICKED = [
    "win4_merge_intervals", "val1_validate_cues", "win17_schedule_timeline", "win8_source_groups", "win11_merge_fragments", "jn3_coverage",
    "jn9_frames_in_intervals", "jn11_nearby_references", "win18_confirm_runs", "stm6_run_confirm_stream", "stm2_claim_stream", "stm9_chunk_arrivals",
    "agg16_missing_chunks", "win25_latest_job_state", "ups1_ledger_claim", "jn12_style_match", "agg6_subtitle_region", "str1_split_sentences",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", PICKED)
def test_query(spark, con, name):
    ok, told = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SMALL)
    assert ok, told


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and entry.queries().keys() >= entry.oracle_sql().keys()
