"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog import QUERIES
from cueloom.adapters import cues_from_events, phrases_from_conversations
from cueloom.session import build_session

HEADLINE = [
    "win4_merge_intervals", "val1_validate_cues", "win17_schedule_timeline", "win18_confirm_runs", "win8_source_groups",
    "jn9_frames_in_intervals", "jn11_nearby_references", "win5_peaks", "jn3_coverage", "agg3_batch_status",
    "agg16_missing_chunks", "ups1_ledger_claim", "win25_latest_job_state", "srt1_newest_works", "jn12_style_match",
    "str1_split_sentences",
]

# What a query reads, where a rate can be compared: segments to place, frames to scan.
INPUTS = {
    "win17_schedule_timeline": phrases_from_conversations,
    "win18_confirm_runs": cues_from_events,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    took, rates = {}, {}
    # The first query also pays for starting the workers, so it is run once before the clock starts.
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        if name in INPUTS:
            rates[f"{name}_input_rows_per_s"] = round(INPUTS[name](spark, sf_dir).count() / took[name])
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **rates,
    }))


if __name__ == "__main__":
    main()
