"""Time the headline queries; prints one JSON line.

Each query is run twice into a sink that takes every row: "cold" is the first
run (code generation, file listing), "queries" holds the second.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "a01_kpi", "a03_cross_counts", "a05_brand_scorecard", "a06_urgency", "a07_zone_stats",
    "a09_aspect_matrix", "a10_zone_text_summary", "a14_station_detail", "p01_overview",
    "w01_urgency_rank", "s07_enriched", "s08_dedupe", "s09_merge_passes", "s14_page_records",
    "c08_issue", "c09_issue_tags", "c11_quality", "c13_relative_date", "c17_lexicon_scores",
    "n09_tokens", "f01_facets", "j01_calendar_spine", "t01_keywords", "t02_bigrams",
    "t03_keyphrases", "t06_dominant_topics", "ts04_series", "ts05_many_series_forecast",
    "ts08_issue_series", "x02_dedupe", "x04_windowed_counts",
]


def main() -> None:
    from forecourt.catalog import load
    from forecourt.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tasks = cpus if cpus.isdigit() else "8"
    # The test files have one row group each, so the scans are dealt over the cores here.
    spark = local_session(cpus, partitions=int(tasks), **{"spark.forecourt.scanPartitions": tasks})
    registry = load()
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    cold, warm = {}, {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        fn = registry[name][0]
        for target in (cold, warm):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            target[name] = round(time.perf_counter() - start, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total warm wall time",
        "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
