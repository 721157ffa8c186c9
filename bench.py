"""Seconds per headline query, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs to the end (into
a sink that discards rows), after one run that warms up the JVM and the page cache.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gleanery.plans.catalogue import QUERIES
from gleanery.session import build_session

HEADLINE = (
    "index_pages extract_documents append_items html_text text_title route_extract extractor_rank "
    "skip_existing find_item_id update_items update_metadata remove_by_url dedup_by_hash "
    "duplicate_groups discovery_summary stage_status state_latest state_get snapshot_diff nested_diff "
    "layered_merge metadata_merge metadata_merge_extra item_ids item_tree extract_nested cache_get "
    "cache_orphans cache_save read_files index_folder index_stream state_stream"
).split()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
