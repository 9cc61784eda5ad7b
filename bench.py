"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local threads. Each query runs once to warm up and then RUNS times; the
median counts. Results are written to the no-op sink, so every row and column is produced and nothing is collected.

The driver tables are single files of one row group, which a scan cannot share out. They are first dealt into files of a
temporary folder, a few per thread, as large tables lie in many row groups; that is not timed.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time
from pathlib import Path

from lapak.plans import load
from lapak.plans.registry import QUERIES
from lapak.session import build_session

HEADLINE = (
    "p1_visible_listings", "slice_first_page", "o1_feed_page_price_low", "o5_assign_pages", "a1_category_facets",
    "a2_location_facets", "a5_feed_version", "n19_listing_dto", "n5_contract_valid", "snk1_upsert_listings",
    "snk2_replace_images", "snk3_upsert_rejections", "w2_dedupe_last", "w5_classify_changes", "t2_next_queue",
    "a7_coverage", "a13_seller_duplicates", "p12_relevance_metrics", "n9_pack_review_batches", "n17_gallery_classes",
    "x1_extract_marketplace", "a11_yield_summary", "w8_failure_streaks",
)
RUNS = 2


def dealt(spark, data: str, files: int) -> str:
    """A copy of all tables, each in ``files`` files."""
    base = tempfile.mkdtemp(prefix="spark-bench-")
    for path in sorted(Path(data).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(files).write.parquet(f"{base}/{path.name}")
    return base


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    load()
    tables = dealt(spark, data, 2 * (int(cpus) if cpus.isdigit() else 8))
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    shutil.rmtree(tables, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of headline queries (median, warm)", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": data.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
