"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from auctionlake.plans.catalog import CATALOG  # noqa: E402

HEADLINES = (
    "a1_stats", "a4_top_counties", "a5_county_frequency", "a9_enrichment_rate", "f7_search", "o1_dashboard",
    "o3_search_page", "j7_case_peers", "j9_new_since_last_run", "w4_failure_breaker", "w5_navigation", "w6_change_events",
    "extract_notice_fields", "s1_listing_json", "s2_sales_grid", "s9_notice_details", "p4_ical", "p5_notice_hits",
    "j3_parcel_lookup", "j4_parcel_candidates", "j5_address_search", "j6_fuzzy_match", "j12_d7_repair_links",
    "d1_upsert", "d2_archive_below", "d3_d4_d5_commands", "d6_apply_parcels", "st4_stream_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("auctionlake-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["a2_run_count"][0](spark, sf_dir).collect()  # session warm-up
    times = {}
    for name in names:
        begin = time.perf_counter()
        CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
