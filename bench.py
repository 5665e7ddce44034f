"""Times the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from noticeworks import catalogue

HEADLINE = (
    "source_health", "asof_version", "delta_feed", "weekly_top_news", "announcement_catalogue", "situations", "funnel_phases", "segment_rollup",
    "upsert_merge", "kpi_sheet", "doc_budget", "triage", "title_similarity", "link_groups", "match_profiles", "campaign_top",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_TMP", "/tmp/noticeworks-bench")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
