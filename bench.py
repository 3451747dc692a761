"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three runs each.

After $BENCH_BUDGET seconds no further run of a query begins but its first, whose cold time then counts; `timed_runs` tells
how many warm runs stand behind each figure."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
RUNS, BUDGET = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_BUDGET", "1000"))
HEADLINE = ["window_index", "window_members", "rotate8", "encode_notes", "decode_frames", "segment_by_span", "accepted_charts", "match_counts", "lookup_fallback", "split_groupwise", "extremes", "masked_accuracy", "parse_notation", "render_parse_roundtrip"]


def main() -> None:
    from metrolith.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, runs, start = {}, {}, time.perf_counter()
    for name in HEADLINE:
        query, each = registry.queries()[name], []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            if each and began - start > BUDGET:
                break
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name], runs[name] = round(median(each[1:] or each), 3), len(each) - 1
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries, median of warm runs (of one cold run where timed_runs is 0)", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "timed_runs": runs, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
