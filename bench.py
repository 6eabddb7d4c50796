"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query is run twice and the
second run counts, so that code generation and file caches do not hide the plan's own cost.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from workload import QUERIES

HEADLINES = (
    "grade_histogram", "graded_rows", "time_offset", "first_per_key", "group_ids",
    "variants_per_sample", "rare_or_unknown", "annotate_composite", "attach_count", "semi_join",
    "accumulate_tags", "cohort_funnel", "count_parent_total", "median", "describe_by",
    "normalize_significance", "recurrent_panel", "candidates_panel", "recurrent_broad",
    "exposure_groups", "validation_frame", "panel_graded", "broad_enriched", "km_curve", "logrank",
    "cox_efron", "kruskal_wallis", "roc_curve", "cutoff_metrics", "auc_ci", "box_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
