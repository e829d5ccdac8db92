"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "revenue_by_nation", "filter_ops", "summary_multi", "trend_month", "pareto", "pivot_margins", "join_outer", "lookup_first", "interval_price", "range_amount", "table_diff_modified", "dedup_first", "version_states",
    "corr_spearman", "outliers_iqr", "rfm_customers", "ar_customer_pivot", "alloc_largest_remainder", "validate_results", "reconcile_keyed", "sales_rank_product", "inventory_ledger", "plan_chain", "row_positions",
]
REPEATS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from tabloom import catalog

    def once(name: str) -> float:
        t = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - t

    once(HEADLINE[0])  # warm-up: code is loaded and files are mapped
    seconds = {}
    for name in HEADLINE:
        try:
            seconds[name] = round(statistics.median(once(name) for _ in range(REPEATS)), 3)
        except Exception as e:  # a failing query must not hide the others
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
