"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or
"all") choose what runs. Every query is planned and run once, results go to the no-op sink; the
session and the table files are touched once before timing starts."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foresail.plans.catalog import QUERIES  # noqa: E402
from foresail.session import local_session  # noqa: E402

HEADLINE = (
    "a1_read_leads_csv", "b4_reclassify_future_trips", "c3_lookup_conversion_rate", "c4_monthly_bookings",
    "d1_monthly_revenue", "d1_supplier_series", "d3_load_metadata", "d5_revenue_stats", "d11_duplicate_records",
    "d15_segment_conversion_rates", "d17_funnel_cohort", "d19_funnel_rates", "d21_open_value_details",
    "d32_classification_metrics", "e4_drop_collapsed_last_month", "e4_supplier_series", "f2_stratified_split",
    "f3_train_conversion_model", "f5_rule_forecast", "f7_seasonal_trend", "f7_supplier_trend",
    "f8_rolling_origin_backtest", "f10_forecast_12_months", "g1_insights", "g3_report_completeness",
    "k1_stream_monthly_revenue",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d4_stage_distribution"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
