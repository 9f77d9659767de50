"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.  Every query
is built and written to the no-op sink in full; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from smogline.plans import all_queries
from smogline.plans.views import Tables
from smogline.session import local_session

HEADLINE = [
    "worst_station_hours", "clean_weather", "pivot_long_to_wide", "flatline_mask", "lag_lead_features", "lag_impute",
    "nearest_station_within", "temporal_window_match", "collocate", "weather_cell_join", "satellite_carry_forward",
    "nearest_reference_point", "naqi_overall", "feature_matrix", "impute_policy", "composite_median",
    "reanalysis_daily_derive", "summary_stats", "correlation_matrix", "mutual_information", "conformal_calibration",
    "quality_rules", "temporal_split", "group_kfold", "idw", "regression_kriging", "regrid_bilinear",
    "topk_contributions", "stream_hourly_aqi",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "smogline-bench")
    queries = all_queries()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name].build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
