"""Time the registered queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names; default: the headline list below).
Caches are dropped before each query, so every figure includes its own scan.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sensorloom.plans import catalog  # noqa: E402
from sensorloom.session import local_session  # noqa: E402

HEADLINE = [
    "etl_wide",
    "trailing_avg_rows",
    "trailing_avg_time",
    "resample_right_closed",
    "pivot_wide",
    "scalar_time_text",
    "table_profile",
    "missing_matrix",
    "gap_report",
    "outlier_matrix",
    "shared_histogram",
    "linear_interpolate",
    "correlation_matrix",
    "correlation_by_asset",
    "dft_magnitude",
    "fft_magnitude",
    "cumulative_energy",
    "spectral_correlation",
    "forecast_join",
    "train_days",
    "error_stats_by_range",
    "forecast_report",
    "latest_prediction",
    "linear_10min",
    "spline_10min",
    "ridge_gram",
    "ridge_fit",
    "grouped_ridge",
    "grouped_ridge_predictions",
    "pca_variance",
    "fleet_predictions",
    "per_asset_predictions",
    "kmeans_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()

    def run(name: str) -> float:
        spark.catalog.clearCache()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # Start the JVM's compiler and the Python workers outside the timed part.
    run("etl_wide")
    run("correlation_by_asset")
    times = {}
    for name in names:
        times[name] = round(run(name), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
