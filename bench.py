"""Benchmark: run the headline registered queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES ("headline" (default), "all", or a comma list of names),
     BENCH_REPEAT (default 1; the median of the repeats is reported).

Each query's operator plan is executed completely with the ``noop`` sink (no
collect to the driver); one warm-up run of the flagship absorbs JVM start and
codegen.  The 9-significant-digit rounding that the registered queries add
for the cross-engine value hash is a checking artifact and is not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d1_describe_numeric", "d2_describe_categorical", "d4_overview", "d5_ecdf", "d7_correlation", "d8_spearman",
    "d10_metric_cards", "d11_insights",
    "b3_preview", "v1_line_table", "v2_bar_table", "v3_scatter_bins", "v4_histogram_table", "v5_box_table",
    "v6_compare_diff", "v9_overlay_by_category",
    "c2_impute_mean_by", "c3_impute_mode", "c4_flag_outliers_iqr", "c8_derive", "c9_drop_duplicates",
    "c9_clean_text", "c10_scale_standard", "c11_encode_index",
    "r1_linear_regression", "r2_polynomial_regression", "r5_regression_metrics", "m3_cross_validate",
    "m4_confusion_matrix", "m6_roc_curve", "m6_auc",
    "t1_resample", "t3_fill_gaps_ffill", "t5_decompose_with_ma", "t6_moving_average", "t7_ewm",
    "t9_forecast_trend_season", "t10_backtest", "t12_acf",
    "k1_kmeans", "k4_choose_k", "k6_cluster_profile",
    "s1_read_csv", "x1_export_parquet",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    which = os.environ.get("BENCH_QUERIES", "headline")
    repeat = max(int(os.environ.get("BENCH_REPEAT", "1")), 1)

    from tally.session import local_session

    spark = local_session(cpus, cpus)
    from tally.plans.catalog import load_all
    qs = {n: r.raw for n, r in load_all().items()}
    if which == "all":
        names = list(qs)
    elif which == "headline":
        names = [n for n in HEADLINE if n in qs]
    else:
        names = [n.strip() for n in which.split(",") if n.strip() in qs]

    # warm-up: JVM, codegen, file listing
    qs["t5_decompose_with_ma"](spark, sf).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for n in names:
        runs = []
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                qs[n](spark, sf).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
            times[n] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001 - report, keep going
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "total_seconds_headline_queries" if which == "headline" else "total_seconds_queries",
           "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": cpus, "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
