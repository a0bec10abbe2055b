"""Seconds per headline query, written to a sink that discards the rows.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the
local cores, ``BENCH_QUERIES`` an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import re
import time

from ledgerloom.plans.queries import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "scan_ledger",
    "clean_ledger",
    "monthly_avg_price",
    "monthly_last",
    "monthly_target",
    "month_grid",
    "missing_cells",
    "grid_left_facts",
    "impute_ffill",
    "ar_lags",
    "feature_matrix",
    "naive_backtest",
    "naive_shift_forecast",
    "forecast_errors",
    "residual_topk",
    "volume_pivot",
    "volume_share_code",
    "monthly_panel_two_level",
    "driver_correlation",
    "price_evolution",
    "standardize_train",
    "robust_scale",
    "lasso_univariate",
    "lasso_ar",
    "ingest_incremental",
    "quality_report",
    "peak_shift_days",
    "calendar_indices",
    "lasso_search_single_lag",
    "lasso_all",
    "backtest_matrix",
    "coef_export",
    "pooled_lasso",
    "tuned_regressor",
    "model_reload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "bench")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    run(names[0])  # starts the engine; not counted
    seconds = {name: run(name) for name in names}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
