"""End-to-end plans. Each is one lazy frame from scan to result."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.config import ELECTRICITY, ForecastWindow, JobRequest, LagWindow, YearWindow, driver_name
from ledgerloom.functions.months import month_idx
from ledgerloom.operators.baseline import mean_over_windows, naive_backtest, persistence_mape
from ledgerloom.operators.clean import clean_ledger, lower_groups
from ledgerloom.operators.encode import one_hot_codes
from ledgerloom.operators.explore import driver_correlation, monthly_indices, peak_shift_days, two_level_panel
from ledgerloom.operators.features import ar_matrix, feature_matrix
from ledgerloom.operators.lasso import backtest
from ledgerloom.operators.month_bits import month_bits
from ledgerloom.operators.panel import monthly_panel
from ledgerloom.operators.quality import (
    check_feature_columns,
    driver_report,
    feature_report,
    ledger_report,
    require,
)
from ledgerloom.sources.archive import read_archive
from ledgerloom.sources.drivers import monthly_series, read_driver_series, read_electricity
from ledgerloom.sources.ledger import read_ledger


def read_request(
    spark: SparkSession, request: JobRequest, driver_paths: Mapping[str, str], archive: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ledger and drivers of a request from landed CSV files.

    Series without a path of their own come from the ``archive``, in one scan.
    """
    series, paths = [], {driver_name(name): path for name, path in driver_paths.items()}
    archived = [d for d in request.drivers if archive and d != ELECTRICITY and d not in paths]
    if archived:
        series.append(read_archive(spark, archive, archived, request.driver_years))
    for driver in request.drivers:
        if driver in archived:
            continue
        if driver == ELECTRICITY:
            series.append(read_electricity(spark, request.electricity_path, request.driver_years))
        else:
            path = paths[driver]
            series.append(read_driver_series(spark, path, driver, request.driver_years))
    return read_ledger(spark, request.ledger_path), reduce(DataFrame.unionByName, series)


def feature_plan(
    ledger: DataFrame, drivers: DataFrame, request: JobRequest, check: bool = False
) -> DataFrame:
    """Feature run of a job request: clean, fill, lag, drop filled months.

    ``ledger`` is normalised, ``drivers`` long and cleaned. The requested codes
    become one-hot columns. ``check`` runs the checks on ledger, drivers, columns
    and rows of the matrix and raises; a requested driver or code without rows is
    one of them. The ledger is judged before its year filter, which would hide
    rows without a date.
    """
    clean = clean_ledger(ledger, request.price_years)
    names, codes = list(request.drivers), list(request.rm_codes)
    if check:
        require(ledger_report(lower_groups(ledger), codes, request.target))
        require(driver_report(drivers, names))
    features = feature_matrix(
        monthly_panel(clean, codes=codes), monthly_series(drivers), names, request.lags, request.driver_years
    )
    if check:
        check_feature_columns(features, names, request.lags)
        bought = month_bits(clean, F.col("price").isNotNull())
        require(feature_report(features, bought, names, request.lags))
    return one_hot_codes(features, codes)


def naive_plan(
    ledger: DataFrame, years: YearWindow, lags: LagWindow, horizons: list[int], windows: list[ForecastWindow]
) -> DataFrame:
    """How wrong is "as ``h`` months ago", per code, averaged over the windows?"""
    panel = monthly_panel(clean_ledger(ledger, years))
    return naive_backtest(ar_matrix(panel, lags), horizons, windows)


def forecast_plan(
    features: DataFrame, drivers: list[str], lags: LagWindow, horizons: list[int], windows: list[ForecastWindow]
) -> DataFrame:
    """Mean window error per code and horizon: persistence, AR models, AR and drivers."""
    keys = ["rm_code", "feature_set", "horizon"]
    models = backtest(features, drivers, lags, horizons, windows).where("status = 'ok'")
    naive = persistence_mape(features, horizons, windows).withColumn("feature_set", F.lit("NAIVE"))
    columns = [*keys, "test", "mape_pct"]
    return mean_over_windows(models.select(*columns).unionByName(naive.select(*columns)), keys)


def exploration_plan(
    ledger: DataFrame, calendar_rows: DataFrame, names: list[str], n_months: int
) -> dict[str, DataFrame]:
    """Monthly panel beside its indices, correlations and peak shifts."""
    months = calendar_rows.agg(F.collect_set(month_idx("date")).alias("months")).scalar()
    panel = two_level_panel(ledger, monthly_indices(calendar_rows, names), names, n_months, months)
    return {
        "panel": panel,
        "correlation": driver_correlation(panel, names),
        "peak_shift": peak_shift_days(panel, names),
    }
