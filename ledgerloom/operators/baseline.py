"""Persistence forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.config import ForecastWindow, check_horizon
from ledgerloom.functions.metrics import mae, mape, mse, r2
from ledgerloom.operators.split import in_test_windows


def persistence_mape(
    features: DataFrame, horizons: list[int], windows: list[ForecastWindow]
) -> DataFrame:
    """Error of "the price stays as ``h`` months ago" per code, horizon and window.

    All horizons come out of one aggregation and are unfolded afterwards. A
    window without purchases gives no row.
    """
    for h in horizons:
        check_horizon(h)
    per_window = (
        in_test_windows(features, windows)
        .groupBy("rm_code", "test")
        .agg(
            F.count("average_price").alias("n"),
            *[(100 * mape("average_price", f"AR_{h}")).alias(f"_h{h}") for h in horizons],
        )
    )
    pairs = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("mape_pct")) for h in horizons]
    )
    return per_window.select("rm_code", "test", "n", F.inline(pairs))


def naive_backtest(
    features: DataFrame, horizons: list[int], windows: list[ForecastWindow]
) -> DataFrame:
    """Unweighted mean of the window errors per code and horizon."""
    return mean_over_windows(persistence_mape(features, horizons, windows), ["rm_code", "horizon"])


def mean_over_windows(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count("mape_pct").alias("n_windows"), F.avg("mape_pct").alias("mape_pct")
    )


def naive_shift_forecast(purchased: DataFrame, period: int, price: str = "avg_price") -> DataFrame:
    """Forecast each purchased month by the ``period``-th purchased month before it.

    Rows are counted, not calendar months. ``purchased`` has one row per code
    and month with a purchase; the first ``period`` rows of a code have no forecast.
    """
    check_horizon(period)
    by_code = Window.partitionBy("rm_code").orderBy("month_idx")
    return purchased.withColumn("predicted_price", F.lag(price, period).over(by_code)).where(
        F.col("predicted_price").isNotNull()
    )


def naive_errors(
    forecast: DataFrame, keys: list[str], actual: str = "avg_price", predicted: str = "predicted_price"
) -> DataFrame:
    """Size and errors of a forecast, MAPE both as fraction and percent."""
    return forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        mape(actual, predicted).alias("mape"),
        (100 * mape(actual, predicted)).alias("mape_pct"),
        mse(actual, predicted).alias("mse"),
        mae(actual, predicted).alias("mae"),
        r2(actual, predicted).alias("r2"),
    )


def largest_errors(
    forecast: DataFrame, k: int, tie_break: list[str], actual: str = "avg_price", predicted: str = "predicted_price"
) -> DataFrame:
    """The ``k`` rows with the largest absolute error, in a total order."""
    miss = F.abs(F.col(actual) - F.col(predicted)).alias("abs_error")
    return forecast.select("*", miss).orderBy(F.desc("abs_error"), *tie_break).limit(k)
