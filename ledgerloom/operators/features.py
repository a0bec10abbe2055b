"""Lag features.

All autoregressive lags share one sort and one Window node. Driver lags are
worked out on the small driver table and reach the panel in a single join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.config import LagWindow, YearWindow, check_horizon

# A wide driver table above this size is joined without a broadcast hint.
BROADCAST_BYTES = 64 * 1024 * 1024


def ar_names(lags: Iterable[int]) -> list[str]:
    return [f"AR_{lag}" for lag in lags]


def driver_names(drivers: Iterable[str], lags: Iterable[int]) -> list[str]:
    drivers = list(drivers)
    return [f"{driver}_{lag}" for lag in lags for driver in drivers]


def feature_names(drivers: Iterable[str], lags: LagWindow, horizon: int = 1) -> list[str]:
    """Feature columns usable ``horizon`` months ahead, drivers first."""
    usable = lags.from_horizon(horizon)
    return driver_names(drivers, usable) + ar_names(usable)


def ar_lags(panel: DataFrame, lags: LagWindow, value: str = "price", within: tuple[str, ...] = ()) -> DataFrame:
    """``AR_i``: the code's value exactly ``i`` calendar months earlier, or null; ``within`` as in ``spread_months``."""
    by_code = Window.partitionBy(*within, "rm_code").orderBy("month_idx")
    return panel.withColumns(
        {f"AR_{i}": F.max(value).over(by_code.rangeBetween(-i, -i)) for i in lags.lags}
    )


def driver_panel(drivers: DataFrame, names: list[str]) -> DataFrame:
    """Long monthly series to one column per driver.

    Only months of the first driver are kept; the others are joined to it.
    """
    wide = drivers.groupBy("month_idx").pivot("driver", names).agg(F.first("value"))
    return wide.where(F.col(f"`{names[0]}`").isNotNull())


def driver_lags(
    drivers: DataFrame, names: list[str], lags: LagWindow, years: YearWindow
) -> DataFrame:
    """``<driver>_i`` per month: the driver ``i`` months earlier.

    Each month is sent to the months that look back on it, so no window over the
    whole table is needed. At most ``12 * years + last lag`` rows come out.
    """
    inside = F.col("month_idx").between(years.first * 12, years.last * 12 + 11)
    wide = driver_panel(drivers.where(inside), names)
    ahead = wide.withColumn("lag", F.explode(F.array(*[F.lit(i) for i in lags.lags])))
    return ahead.groupBy((F.col("month_idx") + F.col("lag")).alias("month_idx")).agg(
        *[
            F.max(F.when(F.col("lag") == i, F.col(f"`{name}`"))).alias(f"{name}_{i}")
            for i in lags.lags
            for name in names
        ]
    )


def join_monthly(df: DataFrame, wide: DataFrame, n_months: int, how: str = "inner") -> DataFrame:
    """Join a table with one row per month; broadcast while its bound is small.

    The bound is the calendar (``n_months``) times the column count. Beyond it
    the hint is left out and Spark plans the join from runtime sizes.
    """
    if n_months * len(wide.columns) * 16 <= BROADCAST_BYTES:
        wide = F.broadcast(wide)
    return df.join(wide, "month_idx", how)


def feature_matrix(
    panel: DataFrame,
    drivers: DataFrame,
    names: list[str],
    lags: LagWindow,
    years: YearWindow,
) -> DataFrame:
    """Purchased months with every lag known: id columns, ``<driver>_i``, ``AR_i``.

    Filled months serve as lag sources but are no targets.
    """
    target = ar_lags(panel, lags).where(~F.col("is_imputed"))
    wide = driver_lags(drivers, names, lags, years)
    joined = join_monthly(target, wide, years.n_months + lags.last)
    columns = driver_names(names, lags.lags) + ar_names(lags.lags)
    ids = [c for c in ("rm_code", "group_desc", "month_idx", "ts") if c in panel.columns]
    return joined.select(*ids, F.col("price").alias("average_price"), *columns).na.drop(
        "any", subset=columns
    )


def ar_matrix(panel: DataFrame, lags: LagWindow) -> DataFrame:
    """As ``feature_matrix`` with autoregressive features only."""
    ids = [c for c in ("rm_code", "group_desc", "month_idx", "ts") if c in panel.columns]
    target = ar_lags(panel, lags).where(~F.col("is_imputed"))
    columns = ar_names(lags.lags)
    return target.select(*ids, F.col("price").alias("average_price"), *columns).na.drop(
        "any", subset=columns
    )


def prune_horizon(features: DataFrame, names: Iterable[str], lags: LagWindow, horizon: int) -> DataFrame:
    """Drop the lags that are not known yet ``horizon`` months ahead."""
    check_horizon(horizon)
    families = ["AR", *names]
    late = [f"{family}_{i}" for family in families for i in lags.lags if i < horizon]
    return features.drop(*late)


def interaction_terms(df: DataFrame, codes: Iterable, lags: LagWindow) -> DataFrame:
    """Products ``<code>_AR_i`` of one-hot columns and autoregressive features."""
    return df.withColumns(
        {
            f"{code}_{ar}": F.col(f"`{code}`").cast("double") * F.col(ar)
            for code in codes
            for ar in ar_names(lags.lags)
        }
    )
