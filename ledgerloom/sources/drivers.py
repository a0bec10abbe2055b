"""External price-driver series, kept long: ``(driver, month_idx, value)``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom import schemas
from ledgerloom.config import ELECTRICITY, YearWindow, driver_name
from ledgerloom.functions.months import month_idx


def fill_forward(series: DataFrame, order: str, key: str = "driver") -> DataFrame:
    """Replace a null value by the last known one of the same driver.

    One partition holds one driver's dates, so its size is set by the calendar.
    """
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("value", F.last("value", ignorenulls=True).over(past))


def fill_forward_in_blocks(series: DataFrame, order: str, block: Column, key: str = "driver") -> DataFrame:
    """As ``fill_forward``, for series too long for one task.

    ``block`` cuts a series into stretches of time: it must not fall while ``order``
    rises. Each block's last value is carried over the blocks, a row per block, and the
    gaps are then filled inside the blocks, which are spread over all tasks.
    """
    cut = series.withColumn("_block", block)
    last = cut.groupBy(key, "_block").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col(order))).alias("_value")
    )
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        F.col(key).alias("_key"), F.col("_block").alias("_of"), F.last("_value", ignorenulls=True).over(before).alias("_carried")
    )
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("value", F.last("value", ignorenulls=True).over(inside))
    met = filled.join(carried, filled[key].eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    return met.withColumn("value", F.coalesce("value", "_carried")).drop("_key", "_of", "_carried", "_block")


def clean_series(series: DataFrame, years: YearWindow, block: Column | None = None) -> DataFrame:
    """``(driver, date, value)`` inside the years, gaps filled forward.

    The year filter comes first: a value from before the window fills nothing. ``block``
    cuts long series into stretches that are filled in tasks of their own.
    """
    inside = series.where(
        F.col("date").between(F.lit(date(years.first, 1, 1)), F.lit(date(years.last, 12, 31)))
    )
    filled = fill_forward(inside, "date") if block is None else fill_forward_in_blocks(inside, "date", block)
    return filled.select(
        "driver", "date", month_idx("date").alias("month_idx"), "value"
    )


def monthly_series(daily: DataFrame) -> DataFrame:
    """Monthly mean per driver; a monthly series passes through unchanged."""
    return daily.groupBy("driver", "month_idx").agg(F.avg("value").alias("value"))


def clean_year_month(raw: DataFrame, years: YearWindow, driver: str = ELECTRICITY) -> DataFrame:
    """Rows of ``(Year, Month, <driver>)`` in any order to the long form."""
    return raw.where(F.col("Year").between(years.first, years.last)).select(
        F.lit(driver).alias("driver"),
        F.make_date("Year", "Month", F.lit(1)).alias("date"),
        (F.col("Year") * 12 + F.col("Month") - 1).alias("month_idx"),
        F.col(driver).alias("value"),
    )


def read_driver_series(
    spark: SparkSession,
    path: str,
    driver: str,
    years: YearWindow,
    fmt: str = "csv",
    date_column: str = "date",
    value_column: str | None = None,
) -> DataFrame:
    """One landed index series; columns are found by name in any case, others are ignored.

    The value column is named like the series unless ``value_column`` is given.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = reader.load(path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    wanted = (date_column, value_column or driver)
    absent = [c for c in wanted if c.lower() not in by_name]
    if absent:
        raise ValueError(f"{path} has no column {' or '.join(absent)}, only {', '.join(raw.columns)}")
    day, value = (by_name[c.lower()] for c in wanted)
    series = raw.select(
        F.lit(driver_name(driver)).alias("driver"),
        F.col(f"`{day}`").cast("date").alias("date"),
        F.col(f"`{value}`").cast("double").alias("value"),
    )
    return clean_series(series, years)


def read_electricity(spark: SparkSession, path: str, years: YearWindow) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    typed = raw.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ELECTRICITY])
    return clean_year_month(typed, years)


def shift_days(series: DataFrame, days: int, floor: str) -> DataFrame:
    """Move a dated series by ``days`` and keep dates from ``floor`` on."""
    return series.withColumn("date", F.date_add("date", days)).where(
        F.col("date") >= F.lit(floor).cast("date")
    )
