"""Daily calendar dimension and the series joined onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def with_calendar_columns(days: DataFrame, day: str = "date") -> DataFrame:
    at = F.col(day)
    return days.select(
        at,
        F.dayofmonth(at).alias("day"),
        F.date_format(at, "EEEE").alias("weekday"),
        F.month(at).alias("month"),
        F.year(at).alias("year"),
        F.weekofyear(at).alias("iso_week"),
        F.extract(F.lit("YEAROFWEEK"), at).cast("int").alias("iso_year"),
    )


def calendar(spark: SparkSession, first: Column, last: Column) -> DataFrame:
    """One row per day from ``first`` to ``last``, both included."""
    days = F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))
    return with_calendar_columns(spark.range(1).select(F.explode(days).alias("date")))


def calendar_of(facts: DataFrame, ts: str = "ts") -> DataFrame:
    """Calendar spanning the dates that occur in ``facts``."""
    span = facts.agg(F.min(ts).cast("date").alias("a"), F.max(ts).cast("date").alias("b"))
    days = F.sequence("a", "b", F.expr("interval 1 day"))
    return with_calendar_columns(span.select(F.explode(days).alias("date")))


def join_long(days: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """Left-join ``(driver, date, value)`` onto a calendar, a column per name: one pass over all series."""
    wide = series.groupBy("date").pivot("driver", names).agg(F.first("value"))
    return days.join(wide, "date", "left")


def spread_over_months(days: DataFrame, names: list[str]) -> DataFrame:
    """Repeat a value known on some days of a month on all its days.

    A window holds one month of the calendar.
    """
    month = Window.partitionBy("year", "month")
    return days.withColumns({name: F.max(name).over(month) for name in names})


def join_series(days: DataFrame, daily: dict[str, DataFrame], monthly: dict[str, DataFrame]) -> DataFrame:
    """Left-join index series onto a calendar.

    Daily series are ``(date, value)``; monthly ones are ``(year, month, value)``
    and repeat on every day of their month. For series from different sources;
    ``join_long`` takes many series of one source in one pass.
    """
    for name, series in daily.items():
        days = days.join(series.select("date", F.col("value").alias(name)), "date", "left")
    for name, series in monthly.items():
        values = series.select("year", "month", F.col("value").alias(name))
        days = days.join(values, ["year", "month"], "left")
    return days
