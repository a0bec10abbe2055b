"""Chart-ready frames; drawing is left to the caller."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.months import is_quarter_end, month_of, plain_label, year_of


def actual_vs_predicted(
    df: DataFrame, ids: list[str], actual: str, predicted: str, cut: date, ts: str = "ts"
) -> DataFrame:
    """Long form: one row per id and kind, flagged from the forecast cut on."""
    kinds = F.array(
        F.struct(F.lit("ground_truth").alias("kind"), F.col(actual).alias("value")),
        F.struct(F.lit("prediction").alias("kind"), F.col(predicted).alias("value")),
    )
    after = F.col(ts) >= F.lit(cut).cast("timestamp_ntz")
    return df.select(*ids, after.alias("is_forecast"), F.inline(kinds))


def price_evolution(panel: DataFrame) -> DataFrame:
    """Mean price per group, code and month with an axis label and tick flag."""
    year, month = year_of("month_idx").alias("year"), month_of("month_idx").alias("month")
    lines = panel.select("group_desc", "rm_code", year, month, "price")
    return (
        lines.groupBy("group_desc", "rm_code", "year", "month")
        .agg(F.avg("price").alias("price"))
        .withColumn("year_month", plain_label("year", "month"))
        .withColumn("is_tick", is_quarter_end("month"))
    )
