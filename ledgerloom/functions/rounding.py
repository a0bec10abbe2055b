"""Rounding for results that are compared across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def whole(value) -> Column:
    """Nearest whole number as a double, halves up. Stays in generated code."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value + 0.5).cast("double")


def scaled_round(value, places: int = 6) -> Column:
    """Round the scaled double, so ties fall the same way in every IEEE engine."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**places)
    return whole(value * scale) / scale


def round_columns(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({name: scaled_round(name, places) for name in names})
