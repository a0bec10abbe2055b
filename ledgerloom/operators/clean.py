"""Ledger cleaning and filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import YearWindow
from ledgerloom.functions.months import month_idx


def in_years(ts, years: YearWindow) -> Column:
    """Inclusive year filter on the raw timestamp, so the scan can skip row groups."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    first = F.lit(date(years.first, 1, 1)).cast("timestamp_ntz")
    after = F.lit(date(years.last + 1, 1, 1)).cast("timestamp_ntz")
    return (ts >= first) & (ts < after)


def lower_groups(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("group_desc", F.lower("group_desc")) if "group_desc" in ledger.columns else ledger


def clean_ledger(ledger: DataFrame, years: YearWindow, extra: Iterable[str] = ()) -> DataFrame:
    """Columns a panel needs, inside the years, with month keys.

    ``extra`` names further columns to keep (weight, site). Rows are not
    sorted: order means nothing to a distributed frame.
    """
    keep = ["rm_code", *(c for c in ("group_desc",) if c in ledger.columns), "ts", "price", *extra]
    clean = lower_groups(ledger.select(*keep).where(in_years("ts", years)))
    return clean.withColumns(
        {
            "price": F.col("price").cast("double"),
            "year": F.year("ts"),
            "month": F.month("ts"),
            "month_idx": month_idx("ts"),
        }
    )


def only_codes(df: DataFrame, codes: Iterable) -> DataFrame:
    """Rows of the requested codes; reaches the scan as an IN filter."""
    return df.where(F.col("rm_code").isin(list(codes)))


def only_codes_of(df: DataFrame, request: DataFrame) -> DataFrame:
    """Rows whose code occurs in another frame; for lists too long for a literal."""
    return df.join(request.select("rm_code"), "rm_code", "left_semi")


def complete_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns is not None else None)
