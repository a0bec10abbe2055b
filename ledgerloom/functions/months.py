"""Calendar expressions.

A month is carried as one int, ``month_idx = 12 * year + month - 1``, so that a
lag is a subtraction and a RANGE frame can run over it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

# The pandemic period used as a 0/1 feature.
PANDEMIC = (date(2020, 2, 23), date(2022, 3, 7))


def month_idx(ts) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def year_of(idx) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(idx / 12).cast("int")


def month_of(idx) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return (F.pmod(idx, F.lit(12)) + 1).cast("int")


def first_day(idx) -> Column:
    return F.make_date(year_of(idx), month_of(idx), F.lit(1))


def mid_month(idx) -> Column:
    """Nominal moment of a month without purchases: its 15th."""
    return F.make_date(year_of(idx), month_of(idx), F.lit(15)).cast("timestamp_ntz")


def month_label(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def plain_label(year, month) -> Column:
    """Unpadded ``year-month`` text, as used on chart axes."""
    return F.concat_ws("-", F.col(year).cast("string"), F.col(month).cast("string"))


def months_back(ts, months: int) -> Column:
    """Same day ``months`` earlier, clipped to the end of a shorter month."""
    return F.add_months(F.col(ts).cast("date"), -months)


def is_quarter_end(month) -> Column:
    return F.col(month) % 3 == 0


def in_period(ts, period: tuple[date, date] = PANDEMIC) -> Column:
    """1 inside the period, both ends included, else 0."""
    day = F.col(ts).cast("date")
    return day.between(F.lit(period[0]), F.lit(period[1])).cast("int")


def calendar_parts(ts) -> dict[str, Column]:
    day = F.col(ts)
    return {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "week": F.weekofyear(day),
        "day": F.dayofmonth(day),
    }
