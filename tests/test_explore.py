from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import month
from ledgerloom.operators import charts, explore
from ledgerloom.operators.panel import monthly_panel

ROWS = [
    ("A", "2020-01-10", 10, "acid"),
    ("A", "2020-01-10", 20, "acid"),
    ("A", "2020-01-11", 30, "acid"),
    ("B", "2021-03-01", 5, "base"),
]


def test_volume_and_pivot(ledger, rows_of):
    book = ledger(ROWS)
    assert rows_of(explore.volume_by_year(book)) == [("A", 2020, 3.0), ("B", 2021, 1.0)]
    assert rows_of(explore.volume_pivot(book, [2020, 2021])) == [("A", 3.0, 0.0), ("B", 0.0, 1.0)]


def test_share(ledger, rows_of):
    assert rows_of(explore.volume_share(ledger(ROWS), "rm_code")) == [("A", 3.0, 75.0), ("B", 1.0, 25.0)]


def test_codes(ledger, rows_of):
    book = ledger(ROWS + [("C", "2020-01-01", 1, "acid")])
    assert rows_of(explore.codes_per_group(book)) == [("acid", 2, True), ("base", 1, False)]
    assert rows_of(explore.code_catalog(book)) == [("acid", "A", 3), ("acid", "C", 1), ("base", "B", 1)]
    assert rows_of(explore.codes_by_group(book)) == [("acid", "A"), ("acid", "C"), ("base", "B")]


@pytest.fixture
def two_level(spark, ledger):
    days = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-03-31')) AS date")
    days = days.withColumns(
        {"GAS": F.month("date").cast("double"), "OIL": (10 - F.month("date")).cast("double")}
    )
    book = ledger([r for r in ROWS if r[0] == "A"] + [("A", "2020-03-01", 40, "acid")])
    return explore.two_level_panel(book, explore.monthly_indices(days, ["GAS", "OIL"]), ["GAS", "OIL"], 12)


def test_mean_of_daily_means_and_empty_month(two_level, rows_of):
    assert rows_of(two_level, "month_idx", "weight", "price", "GAS", "date") == [
        (month(2020, 1), 3.0, 22.5, 1.0, date(2020, 1, 1)),
        (month(2020, 2), 0.0, None, 2.0, date(2020, 2, 1)),
        (month(2020, 3), 1.0, 40.0, 3.0, date(2020, 3, 1)),
    ]


def test_correlation_counts_nulls_as_zero(two_level):
    import numpy as np

    got = {r["driver"]: r for r in explore.driver_correlation(two_level, ["GAS", "OIL"]).collect()}
    expected = np.corrcoef([1, 2, 3], [22.5, 0, 40])[0, 1]
    assert got["GAS"]["correlation"] == pytest.approx(expected)
    assert got["OIL"]["correlation"] == pytest.approx(-expected)
    assert got["GAS"]["is_best"] and not got["OIL"]["is_best"]


def test_peak_shift(two_level, rows_of):
    assert rows_of(explore.peak_shift_days(two_level, ["GAS", "OIL"])) == [
        ("A", date(2020, 3, 1), "GAS", date(2020, 3, 1), 0),
        ("A", date(2020, 3, 1), "OIL", date(2020, 1, 1), 60),
    ]


def test_site_flags(spark, ledger, rows_of):
    book = ledger(ROWS).withColumn("site", F.when(F.col("rm_code") == "A", "CH").otherwise("DE"))
    flags = explore.site_flags(book, ["CH", "DE"])
    assert rows_of(flags, "rm_code", "date", "weight", "price", "SITE_CH", "SITE_DE") == [
        ("A", date(2020, 1, 10), 2.0, 15.0, 1, 0),
        ("A", date(2020, 1, 11), 1.0, 30.0, 1, 0),
        ("B", date(2021, 3, 1), 1.0, 5.0, 0, 1),
    ]


def test_price_evolution(ledger, rows_of):
    lines = charts.price_evolution(monthly_panel(ledger(ROWS)))
    assert rows_of(lines.where("rm_code = 'B'"), "year_month", "is_tick", "price") == [("2021-3", True, 5.0)]


def test_correlation_of_what_does_not_vary(spark):
    rows = [("flat", 5.0, 1.0, 7.0), ("flat", 5.0, 2.0, 7.0), ("up", 1.0, 1.0, 7.0), ("up", 2.0, 2.0, 7.0), ("up", 4.0, 3.0, 7.0)]
    panel = spark.createDataFrame(rows, "rm_code string, price double, GAS double, OIL double")
    got = {(r["rm_code"], r["driver"]): r for r in explore.driver_correlation(panel, ["GAS", "OIL"]).collect()}
    assert [got[k]["correlation"] for k in (("flat", "GAS"), ("flat", "OIL"), ("up", "OIL"))] == [None] * 3
    assert got["up", "GAS"]["correlation"] == pytest.approx(0.9819805)
    assert {k for k, r in got.items() if r["is_best"]} == {("up", "GAS")}
