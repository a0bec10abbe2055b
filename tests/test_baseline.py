from datetime import date, datetime

import pytest

from conftest import month
from ledgerloom.config import ForecastWindow, LagWindow, half_years
from ledgerloom.operators import baseline as B
from ledgerloom.operators import charts, split
from ledgerloom.operators import panel as P
from ledgerloom.operators.features import ar_matrix


@pytest.fixture
def matrix(ledger):
    rows = [("A", f"2020-{m:02d}-05", 10 * m) for m in range(1, 13)]
    rows += [("B", f"2020-{m:02d}-05", 5) for m in range(1, 13)]
    return ar_matrix(P.monthly_panel(ledger(rows)), LagWindow(1, 3))


def test_persistence_by_hand(matrix, rows_of):
    window = ForecastWindow(date(2020, 5, 1), date(2020, 7, 1))
    scores = B.persistence_mape(matrix, [1, 3], [window]).where("rm_code = 'A'")
    expected = {1: 100 * (10 / 50 + 10 / 60) / 2, 3: 100 * (30 / 50 + 30 / 60) / 2}
    got = {r["horizon"]: (r["n"], r["mape_pct"]) for r in scores.collect()}
    assert got == {h: (2, pytest.approx(v)) for h, v in expected.items()}


def test_perfect_forecast_is_allowed(matrix, rows_of):
    window = ForecastWindow(date(2020, 5, 1), date(2020, 7, 1))
    scores = B.persistence_mape(matrix, [1], [window]).where("rm_code = 'B'")
    assert rows_of(scores, "mape_pct") == [(0.0,)]


def test_empty_window_gives_no_row(matrix):
    assert B.persistence_mape(matrix, [1], [("2022-01-01", "2022-07-01")]).count() == 0


def test_backtest_is_the_plain_mean_of_windows(matrix):
    windows = half_years(date(2020, 1, 1), 2)
    per_window = B.persistence_mape(matrix, [1], windows).where("rm_code = 'A'").toPandas()
    mean = B.naive_backtest(matrix, [1], windows).where("rm_code = 'A'").first()
    assert mean["n_windows"] == 2
    assert mean["mape_pct"] == pytest.approx(per_window["mape_pct"].mean())


def test_shift_counts_purchased_months(ledger, rows_of):
    book = ledger([("A", "2020-01-05", 1), ("A", "2020-03-05", 3), ("A", "2020-04-05", 4)])
    forecast = B.naive_shift_forecast(P.monthly_avg_price(book), 1)
    assert rows_of(forecast, "month_idx", "predicted_price") == [
        (month(2020, 3), 1.0),
        (month(2020, 4), 3.0),
    ]


def test_errors_by_hand(spark):
    frame = spark.createDataFrame(
        [("g", 10.0, 8.0), ("g", 20.0, 25.0)], "g string, avg_price double, predicted_price double"
    )
    row = B.naive_errors(frame, ["g"]).first()
    assert row["mape"] == pytest.approx((0.2 + 0.25) / 2)
    assert row["mape_pct"] == pytest.approx(22.5)
    assert row["mse"] == pytest.approx((4 + 25) / 2)
    assert row["mae"] == pytest.approx(3.5)
    assert row["r2"] == pytest.approx(1 - 14.5 / 25)


def test_zero_actual_does_not_divide_by_zero(spark):
    frame = spark.createDataFrame([("g", 0.0, 1.0)], "g string, avg_price double, predicted_price double")
    row = B.naive_errors(frame, ["g"]).first()
    assert row["mape"] > 1e15 and row["r2"] is None


def test_largest_errors_has_a_total_order(spark, rows_of):
    frame = spark.createDataFrame(
        [(k, 10.0, 8.0) for k in range(5)], "rm_code int, avg_price double, predicted_price double"
    )
    assert rows_of(B.largest_errors(frame, 2, ["rm_code"]), "rm_code") == [(0,), (1,)]


def test_windows_are_half_open(spark, rows_of):
    frame = spark.createDataFrame(
        [(datetime(2020, 1, 1),), (datetime(2020, 7, 1),)], "ts timestamp_ntz"
    )
    windows = [("2020-01-01", "2020-07-01"), ("2020-07-01", "2021-01-01")]
    assert rows_of(split.in_test_windows(frame, windows), "test", "ts") == [
        (1, datetime(2020, 1, 1)),
        (2, datetime(2020, 7, 1)),
    ]
    rows = rows_of(split.train_test_rows(frame, windows), "test", "is_test", "ts")
    assert rows == [
        (1, True, datetime(2020, 1, 1)),
        (2, False, datetime(2020, 1, 1)),
        (2, True, datetime(2020, 7, 1)),
    ]


def test_hash_split_is_stable_and_near_its_share(spark):
    frame = spark.range(5000).withColumnRenamed("id", "k")
    first = split.hash_split(frame.repartition(7), ["k"], 30, 42).where("is_test")
    again = split.hash_split(frame.repartition(2), ["k"], 30, 42).where("is_test")
    assert first.exceptAll(again).count() == 0
    assert 1350 < first.count() < 1650
    other = split.hash_split(frame, ["k"], 30, 43).where("is_test")
    assert other.exceptAll(first).count() > 0


def test_actual_vs_predicted(spark, rows_of):
    frame = spark.createDataFrame(
        [("A", datetime(2020, 1, 1), 1.0, 2.0), ("A", datetime(2020, 2, 1), 3.0, 4.0)],
        "rm_code string, ts timestamp_ntz, y double, p double",
    )
    long = charts.actual_vs_predicted(frame, ["rm_code", "ts"], "y", "p", date(2020, 2, 1))
    assert rows_of(long, "kind", "value", "is_forecast") == [
        ("ground_truth", 1.0, False),
        ("ground_truth", 3.0, True),
        ("prediction", 2.0, False),
        ("prediction", 4.0, True),
    ]
