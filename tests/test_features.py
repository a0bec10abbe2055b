import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import month
from ledgerloom.config import LagWindow, YearWindow
from ledgerloom.functions.months import in_period, months_back
from ledgerloom.operators import encode
from ledgerloom.operators import features as X
from ledgerloom.operators import panel as P
from ledgerloom.operators.clean import clean_ledger
from ledgerloom.operators.quality import check_feature_columns

YEARS = YearWindow(2019, 2021)


def series(spark, values, driver="GAS", first=month(2020, 1)):
    rows = [(driver, first + k, float(v)) for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "driver string, month_idx int, value double")


def test_lags_follow_the_calendar_not_the_rows(ledger, rows_of):
    """With a month nobody ever buys in, the row before is two months back."""
    book = ledger([("A", "2020-01-05", 1), ("A", "2020-02-05", 2), ("A", "2020-04-05", 4)])
    lagged = X.ar_lags(P.monthly_panel(book), LagWindow(1, 2))
    assert rows_of(lagged, "month_idx", "AR_1", "AR_2") == [
        (month(2020, 1), None, None),
        (month(2020, 2), 1.0, None),
        (month(2020, 4), None, 2.0),
    ]


def test_lag_crosses_the_year(ledger, rows_of):
    book = ledger([("A", "2019-12-31", 7), ("A", "2020-01-31", 8)])
    lagged = X.ar_lags(P.monthly_panel(book), LagWindow(1, 1)).where("not is_imputed")
    assert rows_of(lagged, "month_idx", "AR_1") == [(month(2019, 12), None), (month(2020, 1), 7.0)]


def test_filled_month_feeds_lags_but_is_no_target(spark, ledger, rows_of):
    book = ledger(
        [("A", "2020-01-05", 1), ("A", "2020-03-05", 3), *[("B", f"2020-0{m}-01", 9) for m in (1, 2, 3)]]
    )
    drivers = series(spark, [100, 200, 300])
    matrix = X.feature_matrix(P.monthly_panel(book), drivers, ["GAS"], LagWindow(1, 2), YEARS)
    assert rows_of(matrix.where("rm_code = 'A'"), "month_idx", "average_price", "GAS_1", "GAS_2", "AR_1", "AR_2") == [
        (month(2020, 3), 3.0, 200.0, 100.0, 1.0, 1.0)
    ]


def test_rows_without_a_driver_value_are_dropped(spark, ledger, rows_of):
    book = ledger([("A", f"2020-0{m}-05", m) for m in range(1, 6)])
    drivers = series(spark, [10, 20])
    matrix = X.feature_matrix(P.monthly_panel(book), drivers, ["GAS"], LagWindow(1, 1), YEARS)
    assert rows_of(matrix, "month_idx", "GAS_1") == [(month(2020, 2), 10.0), (month(2020, 3), 20.0)]


def test_first_driver_sets_the_months(spark, rows_of):
    both = series(spark, [1, None, 3]).unionByName(series(spark, [10, 20, 30, 40], "OIL"))
    assert rows_of(X.driver_panel(both, ["GAS", "OIL"])) == [
        (month(2020, 1), 1.0, 10.0),
        (month(2020, 3), 3.0, 30.0),
    ]
    assert X.driver_panel(both, ["OIL", "GAS"]).count() == 4


def test_driver_lags_reach_past_the_series(spark, rows_of):
    lagged = X.driver_lags(series(spark, [1, 2]), ["GAS"], LagWindow(1, 2), YEARS)
    assert rows_of(lagged) == [
        (month(2020, 2), 1.0, None),
        (month(2020, 3), 2.0, 1.0),
        (month(2020, 4), None, 2.0),
    ]


def test_large_driver_table_is_not_hinted(spark, monkeypatch):
    left = spark.range(5).select(F.col("id").cast("int").alias("month_idx"))
    wide = spark.range(5).select(F.col("id").cast("int").alias("month_idx"), F.lit(1.0).alias("v"))

    def hinted():
        joined = X.join_monthly(left, wide, 5)
        assert joined.count() == 5
        return "strategy=broadcast" in joined._jdf.queryExecution().logical().toString()

    assert hinted()
    monkeypatch.setattr(X, "BROADCAST_BYTES", 10)
    assert not hinted()


def test_prune_keeps_lag_eleven(spark):
    lags = LagWindow(1, 12)
    names = X.feature_names(["GAS"], lags)
    frame = spark.range(1).select(*[F.lit(1.0).alias(n) for n in names])
    pruned = X.prune_horizon(frame, ["GAS"], lags, 3)
    assert set(pruned.columns) == set(X.feature_names(["GAS"], lags, 3))
    assert "AR_11" in pruned.columns and "AR_1" not in pruned.columns
    check_feature_columns(pruned, ["GAS"], lags, 3)
    with pytest.raises(ValueError, match="AR_1 is not known"):
        check_feature_columns(frame, ["GAS"], lags, 3)
    with pytest.raises(ValueError, match="AR_1 is absent"):
        check_feature_columns(pruned, ["GAS"], lags, 1)
    with pytest.raises(ValueError, match="not double"):
        check_feature_columns(pruned.withColumn("AR_4", F.lit(1)), ["GAS"], lags, 3)


def test_one_hot_and_interactions(spark, rows_of):
    frame = spark.createDataFrame([("A/1", 2.0), ("A/2", 3.0)], "rm_code string, AR_1 double")
    hot = encode.one_hot_codes(frame, ["A/1", "A/2"])
    crossed = X.interaction_terms(hot, ["A/1", "A/2"], LagWindow(1, 1))
    assert rows_of(crossed, "rm_code", "`A/1_AR_1`", "`A/2_AR_1`") == [("A/1", 2.0, 0.0), ("A/2", 0.0, 3.0)]
    assert len(crossed.columns) == len(hot.columns) + 2
    assert rows_of(encode.base_category(hot, ["A/1"]), "rm_code") == [("A/2",)]


def test_one_hot_of_null_is_zero(spark, rows_of):
    frame = spark.createDataFrame([(1,), (None,)], "YEAR int")
    assert rows_of(encode.one_hot(frame, "YEAR", [1]), "YEAR_1") == [(0,), (1,)]
    assert encode.one_hot_names("YEAR", [1, 2]) == ["YEAR_1", "YEAR_2"]


def test_month_offset_clips(spark, rows_of):
    frame = spark.createDataFrame([(datetime(2020, 3, 31),)], "ts timestamp_ntz")
    assert rows_of(frame.select(months_back("ts", 1), months_back("ts", 4))) == [
        (date(2020, 2, 29), date(2019, 11, 30))
    ]


def test_period_ends_are_included(spark, rows_of):
    days = [date(2020, 2, 22), date(2020, 2, 23), date(2022, 3, 7), date(2022, 3, 8)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in frame.orderBy("d").select(in_period("d")).collect()] == [0, 1, 1, 0]


@pytest.mark.parametrize("seed", [4, 5])
def test_lags_equal_a_self_join(spark, seed):
    """Random ledgers with holes in the calendar; every lag against a join on its month."""
    rng = random.Random(seed)
    rows = [
        (f"c{rng.randrange(12)}", datetime(rng.choice([2018, 2020]), rng.choice([1, 2, 4, 11, 12]), 7), float(rng.randrange(99)))
        for _ in range(150)
    ]
    frame = spark.createDataFrame(rows, "rm_code string, ts timestamp_ntz, price double")
    panel = P.monthly_panel(clean_ledger(frame, YearWindow(2010, 2024)))
    lagged = X.ar_lags(panel, LagWindow(1, 12))
    known = {(r["rm_code"], r["month_idx"]): r["price"] for r in panel.collect()}
    for row in lagged.collect():
        for i in range(1, 13):
            assert row[f"AR_{i}"] == known.get((row["rm_code"], row["month_idx"] - i))
