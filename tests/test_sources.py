from datetime import date, datetime

import pytest
from pyspark.sql import functions as F, types as T

from conftest import month
from ledgerloom.config import YearWindow
from ledgerloom.operators.clean import clean_ledger, only_codes, only_codes_of
from ledgerloom.sources import calendar as calendars
from ledgerloom.sources import drivers, json_records, sinks
from ledgerloom.sources.ledger import read_ledger

LEDGER_CSV = """,POSTING DATE,Group Description,Key RM code,PRICE (EUR/kg),WEIGHT (kg),SITE,SUPPLIER NUMBER,PURCHASE NUMBER
0,2020-01-05,Acid,C-70,1.5,10,CHBE,7,p1
1,2021-02-06,ACID,C-71,2.5,20,DEBE,8,p2
2,2013-12-31,acid,C-70,9.9,30,CHBE,7,p3
"""


@pytest.fixture
def landed(tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text(LEDGER_CSV)
    return str(path)


def test_ledger_csv_with_index_column(spark, landed, rows_of):
    ledger = read_ledger(spark, landed)
    assert "_c0" not in ledger.columns
    assert dict(ledger.dtypes)["ts"] == "timestamp_ntz" and dict(ledger.dtypes)["price"] == "double"
    clean = clean_ledger(ledger, YearWindow(2014, 2023))
    assert rows_of(clean, "rm_code", "group_desc", "ts", "price", "month_idx") == [
        ("C-70", "acid", datetime(2020, 1, 5), 1.5, month(2020, 1)),
        ("C-71", "acid", datetime(2021, 2, 6), 2.5, month(2021, 2)),
    ]
    assert set(clean.columns) == {"rm_code", "group_desc", "ts", "price", "year", "month", "month_idx"}


def test_ledger_columns_in_another_order(spark, tmp_path, rows_of):
    path = tmp_path / "l.csv"
    path.write_text("Key RM code,PRICE (EUR/kg),Group Description,POSTING DATE\nA,1.5,Acid,2020-01-05T10:00:00\n")
    assert rows_of(read_ledger(spark, str(path)), "rm_code", "ts") == [("A", datetime(2020, 1, 5, 10))]


def test_ledger_without_a_required_column(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("Key RM code,Group Description,POSTING DATE\nA,Acid,2020-01-05\n")
    with pytest.raises(ValueError, match="price"):
        read_ledger(spark, str(path))


def test_parquet_ledger(spark, landed, tmp_path, rows_of):
    raw = spark.read.option("header", True).csv(landed)
    out = str(tmp_path / "p")
    raw.write.parquet(out)
    assert rows_of(read_ledger(spark, out, "parquet")) == rows_of(read_ledger(spark, landed))


def test_code_filters(spark, landed, rows_of):
    ledger = read_ledger(spark, landed)
    assert only_codes(ledger, ["C-71"]).count() == 1
    wanted = spark.createDataFrame([("C-70",), ("C-70",)], "rm_code string")
    assert only_codes_of(ledger, wanted).count() == 2


def test_electricity_month_major_and_padded_months(spark, tmp_path, rows_of):
    path = tmp_path / "e.csv"
    path.write_text(",Year,Month,Electricity\n0,2010,1,46.29\n1,2011,01,56.66\n2,2010,02,43.5\n3,2009,1,1\n")
    clean = drivers.read_electricity(spark, str(path), YearWindow(2010, 2011))
    assert rows_of(clean, "date", "month_idx", "value") == [
        (date(2010, 1, 1), month(2010, 1), 46.29),
        (date(2010, 2, 1), month(2010, 2), 43.5),
        (date(2011, 1, 1), month(2011, 1), 56.66),
    ]


def test_driver_fill_does_not_look_before_the_window(spark, tmp_path, rows_of):
    path = tmp_path / "d.csv"
    path.write_text("date,GAS\n2019-12-01,5\n2020-01-01,\n2020-02-01,7\n2020-03-01,\n")
    clean = drivers.read_driver_series(spark, str(path), "gas", YearWindow(2020, 2020))
    assert rows_of(clean, "driver", "month_idx", "value") == [
        ("GAS", month(2020, 1), None),
        ("GAS", month(2020, 2), 7.0),
        ("GAS", month(2020, 3), 7.0),
    ]


def test_daily_series_becomes_monthly(spark, rows_of):
    rows = [("OIL", date(2020, 1, 1), 1.0), ("OIL", date(2020, 1, 2), None), ("OIL", date(2020, 1, 3), 4.0)]
    daily = spark.createDataFrame(rows, "driver string, date date, value double")
    clean = drivers.clean_series(daily, YearWindow(2020, 2020))
    assert rows_of(drivers.monthly_series(clean)) == [("OIL", month(2020, 1), 2.0)]


def test_shift_days(spark, rows_of):
    rows = [("OIL", date(2019, 12, 1), 1.0), ("OIL", date(2019, 12, 30), 2.0)]
    daily = spark.createDataFrame(rows, "driver string, date date, value double")
    assert rows_of(drivers.shift_days(daily, 3, "2020-01-01"), "date", "value") == [(date(2020, 1, 2), 2.0)]


RECORD = T.StructType(
    [T.StructField("Time", T.TimestampNTZType()), T.StructField("x", T.DoubleType())]
)


def test_json_records(spark, rows_of):
    body = '[{"Time":"2020-01-05T00:00:00.000","x":1.5},{"Time":"2020-02-01","x":null}]'
    frame = spark.createDataFrame([(1, body)], "id int, body string")
    assert rows_of(json_records.parse_json_records(frame, RECORD)) == [
        (1, datetime(2020, 1, 5), 1.5),
        (1, datetime(2020, 2, 1), None),
    ]


@pytest.mark.parametrize(
    "body", ['[{"x":1.5}]', '[{"Time":null,"x":1.5}]', '[{"Time":"soon","x":1.5}]', "not json", None]
)
def test_bad_json_records_fail(spark, body):
    frame = spark.createDataFrame([(body,)], "body string")
    with pytest.raises(Exception):
        json_records.parse_json_records(frame, RECORD).collect()


def test_json_date_column_must_exist(spark):
    frame = spark.createDataFrame([("[]",)], "body string")
    with pytest.raises(ValueError, match="Time"):
        json_records.parse_json_records(frame, T.StructType([RECORD["x"]]))


def test_json_round_trip(spark, rows_of):
    rows = [(datetime(2020, 1, 5, 1, 2, 3, 456789), 1.5), (datetime(2020, 2, 1), None)]
    frame = spark.createDataFrame(rows, RECORD)
    written = json_records.to_json_records(frame).select(F.concat(F.lit("["), "record", F.lit("]")).alias("body"))
    assert rows_of(json_records.parse_json_records(written, RECORD)) == sorted(rows, key=str)
    assert '"x":null' in written.orderBy("body").collect()[1]["body"]


def test_calendar_iso_year(spark):
    days = calendars.calendar(spark, F.lit("2020-12-30"), F.lit("2021-01-05"))
    row = days.where("date = '2021-01-03'").first()
    assert (row["weekday"], row["iso_week"], row["iso_year"], row["year"]) == ("Sunday", 53, 2020, 2021)
    assert days.count() == 7


def test_series_on_calendar(spark, rows_of):
    days = calendars.calendar(spark, F.lit("2020-01-31"), F.lit("2020-02-02")).select("date", "year", "month")
    daily = spark.createDataFrame([(date(2020, 2, 1), 5.0)], "date date, value double")
    monthly = spark.createDataFrame([(2020, 2, 9.0)], "year int, month int, value double")
    joined = calendars.join_series(days, {"OIL": daily}, {"GAS": monthly})
    assert rows_of(joined, "date", "OIL", "GAS") == [
        (date(2020, 1, 31), None, None),
        (date(2020, 2, 1), 5.0, 9.0),
        (date(2020, 2, 2), None, 9.0),
    ]


def test_feature_sink_round_trip(spark, tmp_path, rows_of):
    rows = [("acid", "A", 1.0), ("acid", "B", 2.0), ("base", "C", 3.0)]
    frame = spark.createDataFrame(rows, "group_desc string, rm_code string, AR_1 double")
    path = str(tmp_path / "f")
    sinks.write_features(frame, path)
    order = ["group_desc", "rm_code", "AR_1"]
    assert rows_of(sinks.read_features(spark, path), *order) == rows
    one = sinks.read_features(spark, path, "base")
    assert rows_of(one, *order) == rows[2:]
    assert "PartitionFilters: [isnotnull(group_desc" in one._jdf.queryExecution().toString()
    csv = str(tmp_path / "c")
    sinks.write_features_csv(frame, csv)
    assert spark.read.option("header", True).csv(csv).count() == 3


def test_coefficient_table_leaves_ruled_out_lags_null(spark, tmp_path):
    rows = [("A", 1, 1, "AR_1", 0.123456789), ("A", 1, 1, "AR_2", 0.0), ("A", 2, 1, "AR_2", 0.5)]
    frame = spark.createDataFrame(rows, "rm_code string, horizon int, test int, feature string, coef double")
    table = sinks.coefficient_table(frame, ["AR_1", "AR_2"])
    got = {r["horizon"]: (r["AR_1"], r["AR_2"]) for r in table.collect()}
    assert got == {1: (0.12346, 0.0), 2: (None, 0.5)}
    path = str(tmp_path / "coef")
    sinks.write_coefficients(table, path)
    assert spark.read.option("header", True).csv(path).count() == 2


def test_driver_columns_are_found_by_name(spark, tmp_path, rows_of):
    path = tmp_path / "gas.csv"
    path.write_text("vintage,Date,gas,note\n2021-01-01,2020-01-01,5,x\n2021-01-01,2020-02-01,6,y\n")
    clean = drivers.read_driver_series(spark, str(path), "Gas", YearWindow(2020, 2020))
    assert rows_of(clean, "driver", "date", "value") == [("GAS", date(2020, 1, 1), 5.0), ("GAS", date(2020, 2, 1), 6.0)]
    named = drivers.read_driver_series(
        spark, str(path), "oil", YearWindow(2021, 2021), date_column="vintage", value_column="GAS"
    )
    assert {r["driver"] for r in named.collect()} == {"OIL"}
    with pytest.raises(ValueError, match="no column oil"):
        drivers.read_driver_series(spark, str(path), "oil", YearWindow(2020, 2020))


def test_all_series_are_joined_in_one_pass(spark, rows_of):
    days = spark.sql("SELECT explode(sequence(date'2020-01-30', date'2020-02-02')) AS date")
    days = calendars.with_calendar_columns(days)
    long = spark.createDataFrame(
        [("A", date(2020, 1, 31), 1.0), ("B", date(2020, 2, 1), 2.0)], "driver string, date date, value double"
    )
    wide = calendars.spread_over_months(calendars.join_long(days, long, ["A", "B"]), ["B"])
    assert rows_of(wide, "date", "A", "B") == [
        (date(2020, 1, 30), None, None), (date(2020, 1, 31), 1.0, None),
        (date(2020, 2, 1), None, 2.0), (date(2020, 2, 2), None, 2.0),
    ]
