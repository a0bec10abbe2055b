"""A job request over landed files, end to end."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import month
from ledgerloom.config import JobRequest, half_years
from ledgerloom.plans import jobs
from ledgerloom.sources.archive import land_series
from ledgerloom.operators.quality import check_feature_columns


@pytest.fixture
def request_files(tmp_path):
    months = [(y, m) for y in (2018, 2019, 2020) for m in range(1, 13)]
    ledger = ["idx,POSTING DATE,Group Description,Key RM code,PRICE (EUR/kg),WEIGHT (kg)"]
    for k, (y, m) in enumerate(months):
        ledger.append(f"{k},{y}-{m:02d}-10,Acid,C-70,{10 + k % 5},5")
        if m != 6:
            ledger.append(f"{k},{y}-{m:02d}-20,Acid,C-71,{20 + k % 3},5")
        ledger.append(f"{k},{y}-{m:02d}-21,Base,D-9,{30 + k % 7},5")
    (tmp_path / "ledger.csv").write_text("\n".join(ledger))
    (tmp_path / "gas.csv").write_text(
        "date,GAS\n" + "\n".join(f"{y}-{m:02d}-01,{100 + k}" for k, (y, m) in enumerate(months))
    )
    (tmp_path / "power.csv").write_text(
        ",Year,Month,Electricity\n" + "\n".join(f"{k},{y},{m},{50 + k}" for k, (y, m) in enumerate(months))
    )
    request = {
        "external_driver_duration": {"start_year": "2018", "end_year": "2020"},
        "external_driver": ["gas", "electricity"],
        "material_price_duration": {"start_year": "2018", "end_year": "2020"},
        "feature_duration": {"start_month": "1", "end_month": "3"},
        "material_price_file": str(tmp_path / "ledger.csv"),
        "electricity_file": str(tmp_path / "power.csv"),
        "target": "acid",
        "rm_code": ["C-70", "C-71"],
    }
    return JobRequest.from_dict(request), {"Gas": str(tmp_path / "gas.csv")}


def test_request_to_features(spark, request_files, rows_of):
    request, paths = request_files
    ledger, drivers = jobs.read_request(spark, request, paths)
    features = jobs.feature_plan(ledger, drivers, request, check=True)
    check_feature_columns(features, list(request.drivers), request.lags)
    # id columns, target, two drivers and AR at three lags, one flag per code
    assert len(features.columns) == 5 + (2 + 1) * 3 + 2
    assert features.where("`C-70`").count() == 33
    assert features.where("`C-71`").count() == 33 - 3  # no purchase in any June
    july = features.where("`C-71` and month_idx = %d" % month(2019, 7))
    assert rows_of(july, "GAS_1", "Electricity_2", "AR_1", "AR_2") == [
        (117.0, 66.0, 20 + 16 % 3, 20 + 16 % 3)
    ]


def test_series_without_a_path_come_from_the_archive(spark, request_files, tmp_path, rows_of):
    request, paths = request_files
    _, expected = jobs.read_request(spark, request, paths)
    land_series(expected.where("driver = 'GAS'"), str(tmp_path / "archive"))
    _, drivers = jobs.read_request(spark, request, {}, str(tmp_path / "archive"))
    assert rows_of(drivers) == rows_of(expected)


def test_wrong_target_is_refused(spark, request_files):
    request, paths = request_files
    ledger, drivers = jobs.read_request(spark, request, paths)
    mixed = JobRequest(**{**request.__dict__, "rm_codes": ("C-70", "D-9")})
    with pytest.raises(ValueError, match="code_outside_target: 1"):
        jobs.feature_plan(ledger, drivers, mixed, check=True)


def test_forecast_plan_compares_three_methods(spark, request_files):
    request, paths = request_files
    ledger, drivers = jobs.read_request(spark, request, paths)
    features = jobs.feature_plan(ledger, drivers, request)
    windows = half_years(date(2020, 1, 1), 2)
    scores = jobs.forecast_plan(features, list(request.drivers), request.lags, [1, 3], windows).toPandas()
    assert set(scores.feature_set) == {"NAIVE", "AR", "ALL"}
    assert len(scores) == 2 * 3 * 2 and (scores.n_windows == 2).all()


def test_a_driver_without_rows_is_refused(spark, request_files):
    request, paths = request_files
    ledger, drivers = jobs.read_request(spark, request, paths)
    with pytest.raises(ValueError, match="driver_not_found: 1"):
        jobs.feature_plan(ledger, drivers.where("driver != 'GAS'"), request, check=True)


def test_rows_without_a_date_are_seen_before_the_year_filter(spark, request_files):
    request, paths = request_files
    ledger, drivers = jobs.read_request(spark, request, paths)
    undated = ledger.unionByName(ledger.limit(2).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    with pytest.raises(ValueError, match="null_ts: 2"):
        jobs.feature_plan(undated, drivers, request, check=True)
