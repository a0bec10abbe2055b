from datetime import date

import pytest

from ledgerloom.config import ForecastWindow, JobRequest, LagWindow, YearWindow, check_horizon, half_years

REQUEST = {
    "external_driver_duration": {"start_year": "2016", "end_year": "2022"},
    "external_driver": ["GAS", "Electricity"],
    "material_price_duration": {"start_year": "2015", "end_year": "2021"},
    "feature_duration": {"start_month": "2", "end_month": "9"},
    "material_price_file": "ledger.csv",
    "electricity_file": "power.csv",
    "target": "Acid",
    "rm_code": ["A/1", "A/2"],
}


def test_request_parses_text_numbers():
    request = JobRequest.from_dict(REQUEST)
    assert request.driver_years == YearWindow(2016, 2022)
    assert request.lags == LagWindow(2, 9)
    assert request.target == "acid"
    assert request.rm_codes == ("A/1", "A/2")


@pytest.mark.parametrize("field", ["external_driver", "target", "rm_code", "feature_duration", "material_price_file"])
def test_absent_field_is_named(field):
    broken = {k: v for k, v in REQUEST.items() if k != field}
    with pytest.raises(ValueError, match=field):
        JobRequest.from_dict(broken)


def test_every_absent_field_is_named_at_once():
    with pytest.raises(ValueError, match="target.*rm_code"):
        JobRequest.from_dict({k: v for k, v in REQUEST.items() if k not in ("target", "rm_code")})


def test_half_given_duration():
    with pytest.raises(ValueError, match="feature_duration.end_month"):
        JobRequest.from_dict(REQUEST | {"feature_duration": {"start_month": "1"}})


def test_electricity_needs_its_file():
    broken = {k: v for k, v in REQUEST.items() if k != "electricity_file"}
    with pytest.raises(ValueError, match="electricity_file"):
        JobRequest.from_dict(broken)
    JobRequest.from_dict(broken | {"external_driver": ["GAS"]})


def test_empty_codes_and_drivers():
    for field in ("external_driver", "rm_code"):
        with pytest.raises(ValueError):
            JobRequest.from_dict(REQUEST | {field: []})


def test_windows_are_checked():
    with pytest.raises(ValueError):
        YearWindow(2020, 2019)
    with pytest.raises(ValueError):
        YearWindow(2020, date.today().year + 1)
    with pytest.raises(ValueError):
        LagWindow(3, 2)
    with pytest.raises(ValueError):
        LagWindow(0, 2)
    with pytest.raises(ValueError):
        ForecastWindow(date(2020, 1, 1), date(2020, 1, 1))
    with pytest.raises(ValueError):
        ForecastWindow.of(("2020-01-01",))
    for bad in (0, -1, 1.5, True, "1"):
        with pytest.raises(ValueError):
            check_horizon(bad)


def test_half_years():
    windows = half_years(date(2019, 1, 1), 3)
    assert [(w.start.isoformat(), w.end.isoformat()) for w in windows] == [
        ("2019-01-01", "2019-07-01"),
        ("2019-07-01", "2020-01-01"),
        ("2020-01-01", "2020-07-01"),
    ]


def test_horizon_keeps_later_lags():
    lags = LagWindow(1, 12)
    assert lags.from_horizon(1) == list(range(1, 13))
    assert lags.from_horizon(3) == list(range(3, 13))
    assert 11 in lags.from_horizon(6) and 1 not in lags.from_horizon(6)


def test_driver_names_come_in_any_case():
    request = JobRequest.from_dict(REQUEST | {"external_driver": ["gas", "ELECTRICITY", "Brent_oil"]})
    assert request.drivers == ("GAS", "Electricity", "BRENT_OIL")
    with pytest.raises(ValueError, match="twice"):
        JobRequest.from_dict(REQUEST | {"external_driver": ["gas", "GAS"]})
    with pytest.raises(ValueError, match="electricity_file"):
        JobRequest.from_dict({k: v for k, v in REQUEST.items() if k != "electricity_file"} | {"external_driver": ["electricity"]})
