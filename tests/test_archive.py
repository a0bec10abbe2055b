from datetime import date

import pytest

from ledgerloom.config import YearWindow
from ledgerloom.sources import archive as A

RAW = "driver string, date date, value double"
ROWS = [(d, date(y, m, 1), float(y + m)) for d in ("GAS", "OIL") for y in (2018, 2019, 2020) for m in (1, 7)]


@pytest.fixture
def landed(spark, tmp_path):
    path = str(tmp_path / "archive")
    A.land_series(spark.createDataFrame(ROWS, RAW), path)
    return path


def test_only_asked_folders_are_read(spark, landed, rows_of):
    found = A.read_archive(spark, landed, ["OIL"], YearWindow(2019, 2020))
    assert rows_of(found, "driver", "date", "value") == sorted((r for r in ROWS if r[0] == "OIL" and r[1].year > 2018), key=str)
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert scans and all("driver" in scan and "year" in scan for scan in scans)


def test_a_year_that_lands_again_replaces_itself(spark, landed, rows_of):
    untouched = {f for f in spark.read.parquet(landed).inputFiles() if "driver=OIL/year=2019" not in f}
    A.land_series(spark.createDataFrame([("OIL", date(2019, 3, 1), 5.0), ("TIN", date(2019, 3, 1), None)], RAW), landed)
    assert untouched <= set(spark.read.parquet(landed).inputFiles())
    found = A.read_archive(spark, landed, ["OIL", "TIN", "none"], YearWindow(2019, 2019))
    assert rows_of(found, "driver", "date", "value") == [("OIL", date(2019, 3, 1), 5.0), ("TIN", date(2019, 3, 1), None)]


def test_rows_without_series_or_date_end_the_job(spark, tmp_path):
    for row in ((None, date(2019, 1, 1), 1.0), ("OIL", None, 1.0)):
        with pytest.raises(Exception, match="without series or date"):
            A.land_series(spark.createDataFrame([row], RAW), str(tmp_path / "bad"))
