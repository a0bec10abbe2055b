import re
import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.config import YearWindow  # noqa: E402
from ledgerloom.operators.clean import clean_ledger  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"

# Operators no query may need: all-pairs joins and row-at-a-time Python.
FORBIDDEN = re.compile("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython")


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def ledger(spark):
    """Build a clean ledger from ``(code, "2020-01-05", price)`` triples."""

    def build(rows, group="acid", years=YearWindow(2010, 2024)):
        data = [
            (r[0], r[3] if len(r) > 3 else group, datetime.fromisoformat(r[1]), float(r[2]), 1.0)
            for r in rows
        ]
        raw = spark.createDataFrame(
            data, "rm_code string, group_desc string, ts timestamp_ntz, price double, weight double"
        )
        return clean_ledger(raw, years, ["weight"])

    return build


@pytest.fixture
def rows_of():
    """Rows as sorted tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=str)

    return collect


def month(year, number):
    return year * 12 + number - 1
