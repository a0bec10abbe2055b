"""The registered queries: SQL on whole tables where there is some, no SQL only with a reason."""

import re
import sys
from pathlib import Path

import pytest

from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check import compare, connect  # noqa: E402

import __spark_entry__  # noqa: E402
from ledgerloom.llm.oracle import ORACLES  # noqa: E402
from ledgerloom.llm.queries import QUERIES  # noqa: E402

# Beyond SQL: fuzzy or trained, or hashes that the other engine lacks. Their own tests use plain Python.
BY_HAND = {3, 5, 6, 7, 8, 9, 10, 12}


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in set(QUERIES) - set(ORACLES)} == BY_HAND
    listed = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(listed)
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(listed)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert compare(df, connect(SMALL).sql(ORACLES[name])) == []
    assert df.count()


def test_native_operators_run_no_python(spark):
    for name in ("op4_licence_scan", "op10_document_fingerprints"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
