"""Every query beside its SQL, on whole tables."""

import sys
from pathlib import Path

import pytest

from conftest import FORBIDDEN, SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, connect  # noqa: E402

from ledgerloom.plans.oracle import ORACLES  # noqa: E402
from ledgerloom.plans.queries import QUERIES  # noqa: E402

ROWS_ONLY = {"lasso_ar", "lasso_all", "backtest_matrix", "coef_export", "pooled_lasso", "tuned_regressor", "network_regressor"}


@pytest.fixture(scope="module")
def sql():
    return connect(SMALL)


def test_each_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    assert not FORBIDDEN.search(df._jdf.queryExecution().executedPlan().toString())
    assert compare(df, sql.sql(ORACLES[name])) == []


@pytest.mark.parametrize("name", ["lasso_ar", "backtest_matrix"])
def test_model_queries_fill_every_cell(spark, name):
    rows = QUERIES[name](spark, SMALL).toPandas()
    assert len(rows) and not rows.duplicated(["rm_code", "feature_set", "horizon"] + (["test"] if "test" in rows else [])).any()
    if "optimality_gap" in rows:
        assert rows.optimality_gap.dropna().max() < 1e-9
