"""Stored models: what they forecast, what they certify, what SQL says over the written table."""

import re
from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import FORBIDDEN
from ledgerloom.config import LagWindow, half_years
from ledgerloom.functions import lasso_path as L
from ledgerloom.operators import forecast, lasso
from ledgerloom.operators.features import feature_names
from ledgerloom.plans import queries as q
from ledgerloom.plans.tables import DRIVERS
from ledgerloom.session import cut_lineage

LAGS = LagWindow(1, 4)
NAMES = feature_names(DRIVERS[:2], LAGS)
WINDOWS = half_years(date(1998, 1, 1), 4)


@pytest.fixture(scope="module")
def matrix(spark):
    return cut_lineage(q._supplier_features(spark, "/root/testdata/sf0.01").where("rm_code < 6"))


@pytest.fixture(scope="module")
def fitted(matrix):
    return cut_lineage(lasso.backtest(matrix, DRIVERS[:2], LAGS, [1, 3], WINDOWS))


@pytest.fixture(scope="module")
def stored(spark, fitted, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "table")
    forecast.write_models(forecast.model_table(fitted, NAMES), path, NAMES)
    return path


def test_errors_of_stored_forecasts_are_the_backtests(spark, stored, matrix, fitted):
    models = forecast.read_models(spark, stored, NAMES, "long")
    rows = forecast.window_forecasts(models, matrix, WINDOWS, NAMES)
    errors = {tuple(r)[:4]: tuple(r)[4:] for r in forecast.forecast_errors(rows).collect()}
    solved = fitted.where("status = 'ok'").collect()
    assert len(errors) == len(solved) > 50
    for r in solved:
        n, mape = errors[r["rm_code"], r["feature_set"], r["horizon"], r["test"]]
        assert n == r["n_test"] and mape == pytest.approx(r["mape_pct"], abs=1e-8)


def test_a_table_of_other_columns_is_refused(spark, stored):
    with pytest.raises(Exception, match="models of other columns"):
        forecast.read_models(spark, stored, NAMES[::-1], "long").select("weights").collect()


def test_one_feature_set_reads_its_own_files(spark, stored):
    plan = forecast.read_models(spark, stored, NAMES, "long").where("feature_set = 'AR'")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*feature_set", plan)


def test_scoring_stays_in_the_jvm(spark, stored, matrix):
    rows = forecast.window_forecasts(forecast.read_models(spark, stored, NAMES, "long"), matrix, WINDOWS, NAMES)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.search(plan) and not re.search("Python|Pandas|Arrow", plan)


def test_unknown_prices_are_forecast_by_the_last_models(spark, stored, matrix):
    ahead = matrix.where("month_idx >= 1999 * 12").withColumn("average_price", F.lit(None).cast("double"))
    models = forecast.read_models(spark, stored, NAMES, "long")
    rows = forecast.latest_forecasts(models, ahead, NAMES).collect()
    last = {(r[0], r[1], r[2]): r[3] for r in models.groupBy("rm_code", "feature_set", "horizon").agg(F.max("test")).collect()}
    assert len(rows) == sum(ahead.where(F.col("rm_code") == code).count() for code, _, _ in last)
    assert all(r["test"] == last[r["rm_code"], r["feature_set"], r["horizon"]] and np.isfinite(r["predicted"]) for r in rows)


def test_every_model_is_optimal_and_a_changed_one_is_not(spark, stored, matrix, fitted):
    models = forecast.read_models(spark, stored, NAMES, "long")
    found = forecast.optimality(models, matrix, WINDOWS, NAMES).toPandas()
    assert len(found) == fitted.where("status = 'ok'").count()
    assert found.violation.max() < 1e-9 and found.scale_error.max() < 1e-9
    moved = models.withColumn("weights", F.transform("weights", lambda w: F.when(w != 0, w * 1.01).otherwise(w)))
    used = set(models.where("exists(weights, w -> abs(w) > 0.01)").select(*forecast.MODEL_KEYS).toPandas().itertuples(index=False, name=None))
    worse = forecast.optimality(moved, matrix, WINDOWS, NAMES).toPandas()
    assert used and all(r.violation > 1e-6 for r in worse.itertuples() if (r.rm_code, r.feature_set, r.horizon, r.test) in used)


def test_sql_over_the_written_table_agrees(spark, stored, matrix, tmp_path):
    """Scales, Gram rows and the optimality conditions worked out by the other engine."""
    matrix.write.parquet(str(tmp_path / "matrix"))
    names = ", ".join(f"'{n}'" for n in NAMES)
    windows = ", ".join(f"({k}, TIMESTAMP '{w.start}')" for k, w in enumerate(WINDOWS, 1))
    sql = f"""
    WITH long AS (
        SELECT rm_code, ts, average_price AS y, name, value
        FROM (UNPIVOT (SELECT rm_code, ts, average_price, {", ".join(NAMES)} FROM '{tmp_path}/matrix/*.parquet')
              ON {", ".join(NAMES)} INTO NAME name VALUE value)),
    model AS (
        SELECT rm_code, feature_set, horizon, test, alpha, UNNEST([{names}]) AS name, UNNEST(weights) AS w, list_contains(active, UNNEST([{names}])) AS known
        FROM read_parquet('{stored}/*/*.parquet', hive_partitioning = true)),
    train AS (
        SELECT l.rm_code, test, ts, name,
            (value - avg(value) OVER c) / CASE WHEN stddev_pop(value) OVER c = 0 THEN 1 ELSE stddev_pop(value) OVER c END AS z,
            (y - avg(y) OVER c) / CASE WHEN stddev_pop(y) OVER c = 0 THEN 1 ELSE stddev_pop(y) OVER c END AS v
        FROM long l JOIN (VALUES {windows}) AS t(test, a) ON l.ts < a WINDOW c AS (PARTITION BY l.rm_code, test, name)),
    gram AS (
        SELECT a.rm_code, a.test, a.name AS i, b.name AS j, avg(a.z * b.z) AS g
        FROM train a JOIN train b USING (rm_code, test, ts) GROUP BY ALL),
    corr AS (SELECT rm_code, test, name AS i, avg(z * v) AS c FROM train GROUP BY ALL),
    rest AS (
        SELECT m.rm_code, m.feature_set, m.horizon, m.test, i, any_value(c) - sum(g * w) AS r
        FROM model m JOIN gram ON gram.rm_code = m.rm_code AND gram.test = m.test AND gram.j = m.name JOIN corr USING (i)
        WHERE corr.rm_code = m.rm_code AND corr.test = m.test GROUP BY ALL)
    SELECT count(*), max(CASE WHEN NOT known THEN 0 WHEN w <> 0 THEN abs(r - alpha * sign(w)) ELSE greatest(abs(r) - alpha, 0) END),
        count(*) FILTER (w <> 0), count(*) FILTER (w <> 0 AND NOT known)
    FROM rest JOIN model m ON m.rm_code = rest.rm_code AND m.feature_set = rest.feature_set AND m.horizon = rest.horizon
        AND m.test = rest.test AND m.name = rest.i
    """
    rows, violation, used, wrong = duckdb.sql(sql).fetchall()[0]
    models = forecast.read_models(spark, stored, NAMES, "long")
    assert rows == models.count() * len(NAMES) and used > 50 and wrong == 0
    assert violation < 1e-8


def test_a_feature_that_left_may_come_back_on_the_other_side():
    """Paths on which a feature drops out and soon reaches the opposite bound."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        b, p, n = 40, rng.integers(2, 14), rng.integers(8, 40)
        x = rng.normal(size=(b, n, 3)) @ rng.normal(size=(b, 3, p)) + rng.normal(size=(b, n, p)) * rng.choice([0.05, 0.3, 1])
        y = rng.normal(size=(b, n))
        x, y = ((a - a.mean(1, keepdims=True)) / a.std(1, keepdims=True) for a in (x, y))
        gram, corr, alpha = np.einsum("bni,bnj->bij", x, x) / n, np.einsum("bni,bn->bi", x, y) / n, np.full(b, 0.01)
        assert L.optimality_gap(gram, corr, alpha, L.lasso_weights(gram, corr, alpha)).max() < 1e-9


def test_optimality_without_a_wide_aggregate(spark, stored, matrix):
    """Rows and models meet once per code; no sum per column and model stands in the plan."""
    models = forecast.read_models(spark, stored, NAMES, "long")
    text = forecast.optimality(models, matrix, WINDOWS, NAMES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text.split("FlatMapCoGroups")[0] and "FlatMapCoGroups" in text


def test_optimality_of_odd_tables(spark, stored, matrix):
    """Models stored twice, models of other codes, rows with nulls and codes without models or a name."""
    models = forecast.read_models(spark, stored, NAMES, "long")
    once = forecast.optimality(models, matrix, WINDOWS, NAMES).toPandas().sort_values(forecast.MODEL_KEYS)
    strange = models.limit(1).withColumn("rm_code", F.lit(-1).cast("long")).unionByName(models.limit(1).withColumn("rm_code", F.lit(None).cast("long")))
    nameless = matrix.limit(3).withColumn("rm_code", F.lit(None).cast("long"))
    doubled = forecast.optimality(models.unionByName(models).unionByName(strange), matrix.unionByName(nameless), WINDOWS, NAMES)
    twice = doubled.toPandas().sort_values(forecast.MODEL_KEYS)
    assert (twice.n_train.to_numpy() == 2 * once.n_train.to_numpy()).all()
    assert np.allclose(twice.violation, once.violation, atol=1e-12) and np.allclose(twice.scale_error, once.scale_error, atol=1e-12)
    holes = matrix.withColumn("average_price", F.when(F.col("month_idx") % 5 != 0, F.col("average_price")))
    found = forecast.optimality(models, holes, WINDOWS, NAMES).toPandas().sort_values(forecast.MODEL_KEYS)
    assert found.n_train.tolist() == once.n_train.tolist() and np.allclose(found.scale_error, once.scale_error)
    assert np.isfinite(found.violation).all() and found.violation.max() > once.violation.max()
