from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from ledgerloom.config import LagWindow, half_years
from ledgerloom.functions import lasso_path as L
from ledgerloom.operators import lasso
from ledgerloom.operators.features import ar_matrix, ar_names
from ledgerloom.operators.panel import monthly_panel

LAGS = LagWindow(1, 4)


def standardised(seed, n, p, duplicate=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).cumsum(axis=0)
    if duplicate and p > 2:
        x[:, 1] = x[:, 0]
        x[:, 2] = 1.0
    y = x[:, 0] + rng.normal(size=n)
    x = x - x.mean(axis=0)
    scale = x.std(axis=0)
    x = x / np.where(scale < 1e-12, 1.0, scale)
    return x, (y - y.mean()) / y.std()


@settings(max_examples=60, deadline=None)
@given(
    st.integers(0, 10**6), st.integers(5, 40), st.integers(1, 30), st.floats(0.01, 0.9), st.booleans()
)
def test_path_meets_the_optimality_conditions(seed, n, p, alpha, duplicate):
    x, y = standardised(seed, n, p, duplicate)
    gram, corr = (x.T @ x / n)[None], (x.T @ y / n)[None]
    w = L.lasso_weights(gram, corr, np.array([alpha]))
    assert L.optimality_gap(gram, corr, np.array([alpha]), w)[0] < 1e-9


def test_batch_equals_one_by_one():
    problems = [standardised(s, 30, 8) for s in range(6)]
    grams = np.array([x.T @ x / 30 for x, _ in problems])
    corrs = np.array([x.T @ y / 30 for x, y in problems])
    alphas = np.linspace(0.05, 0.6, 6)
    together = L.lasso_weights(grams, corrs, alphas)
    for k in range(6):
        alone = L.lasso_weights(grams[k : k + 1], corrs[k : k + 1], alphas[k : k + 1])
        assert np.allclose(together[k], alone[0], atol=1e-12)


@pytest.mark.parametrize("alpha", [0.01, 0.1, 0.3])
def test_same_weights_as_spark_ml(spark, alpha):
    x, y = standardised(3, 50, 6)
    w = L.lasso_weights((x.T @ x / 50)[None], (x.T @ y / 50)[None], np.array([alpha]))[0]
    frame = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")).assign(y=y))
    rows = VectorAssembler(inputCols=list("abcdef"), outputCol="x").transform(frame)
    model = LinearRegression(
        featuresCol="x", labelCol="y", regParam=alpha, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000
    ).fit(rows)
    assert np.allclose(w, model.coefficients.toArray(), atol=1e-6)


def test_folds_are_contiguous_blocks():
    assert L.contiguous_folds(12, 5).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("seed", [11, 12, 13])
@pytest.mark.parametrize("alphas", [np.linspace(0.01, 1, 7), np.linspace(0.3, 0.9, 40), np.array([0.05])])
def test_search_equals_direct_fits(seed, alphas):
    """Scores from Gram matrices against predictions made row by row."""
    x, y = standardised(seed, 43, 5)
    n = 37
    best, r2 = L.search_alpha(x[None], y[None], [n], alphas, 5)
    fold = L.contiguous_folds(n, 5)
    scores = np.zeros((5, len(alphas)))
    for f in range(5):
        tr, te = fold != f, fold == f
        xm, ym = x[:n][tr].mean(axis=0), y[:n][tr].mean()
        xc, yc = x[:n][tr] - xm, y[:n][tr] - ym
        for k, a in enumerate(alphas):
            w = L.lasso_weights((xc.T @ xc / len(yc))[None], (xc.T @ yc / len(yc))[None], np.array([a]))[0]
            miss = y[:n][te] - (ym + (x[:n][te] - xm) @ w)
            scores[f, k] = 1 - (miss**2).sum() / ((y[:n][te] - y[:n][te].mean()) ** 2).sum()
    mean = scores.mean(axis=0)
    assert best[0] == mean.argmax()
    assert r2[0] == pytest.approx(mean.max(), abs=1e-9)


def test_score_at_every_alpha_of_the_grid():
    """The smallest alpha is a breakpoint of the walk and must be scored too."""
    for seed in range(8):
        x, y = standardised(seed, 40, 4)
        gram, corr = (x.T @ x / 40)[None], (x.T @ y / 40)[None]
        alphas = lasso.alpha_grid(0.01)
        got = L.fold_scores(gram, corr, x[None], y[None], np.array([y @ y]), alphas)[0]
        for k in (0, 1, 50, 299):
            w = L.lasso_weights(gram, corr, alphas[k : k + 1])[0]
            assert got[k] == pytest.approx(1 - ((y - x @ w) ** 2).sum() / (y @ y), abs=1e-9)


def test_alpha_grid_is_a_fixed_tenth():
    grid = lasso.alpha_grid(0.01)
    assert len(grid) == 300 and grid[0] == 0.01 and grid[1] == pytest.approx(0.01 + 0.99 * 10 / 2999)


@pytest.fixture(scope="module")
def book(spark):
    """Seeded AR(1) prices of code A; code B never changes; C has little history."""
    rng = np.random.default_rng(5)
    rows, price = [], 100.0
    for k in range(96):
        price = 100 + 0.9 * (price - 100) + rng.normal()
        ts = datetime(2012 + k // 12, k % 12 + 1, 10)
        rows += [("A", ts, price), ("B", ts, 5.0)]
        if k >= 76:
            rows.append(("C", ts, price))
    frame = spark.createDataFrame(rows, "rm_code string, ts timestamp_ntz, price double")
    from ledgerloom.config import YearWindow
    from ledgerloom.operators.clean import clean_ledger

    return clean_ledger(frame, YearWindow(2012, 2019))


@pytest.fixture(scope="module")
def models(book):
    features = ar_matrix(monthly_panel(book), LAGS)
    windows = half_years(date(2018, 1, 1), 4)
    return lasso.train_ar(features, LAGS, [1, 3], windows).toPandas()


def test_models_per_cell(models):
    assert len(models) == 3 * 2 * 4
    fitted = models[models.status == "ok"]
    assert set(fitted.rm_code) == {"A", "B", "C"}
    assert (fitted.optimality_gap < 1e-9).all()
    short = models[models.status != "ok"]
    assert set(short.rm_code) == {"C"} and set(short.status) == {"too few training rows"}
    assert short.alpha.isna().all()


def test_ar1_prices_pick_lag_one(models):
    cell = models[(models.rm_code == "A") & (models.horizon == 1) & (models.test == 4)].iloc[0]
    coefs = {c["feature"]: c["coef"] for c in cell.coefs}
    assert coefs["AR_1"] > 0.5
    assert coefs["AR_1"] > 3 * max(abs(v) for k, v in coefs.items() if k != "AR_1")
    assert cell.mape_pct < 5


def test_horizon_leaves_out_early_lags(models):
    cell = models[(models.rm_code == "A") & (models.horizon == 3)].iloc[0]
    assert [c["feature"] for c in cell.coefs] == ["AR_3", "AR_4"]


def test_constant_prices_are_forecast_exactly(models):
    cells = models[models.rm_code == "B"]
    assert (cells.mape_pct == 0).all()
    assert all(c["coef"] == 0 for coefs in cells.coefs for c in coefs)


def test_window_without_rows_is_reported(book):
    features = ar_matrix(monthly_panel(book), LAGS).where("rm_code = 'A'")
    late = lasso.train_ar(features, LAGS, [1], half_years(date(2021, 1, 1), 1)).toPandas()
    assert late.status.tolist() == ["no test rows"]


def test_unknown_feature_set(book):
    features = ar_matrix(monthly_panel(book), LAGS)
    with pytest.raises(ValueError):
        lasso.backtest(features, [], LAGS, [1], half_years(date(2018, 1, 1), 1), ["SOME"])
    with pytest.raises(ValueError, match="beyond"):
        lasso.train_ar(features, LAGS, [5], half_years(date(2018, 1, 1), 1))
    with pytest.raises(ValueError, match="at least"):
        lasso.train_ar(features, LAGS, [1], half_years(date(2018, 1, 1), 1), min_train=3)


def test_single_lag_closed_form_equals_the_path(spark, book):
    features = ar_matrix(monthly_panel(book), LAGS).where("rm_code = 'A'")
    windows = half_years(date(2018, 1, 1), 2)
    got = lasso.lasso_single_lag(features, [1], windows, 0.2).orderBy("test").collect()
    rows = features.orderBy("ts").toPandas()
    for k, w in enumerate(windows):
        train = rows[rows.ts < pd.Timestamp(w.start)]
        test = rows[(rows.ts >= pd.Timestamp(w.start)) & (rows.ts < pd.Timestamp(w.end))]
        zx = (train.AR_1 - train.AR_1.mean()) / train.AR_1.std(ddof=0)
        zy = (train.average_price - train.average_price.mean()) / train.average_price.std(ddof=0)
        beta = L.lasso_weights(np.ones((1, 1, 1)), np.array([[(zx * zy).mean()]]), np.array([0.2]))[0, 0]
        z = (test.AR_1 - train.AR_1.mean()) / train.AR_1.std(ddof=0)
        predicted = train.average_price.mean() + train.average_price.std(ddof=0) * beta * z
        mape = 100 * (abs(test.average_price - predicted) / test.average_price).mean()
        assert got[k]["beta"] == pytest.approx(beta)
        assert got[k]["mape_pct"] == pytest.approx(mape)
        assert (got[k]["n_train"], got[k]["n_test"]) == (len(train), len(test))


def test_feature_names_cover_the_plan():
    assert ar_names([1, 2]) == ["AR_1", "AR_2"]


def test_an_unsolved_path_is_reported_and_holds_nothing_up(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 40, 4))
    x[1] = 0.0
    x[1, :, 0] = rng.normal(size=40)
    y = np.stack([x[0] @ [1, -2, 3, -4], 2 * x[1, :, 0]])
    gram, corr = np.einsum("bni,bnj->bij", x, x) / 40, np.einsum("bni,bn->bi", x, y) / 40
    monkeypatch.setattr(L, "steps_allowed", lambda size: 2)
    w = L.lasso_weights(gram, corr, np.array([0.01, 0.01]))
    assert np.isnan(w[0]).all() and np.isfinite(w[1]).all()
    best, r2 = L.search_alpha(x, y, [40, 40], np.linspace(0.01, 1, 30), 5)
    assert np.isnan(r2[0]) and np.isfinite(r2[1])


def folds_of(seed, n, p, duplicate):
    x, y = standardised(seed, n + n // 4, p, duplicate)
    gram, corr = x[:n].T @ x[:n] / n, x[:n].T @ y[:n] / n
    return gram, corr, x[n:], y[n:]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(6, 40), st.integers(1, 40), st.booleans())
def test_walks_by_pivots_equal_a_system_per_piece(seed, n, p, duplicate):
    """More features than rows, copies of a feature and constant ones among them; two choices of columns."""
    parts = [folds_of(seed + k, n, p, duplicate) for k in range(3)]
    gram, corr, xh, yh = (np.array(v) for v in zip(*parts, strict=True))
    alphas, known = np.linspace(0.01, 1, 50), np.array([np.ones(p, bool), np.arange(p) >= p // 2])
    got = L.fold_scores(gram, corr, xh, yh, (yh**2).sum(axis=1), alphas, known)
    for b in range(6):
        one, mask = b // 2, known[b % 2]
        w = [
            L.lasso_weights((gram[one] * np.outer(mask, mask))[None], (corr[one] * mask)[None], np.array([a]))[0] for a in alphas
        ]
        miss = ((yh[one][:, None] - xh[one] @ np.array(w).T) ** 2).sum(axis=0)
        assert np.allclose(got[b], 1 - miss / (yh[one] ** 2).sum(), atol=1e-7, rtol=1e-7)


def test_search_solves_no_system_per_step(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3, 60, 30)), rng.normal(size=(3, 60))
    expected = L.search_alpha(x, y, [20, 40, 60], np.linspace(0.01, 1, 30), 5)
    monkeypatch.setattr(np.linalg, "solve", None)
    best, r2 = L.search_alpha(x, y, [20, 40, 60], np.linspace(0.01, 1, 30), 5)
    assert best.tolist() == expected[0].tolist() and np.isfinite(r2).all()


def test_a_walk_that_drifted_is_solved_anew(monkeypatch):
    gram, corr, xh, yh = (v[None] for v in folds_of(9, 30, 20, False))
    alphas, sst = np.linspace(0.01, 1, 40), (yh**2).sum(axis=1)
    expected = L.fold_scores(gram, corr, xh, yh, sst, alphas)
    walk = L.pivot_walk

    def off(*problems):
        w, miss, pieces = walk(*problems)
        return w + 1e-6, miss, (*pieces[:3], pieces[3] + 1, *pieces[4:])

    monkeypatch.setattr(L, "pivot_walk", off)
    assert np.allclose(L.fold_scores(gram, corr, xh, yh, sst, alphas), expected, atol=1e-9)


def test_small_batches_of_walks_give_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(4, 50, 12)), rng.normal(size=(4, 50))
    known = np.array([np.ones(12, bool), np.arange(12) > 3])
    at_once = L.search_alpha(x, y, [15, 30, 42, 50], np.linspace(0.01, 1, 30), 5, known)
    monkeypatch.setattr(L, "WALK_NUMBERS", 1)
    one_by_one = L.search_alpha(x, y, [15, 30, 42, 50], np.linspace(0.01, 1, 30), 5, known)
    assert at_once[0].tolist() == one_by_one[0].tolist() and np.allclose(at_once[1], one_by_one[1], atol=1e-12)


def test_features_reach_python_as_one_array(book):
    features = ar_matrix(monthly_panel(book), LAGS)
    models = lasso.train_ar(features, LAGS, [1, 3], half_years(date(2018, 1, 1), 4))
    text = models._jdf.queryExecution().executedPlan().toString()
    given_to_python = next(line for line in text.splitlines() if "FlatMapGroupsInPandas" in line)
    assert "AR_2" not in given_to_python
    assert models.schema["coefs"].dataType.simpleString() == lasso.MODEL_FIELDS["coefs"].replace(": ", ":").replace(", ", ",")
