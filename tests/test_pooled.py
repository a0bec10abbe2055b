import numpy as np
import pandas as pd
import pytest

from ledgerloom.functions import lasso_path as L
from ledgerloom.operators import pooled
from ledgerloom.operators.lasso import alpha_grid
from ledgerloom.operators.regress import fold_of


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 1] + [0, 100, 3, 0]
    x[:, 3] = 7.0
    y = 2 * x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=300)
    frame = pd.DataFrame(x, columns=["a", "b/1", "c", "flat"]).assign(average_price=y, k=range(300))
    return frame, spark.createDataFrame(frame).repartition(7)


COLUMNS = ["a", "b/1", "c", "flat"]


def test_pooled_fit_equals_a_fit_on_all_rows_at_once(data):
    frame, rows = data
    model = pooled.fit_pooled(rows, COLUMNS, ["k"])
    fold = {r["k"]: r["f"] for r in rows.select("k", fold_of(["k"], 5, 1).alias("f")).collect()}
    x, y = frame[COLUMNS].to_numpy(), frame.average_price.to_numpy()
    scale = np.where(x.std(axis=0) < 1e-12, 1, x.std(axis=0))
    zx, zy = (x - x.mean(axis=0)) / scale, (y - y.mean()) / y.std()
    folds = frame.k.map(fold).to_numpy()
    alphas = alpha_grid(0.01)
    scores = np.zeros((5, len(alphas)))
    for f in range(5):
        tr, te = folds != f, folds == f
        xm, ym = zx[tr].mean(axis=0), zy[tr].mean()
        xc, yc = zx[tr] - xm, zy[tr] - ym
        for i, a in enumerate(alphas):
            w = L.lasso_weights((xc.T @ xc / len(yc))[None], (xc.T @ yc / len(yc))[None], np.array([a]))[0]
            miss = zy[te] - ym - (zx[te] - xm) @ w
            scores[f, i] = 1 - (miss**2).sum() / ((zy[te] - zy[te].mean()) ** 2).sum()
    best = scores.mean(axis=0).argmax()
    assert model.alpha == pytest.approx(alphas[best])
    assert model.cv_r2 == pytest.approx(scores.mean(axis=0)[best])
    w = L.lasso_weights((zx.T @ zx / 300)[None], (zx.T @ zy / 300)[None], alphas[best : best + 1])[0]
    assert np.allclose(list(model.scaled_weights.values()), w, atol=1e-9)
    predicted = model.predict(rows).orderBy("k").toPandas().prediction
    assert np.allclose(predicted, y.mean() + y.std() * zx @ w)


def test_result_does_not_depend_on_partitioning(data):
    _, rows = data
    one = pooled.fit_pooled(rows.repartition(1), COLUMNS, ["k"])
    many = pooled.fit_pooled(rows.repartition(13), COLUMNS, ["k"])
    assert one.alpha == many.alpha
    assert list(one.weights.values()) == pytest.approx(list(many.weights.values()))


def test_too_few_rows(data):
    _, rows = data
    with pytest.raises(ValueError, match="too few"):
        pooled.fit_pooled(rows.where("k < 5"), COLUMNS, ["k"])
