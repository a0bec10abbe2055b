"""LASSO back-test over many codes, horizons and test windows as one job.

Rows move once: a code's feature rows (at most one per month) meet in one task,
which then works through that code's models. Windows and horizons are not
joined to the rows, so nothing is replicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import ForecastWindow, LagWindow
from ledgerloom.functions.lasso_path import lasso_weights, optimality_gap, search_alpha
from ledgerloom.functions.metrics import EPSILON, mape
from ledgerloom.operators.features import ar_names, feature_names
from ledgerloom.operators.scaling import safe_scale
from ledgerloom.operators.segments import training_moments
from ledgerloom.operators.split import in_test_windows

# The alpha grid, how many of its points are tried, and the folds.
ALPHA_TOP = 1.0
ALPHA_POINTS = 3000
ALPHA_DRAWS = 300
FOLDS = 5

FEATURE_SETS = ("AR", "ALL")

MODEL_FIELDS = {
    "feature_set": "string",
    "horizon": "int",
    "test": "int",
    "n_train": "int",
    "n_test": "int",
    "status": "string",
    "alpha": "double",
    "cv_r2": "double",
    "mape_pct": "double",
    "optimality_gap": "double",
    "y_mean": "double",
    "y_scale": "double",
    "coefs": "array<struct<feature: string, coef: double, mean: double, scale: double>>",
}

# What a task gives back: the three arrays become ``coefs`` outside of Python.
ARRAYS = ("coef", "mean", "scale")
RETURNED = {k: v for k, v in MODEL_FIELDS.items() if k != "coefs"} | dict.fromkeys(ARRAYS, "array<double>")


@dataclass(frozen=True)
class FeaturePlan:
    """Columns of one feature set, and which of them each horizon knows."""

    name: str
    columns: list[str]
    known: dict[int, np.ndarray]


def alpha_grid(alpha_bottom: float) -> np.ndarray:
    """Evenly spaced draws of the full grid: a fixed choice instead of a random one."""
    grid = np.linspace(alpha_bottom, ALPHA_TOP, ALPHA_POINTS)
    return grid[:: ALPHA_POINTS // ALPHA_DRAWS]


def _scaled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, var = values.mean(axis=0), values.var(axis=0)
    flat = var <= len(values) * EPSILON * var + (len(values) * mean * EPSILON) ** 2
    return mean, np.where(flat, 1.0, np.sqrt(var))


def _fit_cells(ts: np.ndarray, x: np.ndarray, y: np.ndarray, plan: FeaturePlan, windows, alphas, min_train: int) -> Iterator[dict]:
    """One model per horizon and test window for one code and one feature set.

    All of them are solved together: a column a horizon rules out is zero in
    that model and can never be picked.
    """
    known = np.array(list(plan.known.values()))
    jobs, xs, ys = [], [], []
    for number, (start, end) in enumerate(windows, start=1):
        n = int((ts < start).sum())
        test = (ts >= start) & (ts < end)
        status = None
        if n < min_train:
            status = "too few training rows"
        elif not test.any():
            status = "no test rows"
        else:
            x_mean, x_scale = _scaled(x[:n])
            y_mean, y_scale = _scaled(y[:n])
            zx, zy = (x - x_mean) / x_scale, (y - y_mean) / y_scale
        for horizon in plan.known:
            cell = {"horizon": horizon, "test": number, "n_train": n, "n_test": int(test.sum())}
            if status:
                yield cell | {"status": status} | dict.fromkeys(ARRAYS)
                continue
            jobs.append((cell, test, len(xs), plan.known[horizon], x_mean, x_scale, y_mean, y_scale))
        if not status:
            xs.append(zx)
            ys.append(zy)
    if not jobs:
        return
    zx, zy = np.array(xs), np.array(ys)
    sizes = [cell["n_train"] for cell, *_ in jobs[:: len(known)]]
    best, r2 = search_alpha(zx, zy, sizes, alphas, FOLDS, known)
    both = known[:, :, None] & known[:, None, :]
    gram = np.concatenate([np.where(both, zx[b, :n].T @ zx[b, :n] / n, 0.0) for b, n in enumerate(sizes)])
    corr = np.concatenate([np.where(known, zx[b, :n].T @ zy[b, :n] / n, 0.0) for b, n in enumerate(sizes)])
    weights = lasso_weights(gram, corr, alphas[best])
    gaps = optimality_gap(gram, corr, alphas[best], weights)
    solved = np.isfinite(r2) & np.isfinite(weights).all(axis=1)
    for b, (cell, test, own, known, x_mean, x_scale, y_mean, y_scale) in enumerate(jobs):
        if not solved[b]:
            yield cell | {"status": "path not solved"} | dict.fromkeys(ARRAYS)
            continue
        predicted = zx[own][test] @ weights[b] * y_scale + y_mean
        miss = np.abs(y[test] - predicted) / np.maximum(np.abs(y[test]), EPSILON)
        yield cell | {
            "status": "ok",
            "alpha": float(alphas[best[b]]),
            "cv_r2": float(r2[b]),
            "mape_pct": float(100 * miss.mean()),
            "optimality_gap": float(gaps[b]),
            "y_mean": float(y_mean),
            "y_scale": float(y_scale),
            "coef": weights[b][known],
            "mean": x_mean[known],
            "scale": x_scale[known],
        }


def _fit_code(
    plans: list[FeaturePlan], columns: list[str], windows, alphas, min_train: int
) -> Callable[[pd.DataFrame], pd.DataFrame]:
    places = [[columns.index(c) for c in plan.columns] for plan in plans]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        ts, y = rows["ts"].to_numpy().astype("datetime64[us]"), rows["average_price"].to_numpy(float)
        x = np.array(rows["x"].tolist(), float)
        out = [
            {"feature_set": plan.name} | cell
            for plan, at in zip(plans, places, strict=True)
            for cell in _fit_cells(ts, x[:, at], y, plan, windows, alphas, min_train)
        ]
        models = pd.DataFrame(out, columns=[*RETURNED])
        models.insert(0, "rm_code", rows["rm_code"].iloc[0])
        return models

    return fit


def _coefs(plans: list[FeaturePlan]) -> Column:
    """Scales and weights of a model under the names of the columns that its horizon knows."""
    names = F.lit(None).cast("array<string>")
    for plan in plans:
        for horizon, known in plan.known.items():
            own = (F.col("feature_set") == plan.name) & (F.col("horizon") == horizon)
            listed = F.array(*[F.lit(plan.columns[j]) for j in np.flatnonzero(known)])
            names = F.when(own, listed).otherwise(names)
    return F.arrays_zip(names.alias("feature"), *ARRAYS).cast(MODEL_FIELDS["coefs"])


def backtest(
    features: DataFrame,
    drivers: Iterable[str],
    lags: LagWindow,
    horizons: Iterable[int],
    windows: list[ForecastWindow],
    feature_sets: Iterable[str] = FEATURE_SETS,
    alpha_bottom: float = 0.01,
    min_train: int = 2 * FOLDS,
    partitions: int | None = None,
    by_code: bool = False,
) -> DataFrame:
    """Fit and score one model per code, feature set, horizon and window.

    The training set of a window is everything before it. A cell with fewer
    than ``min_train`` training rows (the folds need two rows each), without
    test rows or with an unsolved path is reported in ``status`` instead of
    failing the job.

    ``partitions`` splits the codes over tasks. It is set by count, since the
    rows are few bytes but much work and would be coalesced by size. ``by_code`` says
    that ``features`` is stored by code (``sinks.write_by_code``) and is worked on as it
    lies, a task per bucket and without a shuffle.
    """
    spark = features.sparkSession
    names = list(drivers)
    horizons = list(horizons)
    if not horizons or max(horizons) > lags.last:
        raise ValueError(f"horizons {horizons} need lags beyond {lags.last}")
    if min_train < 2 * FOLDS:
        raise ValueError(f"{FOLDS} folds need at least {2 * FOLDS} training rows")
    plans = []
    for feature_set in feature_sets:
        if feature_set not in FEATURE_SETS:
            raise ValueError(f"unknown feature set {feature_set!r}")
        used = names if feature_set == "ALL" else []
        widest = feature_names(used, lags, min(horizons))
        known = {h: np.isin(widest, feature_names(used, lags, h)) for h in horizons}
        plans.append(FeaturePlan(feature_set, widest, known))
    bounds = [
        (np.datetime64(w.start, "us"), np.datetime64(w.end, "us"))
        for w in map(ForecastWindow.of, windows)
    ]
    columns = sorted({c for plan in plans for c in plan.columns})
    partitions = partitions or max(
        4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    code_type = features.schema["rm_code"].dataType.simpleString()
    # One array of numbers reaches Python much faster than as many columns, on the way back too.
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    rows = features.select("rm_code", "ts", "average_price", x)
    fitted = (
        (rows if by_code else rows.repartition(partitions, "rm_code"))
        .groupBy("rm_code")
        .applyInPandas(
            _fit_code(plans, columns, bounds, alpha_grid(alpha_bottom), min_train),
            ", ".join([f"rm_code {code_type}", *(f"{k} {v}" for k, v in RETURNED.items())]),
        )
    )
    return fitted.select("rm_code", *[c for c in MODEL_FIELDS if c != "coefs"], _coefs(plans).alias("coefs"))


def train_ar(features: DataFrame, lags: LagWindow, horizons, windows, **options) -> DataFrame:
    """Models on autoregressive features only."""
    return backtest(features, [], lags, horizons, windows, ["AR"], **options)


def train_all_features(features: DataFrame, drivers, lags: LagWindow, horizons, windows, **options) -> DataFrame:
    """Models on autoregressive features and external drivers."""
    return backtest(features, drivers, lags, horizons, windows, ["ALL"], **options)


def coefficients(models: DataFrame, places: int = 5) -> DataFrame:
    """One row per model and feature."""
    return models.where("status = 'ok'").select(
        "rm_code", "feature_set", "horizon", "test", F.inline("coefs")
    ).withColumn("coef", F.round("coef", places)).drop("mean", "scale")


def lasso_single_lag(
    features: DataFrame, horizons: list[int], windows: list[ForecastWindow], alpha: float
) -> DataFrame:
    """LASSO on the single feature ``AR_h`` with a fixed ``alpha``, without Python.

    On standardised data one feature has the closed solution
    ``sign(rho) * max(|rho| - alpha, 0)`` with the training correlation ``rho``.
    All training sets of a code come from the moments of its calendar segments; no row is
    copied or looked at once per window.
    """
    names = dict(zip(horizons, ar_names(horizons), strict=True))
    moments = training_moments(features, {f"h{h}": (name, "average_price") for h, name in names.items()}, windows)

    def scale(column: str):
        return safe_scale(F.col(f"mean_{column}"), F.col(f"var_{column}"), F.col("n"))

    cells = [
        F.struct(
            F.lit(h).alias("horizon"),
            F.col(f"mean_{name}").alias("mean_x"),
            scale(name).alias("scale_x"),
            F.col(f"covar_h{h}").alias("covariance"),
        )
        for h, name in names.items()
    ]
    trained = moments.where("n > 1").select(
        "rm_code", "test", F.col("n").alias("n_train"), F.col("mean_average_price").alias("mean_y"),
        scale("average_price").alias("scale_y"), F.inline(F.array(*cells)),
    )
    lagged = F.array(
        *[F.struct(F.lit(h).alias("horizon"), F.col(name).alias("x")) for h, name in zip(horizons, ar_names(horizons))]
    )
    tested = in_test_windows(features, windows).select(
        "rm_code", "test", F.col("average_price").alias("y"), F.inline(lagged)
    )
    fitted = tested.join(trained, ["rm_code", "horizon", "test"])
    rho = F.col("covariance") / (F.col("scale_x") * F.col("scale_y"))
    beta = F.signum(rho) * F.greatest(F.abs(rho) - alpha, F.lit(0.0))
    z = (F.col("x") - F.col("mean_x")) / F.col("scale_x")
    predicted = fitted.withColumn("beta", beta).withColumn(
        "predicted", F.col("mean_y") + F.col("scale_y") * F.col("beta") * z
    )
    return predicted.groupBy("rm_code", "horizon", "test").agg(
        F.first("n_train").alias("n_train"),
        F.count(F.lit(1)).alias("n_test"),
        F.first("beta").alias("beta"),
        (100 * mape("y", "predicted")).alias("mape_pct"),
    )
