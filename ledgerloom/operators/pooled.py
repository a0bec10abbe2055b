"""One LASSO over the rows of all codes.

Rows never leave their partitions: each partition reduces its rows to sums of
products per fold, and only those sums, whose number is set by the feature
columns, reach the driver. Folds and the final fit follow from the sums alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.lasso_path import best_alpha, fold_scores, lasso_weights
from ledgerloom.functions.metrics import EPSILON
from ledgerloom.operators.lasso import FOLDS, alpha_grid
from ledgerloom.operators.regress import fold_of


@dataclass(frozen=True)
class PooledLasso:
    """Weights on the original scale of the columns."""

    intercept: float
    weights: dict[str, float]
    scaled_weights: dict[str, float]
    alpha: float
    cv_r2: float

    def expression(self) -> Column:
        terms = [F.lit(w) * F.col(f"`{c}`").cast("double") for c, w in self.weights.items() if w]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def predict(self, features: DataFrame) -> DataFrame:
        return features.withColumn("prediction", self.expression())


def product_sums(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """Sums of ``z_i * z_j`` per fold over ``z = (1, columns...)``, upper half."""
    size = len(columns) + 1
    upper = np.triu_indices(size)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch[columns].to_numpy(float)])
            folds = batch[fold].to_numpy()
            for f in np.unique(folds):
                part = z[folds == f]
                sums[f] = sums.get(f, 0.0) + part.T @ part
        for f, total in sums.items():
            yield pd.DataFrame({"fold": f, "i": upper[0], "j": upper[1], "value": total[upper]})

    partial = df.select(fold, *columns).mapInPandas(
        reduce_rows, "fold int, i int, j int, value double"
    )
    return partial.groupBy("fold", "i", "j").agg(F.sum("value").alias("value"))


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the columns from sums of products."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    return mean, sums[1:, 1:] / n - np.outer(mean, mean)


def _held_out(sums: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Stand-ins for the held-out rows, centred by the training mean.

    Any rows with the same sums of products have the same squared errors; as
    many as there are columns will do.
    """
    n, total = sums[0, 0], sums[0, 1:]
    centred = sums[1:, 1:] - np.outer(mean, total) - np.outer(total, mean) + n * np.outer(mean, mean)
    size, axes = np.linalg.eigh(centred)
    rows = np.sqrt(np.maximum(size, 0))[:, None] * axes.T
    return rows[:, :-1], rows[:, -1], sums[-1, -1] - total[-1] ** 2 / n


def fit_pooled(
    train: DataFrame,
    columns: Iterable[str],
    keys: list[str],
    label: str = "average_price",
    alpha_bottom: float = 0.01,
    folds: int = FOLDS,
    seed: int = 1,
) -> PooledLasso:
    """Standardise on the training rows, choose ``alpha`` by folds, fit on all of them.

    Folds are a digest of the row key. ``keys`` must name each row once. The driver
    holds one matrix of products per fold, so the number of columns must be bounded: a
    few thousand, whatever the number of rows.
    """
    names = [*columns, label]
    numbers = [F.col(f"`{c}`").cast("double") for c in names]
    stats = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{k}") for k, c in enumerate(numbers)],
        *[F.var_pop(c).alias(f"v{k}") for k, c in enumerate(numbers)],
    ).first()
    if stats["n"] < 2 * folds:
        raise ValueError(f"{stats['n']} training rows are too few for {folds} folds")
    mean = np.array([stats[f"m{k}"] for k in range(len(names))])
    var = np.array([stats[f"v{k}"] for k in range(len(names))])
    flat = var <= stats["n"] * EPSILON * var + (stats["n"] * mean * EPSILON) ** 2
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    zs = [
        ((c - F.lit(float(m))) / F.lit(float(s))).alias(f"z{k}")
        for k, (c, m, s) in enumerate(zip(numbers, mean, scale))
    ]
    scaled = train.select(fold_of(keys, folds, seed).alias("fold"), *zs)

    size = len(names) + 1
    sums = np.zeros((folds, size, size))
    found = product_sums(scaled, [f"z{k}" for k in range(len(names))]).toArrow()
    fold, i, j, value = (found[c].to_numpy() for c in ("fold", "i", "j", "value"))
    sums[fold, i, j] = sums[fold, j, i] = value
    total = sums.sum(axis=0)

    alphas = alpha_grid(alpha_bottom)
    used = [f for f in range(folds) if sums[f, 0, 0] > 0]
    trained = [_moments(total - sums[f]) for f in used]
    held = [_held_out(sums[f], m) for f, (m, _) in zip(used, trained)]
    gram = np.array([cov[:-1, :-1] for _, cov in trained])
    corr = np.array([cov[:-1, -1] for _, cov in trained])
    xh, yh, spread = (np.array(part) for part in zip(*held))
    scores = fold_scores(gram, corr, xh, yh, spread, alphas)
    best, r2 = best_alpha(scores[None])
    alpha = alphas[best]
    _, cov = _moments(total)
    w = lasso_weights(cov[None, :-1, :-1], cov[None, :-1, -1], alpha)[0]
    if not np.isfinite(w).all():
        raise ArithmeticError("the path of the pooled model was not solved")
    raw = w * scale[-1] / scale[:-1]
    return PooledLasso(
        intercept=float(mean[-1] - raw @ mean[:-1]),
        weights=dict(zip(names[:-1], map(float, raw))),
        scaled_weights=dict(zip(names[:-1], map(float, w))),
        alpha=float(alpha[0]),
        cv_r2=float(r2[0]),
    )
