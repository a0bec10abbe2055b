"""Feature scaling fitted inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.metrics import EPSILON


def safe_variance(mean: Column, variance: Column, n: Column) -> Column:
    """Population variance; 0 within the rounding error of its own computation."""
    noise = n * EPSILON * variance + (n * mean * EPSILON) ** 2
    return F.when(variance <= noise, F.lit(0.0)).otherwise(variance)


def safe_scale(mean: Column, variance: Column, n: Column) -> Column:
    """Population standard deviation; 1 where the column does not vary."""
    varied = safe_variance(mean, variance, n)
    return F.when(varied == 0, F.lit(1.0)).otherwise(F.sqrt(varied))


def standardize(df: DataFrame, keys: list[str], columns: list[str], fit: Column | None = None) -> DataFrame:
    """Replace columns by z-scores; mean and scale come from the rows where ``fit``.

    For panels: a group is one code's months, so its size is set by the calendar.
    """
    group = Window.partitionBy(*keys)

    def fitted(c: str) -> Column:
        return F.col(c) if fit is None else F.when(fit, F.col(c))

    scores = {}
    for c in columns:
        mean = F.avg(fitted(c)).over(group)
        variance = F.var_pop(fitted(c)).over(group)
        n = F.count(fitted(c)).over(group)
        scores[c] = (F.col(c) - mean) / safe_scale(mean, variance, n)
    return df.withColumns(scores)


def robust_scale(df: DataFrame, keys: list[str], columns: list[str], fit: Column | None = None) -> DataFrame:
    """Replace columns by ``(x - median) / IQR`` with exact quartiles; IQR 0 becomes 1.

    Exact quartiles hold a group's distinct values, so this too is for panels,
    whose groups are as long as the calendar.
    """
    quartile_cols = [
        F.percentile(F.col(c) if fit is None else F.when(fit, F.col(c)), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(
            f"_q_{c}"
        )
        for c in columns
    ]
    quartiles = df.groupBy(*keys).agg(*quartile_cols)
    scaled = {}
    for c in columns:
        q = F.col(f"_q_{c}")
        spread = q[2] - q[0]
        scaled[c] = (F.col(c) - q[1]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return df.join(quartiles, keys).withColumns(scaled).drop(*[f"_q_{c}" for c in columns])
