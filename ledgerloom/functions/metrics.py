"""Forecast error aggregates, usable in any ``groupBy(...).agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: smallest denominator of a percentage error (float64 epsilon).
EPSILON = 2.220446049250313e-16


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ape(actual, predicted) -> Column:
    """Absolute error relative to the actual value, as a fraction."""
    actual, predicted = _col(actual), _col(predicted)
    return F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(EPSILON))


def mape(actual, predicted) -> Column:
    return F.avg(ape(actual, predicted))


def mse(actual, predicted) -> Column:
    miss = _col(actual) - _col(predicted)
    return F.avg(miss * miss)


def mae(actual, predicted) -> Column:
    return F.avg(F.abs(_col(actual) - _col(predicted)))


def r2(actual, predicted) -> Column:
    """1 - SSE/SST; null where the actual values do not vary."""
    miss = _col(actual) - _col(predicted)
    return 1 - F.try_divide(F.avg(miss * miss), F.var_pop(_col(actual)))


def log_price(price) -> Column:
    return F.log(_col(price))


def unlog_price(value) -> Column:
    return F.exp(_col(value))
