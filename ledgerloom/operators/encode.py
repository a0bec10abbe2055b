"""One-hot columns. Values come from the configuration, never from a data pass."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def one_hot_codes(df: DataFrame, codes: Iterable, column: str = "rm_code") -> DataFrame:
    """One boolean column per requested code, named after the code."""
    return df.withColumns({str(code): F.col(column) == F.lit(code) for code in codes})


def one_hot(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """0/1 columns ``<column>_<value>``."""
    return df.withColumns({name: flag for name, flag in _flags(column, values)})


def one_hot_names(column: str, values: Iterable) -> list[str]:
    return [f"{column}_{value}" for value in values]


def _flags(column: str, values: Iterable) -> list[tuple[str, Column]]:
    values = list(values)
    hits = [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in values]
    return list(zip(one_hot_names(column, values), hits))


def base_category(df: DataFrame, flags: Iterable[str]) -> DataFrame:
    """Rows where every listed one-hot is off."""
    off = [~F.col(f"`{flag}`").cast("boolean") for flag in flags]
    return df.where(reduce(lambda a, b: a & b, off))
