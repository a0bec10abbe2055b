"""Expectations: each check is a row ``(check, violations)``.

A report is lazy like any other frame; ``require`` is the one call that runs it
and raises.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ledgerloom.config import LagWindow
from ledgerloom.operators.features import driver_names, feature_names
from ledgerloom.operators.month_bits import is_bought


def unfold_checks(counts: DataFrame) -> DataFrame:
    """One row of named counts to one row per name."""
    pairs = [
        F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").cast("long").alias("violations"))
        for name in counts.columns
    ]
    return counts.select(F.inline(F.array(*pairs)))


def expectations(df: DataFrame, broken: Mapping[str, Column]) -> DataFrame:
    """Count the rows breaking each condition, all in one aggregation."""
    empty = (F.count(F.lit(1)) == 0).cast("long").alias("is_empty")
    return unfold_checks(df.agg(empty, *[F.count_if(c).alias(name) for name, c in broken.items()]))


def null_checks(columns: Iterable[str]) -> dict[str, Column]:
    return {f"null_{c}": F.col(f"`{c}`").isNull() for c in columns}


def ledger_report(ledger: DataFrame, codes: Iterable | None = None, target: str | None = None) -> DataFrame:
    """Checks on a clean ledger: nulls, prices, and codes against groups.

    Rows are combined per (code, group) first, so the checks on codes cost no
    further pass over the ledger.
    """
    return report_counts(ledger_counts(ledger), codes, target)


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """What the checks count, per code (and group, if the ledger has one)."""
    keys = [c for c in ("rm_code", "group_desc") if c in ledger.columns]
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ts").isNull()).alias("ts"),
        F.count_if(F.col("price").isNull()).alias("price"),
        F.count_if(F.col("price") <= 0).alias("low"),
    )


def report_counts(per_pair: DataFrame, codes: Iterable | None = None, target: str | None = None) -> DataFrame:
    """The ledger report from counts per code and group (``ledger_counts``)."""
    per_code = per_pair.groupBy("rm_code").agg(
        *[F.sum(c).alias(c) for c in ("n", "ts", "price", "low")],
        F.sum(F.when(F.col("group_desc").isNull(), F.col("n")).otherwise(0)).alias("no_group"),
        F.count("group_desc").alias("groups"),
        F.max("group_desc").alias("group_desc"),
    )

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    checks = {
        "is_empty": (F.count(F.lit(1)) == 0).cast("long"),
        "null_ts": total(F.col("ts")),
        "null_price": total(F.col("price")),
        "null_group_desc": total(F.col("no_group")),
        "null_rm_code": total(F.when(F.col("rm_code").isNull(), F.col("n")).otherwise(0)),
        "price_not_positive": total(F.col("low")),
        "code_in_several_groups": F.count_if(F.col("groups") > 1),
    }
    if codes is not None:
        wanted = list(codes)
        asked = F.col("rm_code").isin(wanted)
        checks["code_not_found"] = F.lit(len(wanted)) - F.count_if(asked)
        if target is not None:
            checks["code_outside_target"] = F.count_if(
                asked & ~F.col("group_desc").eqNullSafe(F.lit(target))
            )
    return unfold_checks(per_code.agg(*[c.alias(name) for name, c in checks.items()]))


def driver_report(series: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """A null left after filling forward stands before the first value.

    With ``names``, also how many of these drivers have no row at all.
    """
    counts = [
        (F.count(F.lit(1)) == 0).cast("long").alias("is_empty"),
        F.count_if(F.col("value").isNull()).alias("null_driver_value"),
    ]
    if names is not None:
        absent = [1 - F.max(F.when(F.col("driver") == n, 1).otherwise(0)) for n in names]
        total = reduce(Column.__add__, [F.coalesce(a, F.lit(1)) for a in absent])
        counts.append(total.cast("long").alias("driver_not_found"))
    return unfold_checks(series.agg(*counts))


def feature_checks(names: list[str], lags: LagWindow, bits: str = "_bits") -> dict[str, Column]:
    """No nulls, and no row in a month that the code's ``bits`` lack."""
    return null_checks(["average_price", *feature_names(names, lags)]) | {"imputed_target": ~is_bought(bits=bits)}


def with_bits(features: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows with their code's bought months as ``_bits``, null for a code without any."""
    return features.join(bits.select("rm_code", F.col("bits").alias("_bits")), "rm_code", "left")


def feature_report(features: DataFrame, missing: DataFrame, names: list[str], lags: LagWindow) -> DataFrame:
    """No nulls, and no row in a month without a purchase.

    ``missing`` has the bought months as one row of ``month_bits`` per code, or the
    cells without a purchase as rows.
    """
    if "bits" in missing.columns:
        return expectations(with_bits(features, missing), feature_checks(names, lags))
    columns = feature_names(names, lags)
    unbought = missing.select("rm_code", "month_idx", F.lit(True).alias("_unbought"))
    marked = features.join(unbought, ["rm_code", "month_idx"], "left")
    checks = null_checks(["average_price", *columns])
    return expectations(marked, checks | {"imputed_target": F.col("_unbought").isNotNull()})


class Watch:
    """Checks worked out by the pass that writes the frames, without reading them again.

    ``frame`` marks a frame; its counts are there once an action has run a plan that holds
    the frame once. Tasks that run again after an executor is lost count their rows
    again: violations may then be overstated, never be missed.
    """

    def __init__(self) -> None:
        self._stages: dict[str, tuple[Observation, list[str]]] = {}

    def frame(self, df: DataFrame, stage: str, broken: Mapping[str, Column] | None = None) -> DataFrame:
        """``df`` with its rows, and the rows breaking each condition, counted on the way."""
        counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in (broken or {}).items()]]
        self._stages[stage] = Observation(), list(broken or {})
        return df.observe(self._stages[stage][0], *counts)

    def rows(self, stage: str) -> int:
        return self._stages[stage][0].get["rows"]

    def found(self, stage: str) -> list[tuple[str, int]]:
        """``(check, violations)`` of a stage; waits for the action."""
        observation, names = self._stages[stage]
        counts = observation.get
        return [("is_empty", int(counts["rows"] == 0)), *[(n, counts[n]) for n in names]]


def report_rows(spark: SparkSession, found: Mapping[str, list[tuple[str, int]]]) -> DataFrame:
    """Counts that are known already as a report of several stages."""
    rows = [(stage, check, int(n)) for stage, listed in found.items() for check, n in listed]
    return spark.createDataFrame(rows, "stage string, check string, violations long")


def not_more_rows(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that a step has added although it may only drop some."""
    before_n = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return unfold_checks(after.agg(F.greatest(F.count(F.lit(1)) - before_n, F.lit(0)).alias("rows_added")))


def same_rows(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that a step has added or lost although it must keep their number."""
    before_n = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return unfold_checks(after.agg(F.abs(F.count(F.lit(1)) - before_n).alias("rows_changed")))


def require(report: DataFrame) -> None:
    """Run a report and raise, naming every broken check; a report has a row per check."""
    broken = report.where("violations > 0").orderBy("check").collect()
    if broken:
        raise ValueError("; ".join(f"{row['check']}: {row['violations']}" for row in broken))


def check_feature_columns(features: DataFrame, names: list[str], lags: LagWindow, horizon: int = 1) -> None:
    """Columns of a matrix against the configuration; looks at the schema only."""
    expected = set(feature_names(names, lags, horizon))
    families = set(driver_names(names, lags.lags)) | {f"AR_{i}" for i in lags.lags}
    types = dict(features.dtypes)
    present = families & set(types)
    problems = [f"{c} is absent" for c in sorted(expected - present)]
    problems += [f"{c} is not known {horizon} months ahead" for c in sorted(present - expected)]
    problems += [f"{c} is {types[c]}, not double" for c in sorted(present) if types[c] != "double"]
    if problems:
        raise ValueError("; ".join(problems))


def union_reports(reports: Mapping[str, DataFrame]) -> DataFrame:
    """Reports of several stages under one another."""
    staged = [r.select(F.lit(stage).alias("stage"), "check", "violations") for stage, r in reports.items()]
    return reduce(DataFrame.unionByName, staged)
